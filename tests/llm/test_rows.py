import gzip
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera.llm import license_scan, mixing, quality, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, d string, size long"


def corpus(spark, n=400):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "", "z%d" % (i % 5)])
        text = rnd.choice([None, "", " ".join(rnd.choice(["x", "yy", "zzz"]) for _ in range(rnd.randrange(1, 80)))])
        rows.append((rnd.choice([i, None, 5]) if i % 10 == 0 else i, text, "en", source, 1, "x", "x", 1))
    rows += rows[:7]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_shards(spark):
    rows, df = corpus(spark)
    out = sharding.interleave(df, 7).collect()
    assert len(out) == len(rows)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    by_source = Counter(r.source for r in out)
    for source, n in by_source.items():
        for s in counts:
            assert abs(sum(r.shard == s and r.source == source for r in out) - n / 7) <= 3
    again = sharding.interleave(df.repartition(2), 7).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert sharding.interleave(df.limit(0)).count() == 0


def filled(sizes):
    """Targets by resharing, round by round."""
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sizes))}
    left, open_, out = sum(sizes.values()), dict(weight), {}
    while open_:
        level = left / sum(open_.values())
        over = [k for k in open_ if open_[k] * level >= 3 * sizes[k]]
        if not over:
            return out | {k: w * level for k, w in open_.items()}
        for k in over:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
            del open_[k]
    return out


def test_mix(spark):
    rows, df = corpus(spark)
    plan = mixing.copies(df).collect()
    assert len(plan) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in plan:
        sizes[r.k] += r.size
        taken[r.k] += r.size * r.copies
        assert 0 <= r.copies <= 3
    want = filled(sizes)
    for r in plan:
        assert r.source_size == sizes[r.k] and math.isclose(r.target, want[r.k], rel_tol=1e-12)
    for k, goal in want.items():
        assert abs(taken[k] - goal) <= 80  # about one document
    assert Counter(map(tuple, plan)) == Counter(map(tuple, mixing.copies(df.repartition(2)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def slow_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeat = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeat)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_quality(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 6, "x y\nx y\n\nx y\nx  y", "é#|ß <b> $ 1 & 2 % *\r\n\x0b\x0cend", "w " * 2000]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(8, 120))) + rnd.choice(["", "\n" * 3, ". ok"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*texts, texts[4], texts[4]])], "doc_id long, text string, n_words long, _t string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert len(got) == len(texts) + 2 and [got[i][1:] for i in (len(texts), len(texts) + 1)] == [got[4][1:]] * 2
    assert quality.verdicts(df.limit(0)).count() == 0 and quality.clean(df.limit(0)).count() == 0
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_quality(t), t
        assert not (r.base_failed and r.kept)


def test_lines(spark):
    good = "The quick fox jumped over a lazy dog near the river bank."
    bad = ["Home | About | News | Contact", "BUY!! NOW!! IT!! IS!! FREE!!", "of%%% the*** and&&& to%%% re$$$", "Read more", "All rights reserved."]
    df = spark.createDataFrame([(1, "\n".join([good, "Another fine line of words, with more of them, ends here.", "Nobody had seen so many boats on that lake since the war.", "Then rain came, and everyone went home in silence."] + bad), "a", 5), (2, "\n".join(bad * 9), "a", 5)], "doc_id long, text string, other string, n_chars long")
    marks = [r.f for r in spark.createDataFrame([(x,) for x in [good, *bad, "", "Yes."]], "line string").select(quality.line_fails(F.col("line")).alias("f")).collect()]
    assert marks == [False, True, True, True, True, True, False, False]
    kept = quality.clean(df).collect()
    assert [r.doc_id for r in kept] == [1] and not any(b in kept[0].text for b in bad) and kept[0].n_chars == len(kept[0].text)
    assert kept[0].asDict().keys() == {"doc_id", "text", "other", "n_chars"}


def test_licenses(spark):
    texts = ["Released under the MIT License.\nCC  by-nc", None, "", "the gnu general\npublic license", "license mit", "Licensed under the Apache Version 2.0 of 2004", "MIT License mit license", "все права mit license é", "Licensed under CC BY-NC 4.0."]
    bodies = dict(license_scan.TEMPLATES[::-1])  # of several notices of one label the first
    paragraph = max((t for label, t in license_scan.TEMPLATES if label == "mit"), key=len)
    texts += [
        "Licensed under CC BY 4.0",
        "x y\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted. More.",
        "Before. " + paragraph.replace(" ", "\n * ", 30) + " After.",
        "All the world knows rights. " + "and so on " * 40 + "The seat is reserved. " + "this work is dedicated " + "so on " * 50 + "to the public domain",
        "Licensed under CC BY-NC-SA 4.0. Licensed under CC BY 4.0.",
        bodies["public-domain"] + " " + bodies["rights-reserved"],
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, texts[3], "x")], "doc_id long, text string, labels string")
    out = license_scan.scan(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(list(range(len(texts))) + [0, 0, None]) and len({tuple(map(str, r)) for r in out if r.doc_id == 0}) == 1
    got = {r.doc_id: r for r in out}
    view = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels)
    assert view(0) == (2, 3, 5, "cc-by,mit") and view(1) == (0, None, None, "") and view(3) == (1, 1, 1, "gpl") == view(None) and view(4) == (0, None, None, "")
    assert view(6) == (2, 0, 2, "mit") and got[5].labels == "apache" and got[5].score == pytest.approx(7 / 8)
    assert got[8].labels == "cc-by,cc-by-nc" and got[8].score == 1.0 and got[9].labels == "cc-by"
    assert got[10].labels == "bsd" and got[11].labels == "mit" and got[11].score == 1.0 and got[12].labels == "" and got[12].score == 0.0
    assert got[13].labels == "cc-by,cc-by-nc-sa" and got[14].labels == "public-domain,rights-reserved"
    assert [(b.first_word, b.end_word) for b in got[9].blocks if not b.state] == [(0, 6)]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_a_notice_must_name_its_license(spark):
    texts = [
        "The album was released under the new license of the label.",
        "This work is dedicated to the public library of Lyon",
        "Licensed under the Commons License Version 2.0",
        "This work is licensed under the General Public Utility License",
        "Released under the MIT License",
        "This work is dedicated to the public domain",
        "This work is licensed under the GNU General Public License",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].labels for i in range(7)] == ["", "", "", "", "mit", "public-domain", "gpl"] and got[0].score == 0.0
    # What meets the threshold is still reported, with the reason that it gives no label.
    assert [[(b.label, b.state) for b in got[i].blocks] for i in range(4)] == [[("mit", "untold")], [("public-domain", "untold")], [("apache", "untold")], [("gpl", "untold")]]


def slow_blocks(words, templates, threshold):
    """Every window of every template, by sets."""
    sets = [set(license_scan.words_of(t)) for _, t in templates]
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    found = []
    for i, (_, t) in enumerate(templates):
        told = set().union(*(sets[i] - u for u in sets if sets[i] - u and len(sets[i] & u) >= need[i]))
        width, last = len(license_scan.words_of(t)), None
        for s in range(max(1, len(words) - width + 1)):
            window = set(words[s : s + width])
            if len(window & sets[i]) >= need[i]:
                state = "" if told <= window else "untold"
                if last == (s - 1, state):
                    found[-1][2], found[-1][3] = min(s + width, len(words)), max(found[-1][3], len(window & sets[i]))
                else:
                    found.append([i, s, min(s + width, len(words)), len(window & sets[i]), state])
                last = s, state
    near = lambda i, j: len(sets[i] & sets[j]) >= max(1, math.ceil(threshold * min(len(sets[i]), len(sets[j])) - 1e-9))
    key = lambda b: (b[3], b[3] / len(sets[b[0]]), -b[0])
    told = [b for b in found if not b[4]]
    beaten = lambda b: any(b[0] != o[0] and near(b[0], o[0]) and o[1] < b[2] and b[1] < o[2] and key(o) > key(b) for o in told)
    return sorted((*b[:4], b[4] or ("beaten" if beaten(b) else "")) for b in found)


def test_join_is_exact():
    rnd = random.Random(8)
    vocabulary = [f"t{i}" for i in range(14)]
    templates = [(f"l{i}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 12)))) for i in range(14)]
    templates += [("long", templates[3][1] + " more"), ("longer", templates[3][1] + " more still")]
    some = 0
    for threshold in (0.5, 0.8, 1.0):
        index = license_scan.Index(templates, {w.encode(): rnd.randrange(50) for w in vocabulary}, threshold)
        for _ in range(250):
            words = [rnd.choice([*vocabulary, "more", "still", "x", "y"]).encode() for _ in range(rnd.randrange(0, 60))]
            want = slow_blocks(words, templates, threshold)
            some += sum(not b[4] for b in want)
            assert sorted(license_scan.blocks_of(words, index)) == want
    assert some > 1000


def test_many_notices_in_one_text():
    text = "Released under the MIT License. Some other words here.\n" * 40_000
    index = license_scan.Index(license_scan.TEMPLATES, {})
    began = time.process_time()
    n, places, base, blocks = license_scan.scan_text(text, index, {b"mit license": "mit"})
    assert time.process_time() - began < 8
    assert n == 360_000 and places == list(range(3, n, 9)) and base == {"mit"} and len(blocks) == 40_000


def pages(spark):
    rows = [(i, f"http://h{i % 5}/p{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(300)] + [(None, None, None), (3, "http://h3/p3", "other"), (3, "http://h3/p3", "other")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, volume string").repartition(4)


def test_fixity(spark):
    df = pages(spark)
    clean = warc.hashed(df)
    assert warc.audit(clean, clean, volumes=3).count() == 0
    hurt = F.when(F.col("page_id").isin(10, 200), F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    found = warc.audit(clean, warc.hashed(df, hurt), volumes=3).collect()
    assert {(r.page_id, r.state) for r in found} == {(10, "damaged"), (200, "damaged")}
    last = warc.leaves(clean, 1).orderBy(F.desc("node")).first()
    lost = warc.audit(clean, clean.filter(~F.col("page_id").eqNullSafe(F.lit(last.page_id))), volumes=1).collect()
    assert [(r.page_id, r.state) for r in lost] == [(last.page_id, "missing")]
    assert warc.audit(clean.limit(0), clean.limit(0)).count() == 0


def test_fixity_does_not_depend_on_neighbours(spark):
    df = pages(spark).cache()
    clean = warc.hashed(df)
    order = [(r.page_id, r.url) for r in spark.createDataFrame(clean.collect(), clean.schema).orderBy("key").collect()]
    once = [i for i, _ in order if i not in (None, 3)]
    cut, longer, lost, near = once[5], once[90], once[150], once[20]  # in the middle of the only volume
    html = F.when(F.col("page_id") == cut, F.lit("<p>")).when(F.col("page_id") == longer, F.concat("html", F.lit("tail"))).otherwise(F.col("html"))
    copy = df.withColumn("html", html).filter(~F.col("page_id").eqNullSafe(F.lit(lost)))
    copy = copy.unionByName(df.filter(F.col("page_id") == near).withColumn("url", F.lit("http://new"))).unionByName(df.filter("page_id IS NULL"))
    found = warc.audit(clean, warc.hashed(copy), volumes=1).collect()
    assert Counter((r.page_id, r.state) for r in found) == {(cut, "damaged"): 1, (longer, "damaged"): 1, (lost, "missing"): 1, (near, "extra"): 1, (None, "extra"): 1}
    # Of two records that share a key only the lost one is named.
    gone = df.filter(~F.col("page_id").eqNullSafe(F.lit(3)) | (F.col("html") == "other"))
    at = {r.digest: r.sha for r in warc.leaves(clean, 1).collect()}
    lost = {r.sha for r in warc.hashed(df.filter("page_id = 3 AND html <> 'other'")).collect()}
    assert [(r.state, {at[r.digest_a]}) for r in warc.audit(clean, warc.hashed(gone), volumes=1).collect()] == [("missing", lost)]
    found = warc.audit(clean, clean.limit(0), volumes=2).collect()
    assert {r.state for r in found} == {"missing"} and len(found) == df.count()


def test_hurt_replica(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 5}/p{i}", f"<p>page {i} é</p>" * (1 + i % 7)) for i in range(3000)], "page_id long, url string, html string").repartition(4).cache()
    before = Counter(((r.page_id, r.url), r.html) for r in df.collect())
    after = Counter(((r.page_id, r.url), r.html) for r in warc.hurt(df).collect())
    gone, new = before - after, after - before
    old_keys, new_keys = {k for k, _ in gone}, {k for k, _ in new}
    want = Counter({(k[0], "damaged" if k in new_keys else "missing"): 1 for k in old_keys}) + Counter((k[0], "extra") for k in new_keys - old_keys)
    assert {s for _, s in want} == {"damaged", "missing", "extra"}
    assert Counter((r.page_id, r.state) for r in warc.audit(warc.hashed(df), warc.hashed(warc.hurt(df)), volumes=2).collect()) == want


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark)
    warc.write_warc(df, str(tmp_path / "w"), 3)
    back = warc.read_warc(spark, str(tmp_path / "w"))
    want = Counter((r.page_id, r.url or "", r.html or "") for r in df.collect())
    assert Counter((r.page_id, r.url, r.html) for r in back.collect()) == want
    assert {r.error for r in back.collect()} == {None}


def test_damaged_volumes(spark, tmp_path):
    def rec(body, head=b"WARC-Type: response\r\nWARC-Target-URI: http://a\r\nWARC-Record-ID: <urn:page:7>", size=None):
        return b"WARC/1.0\r\n" + head + b"\r\nContent-Length: " + (str(len(body)).encode() if size is None else size) + b"\r\n\r\n" + body + b"\r\n\r\n"

    good = rec("é\r\n\r\nWARC/ is named inside".encode())
    info = rec(b"software: x", b"WARC-Type: warcinfo")
    volume = info + good + rec(b"x", size=b"many") + rec(b"\xff\xfe") + rec(b"odd", b"WARC-Type: response\r\nno colon here\r\nWARC-Record-ID: <urn:uuid:1>") + good + rec(b"cut off", size=b"70")[:-4]
    want = [(7, None), (None, "header"), (7, "undecodable"), (None, None), (7, None), (7, "truncated")]
    assert [(i, e) for i, _, _, e in warc.records(volume)] == want
    for n, data in enumerate([volume, gzip.compress(volume), gzip.compress(volume)[:-20], b"", b"no records", b"WARC/1.0\r\nhead only"]):
        (tmp_path / f"v{n}").write_bytes(data)
    got = Counter((r.page_id, r.error) for r in warc.read_warc(spark, str(tmp_path)).collect())
    kept = [(i, e) for i, _, _, e in warc.records(gzip.compress(volume)[:-20])]
    assert kept[:2] == want[:2] and len(kept) >= 3  # what came out before the cut
    assert got == Counter(want * 2 + kept + [(None, "truncated")])
    # A wrong length in the middle hides no other record, and an absurd one ends nothing.
    other = rec(b"the next one", b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:8>")
    for size, error in ((b"9999", "damaged"), (b"25", "damaged"), (b"1", "damaged"), (b"9" * 5000, "header")):
        got = [(i, t, e) for i, _, t, e in warc.records(good + rec(b"text", size=size) + other + good)]
        assert [(i, e) for i, _, e in got if i != 7 or e] == [(None if error == "header" else 7, error), (8, None)] and got[-2][1] == "the next one"
        assert len(got) == 4
    # Of gzip members a cut or damaged one costs its own records only.
    parts = [gzip.compress(x) for x in (good, other, good)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    assert [i for i, *_ in warc.records(parts[0] + bytes(broken) + parts[2])].count(7) == 2
    assert [i for i, *_ in warc.records(parts[0] + parts[1] + parts[2][:-30])][:2] == [7, 8]
    assert [i for i, *_ in warc.records(b"".join(parts))] == [7, 8, 7]
    data, over = warc.inflated(gzip.compress(b"x" * 1000), 100)
    assert len(data) == 100 and over
    rnd = random.Random(1)
    for _ in range(300):  # nothing that bytes may hold ends the reader
        hurt = bytearray(volume)
        for _ in range(rnd.randrange(1, 30)):
            hurt[rnd.randrange(len(hurt))] = rnd.randrange(256)
        list(warc.records(bytes(hurt)))
