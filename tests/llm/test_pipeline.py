"""run() against a brute-force version of its five stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from statera.llm import bpe, mixing, quality

BLANK = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails(line):
    n, symbols = len(words(line)), len(re.findall(r"[#*$%&<>]", line))
    bars, marks = line.count("|"), line.count("!")
    return (
        (bars >= 2 and bars * 5 >= n)
        or (symbols >= 3 and symbols * 2 >= n)
        or (marks >= 3 and marks * 3 >= n)
        or (0 < n < 4 and not re.search(rf"[{quality.END_MARKS}][\x20\x09-\x0D]*\Z", line))
        or (0 < n <= 12 and any(p in line.lower() for p in quality.PHRASES))
    )


def cleaned(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    repeat = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
    if len(w) < 20 or 100 * len(repeat) > 30 * len(w):
        return None
    kept = "\n".join(x for x in text.split("\n") if not fails(x))
    solid = lambda t: len(re.sub(BLANK, "", t))
    return kept if solid(kept) >= 0.5 * solid(text) else None


def unit(s):
    return (int(hashlib.md5(s.encode()).hexdigest()[:7], 16) + 0.5) / 268435456


def mixed(docs):
    by = defaultdict(list)
    for d in docs:
        by["~" if d[2] is None else "s" + d[2]].append(d)
    sizes = {k: sum(len(words(d[1])) for d in v) for k, v in by.items()}
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sizes))}
    left, open_, goal = sum(sizes.values()), dict(weight), {}
    while open_:
        level = left / sum(open_.values())
        over = [k for k in open_ if open_[k] * level >= 3 * sizes[k]]
        goal |= {k: 3.0 * sizes[k] for k in over} if over else {k: w * left / sum(open_.values()) for k, w in open_.items()}
        left -= sum(goal[k] for k in over)
        open_ = {k: w for k, w in open_.items() if k not in over} if over else {}
    out = []
    for k, v in by.items():
        rate = goal[k] / sizes[k] if sizes[k] else 0.0
        digest = lambda d: hashlib.md5(f"29:{'' if d[0] is None else d[0]}:{zlib.crc32(d[1].encode())}".encode()).hexdigest()
        u = unit(f"29/{k}")
        for i, d in enumerate(sorted(v, key=lambda d: (len(words(d[1])), digest(d))), 1):
            out += [d] * min(3, math.floor(i * rate + u) - math.floor((i - 1) * rate + u))
    return out


def test_run(spark, tmp_path):
    from test_dedup import roots, slow_fingerprint

    rnd = random.Random(6)
    vocabulary = ["word%d" % i for i in range(400)]
    line = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 30))) + "."
    texts = ["\n".join(line() for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    texts += [t.replace(t.split()[3], "other", 1) for t in texts[:12]] + texts[10:20] + [texts[0]] * 4
    texts += [None, "", "too short", " | ".join(vocabulary[:50]), "same words over and over again and again. " * 20]
    texts += [t + "\nHome | About | News" for t in texts[20:30]]
    rows = [(i, t, "en", None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    docs = [(i, c, s) for i, t, _, s, _ in rows if (c := cleaned(t or "")) is not None]
    last = {t: i for i, t, _ in docs}
    docs = [d for d in docs if last[d[1]] == d[0]]
    root = roots({slow_fingerprint(t) for _, t, _ in docs})
    least = {}
    for i, t, _ in docs:
        r = root[slow_fingerprint(t)]
        least[r] = min(i, least.get(r, i))
    docs = [d for d in docs if d[0] in least.values()]
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, s in mixed(docs):
        ids = library.encode_ordinary(t)
        want[i, s, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert 30 < len(docs) < 80

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)


CLASHES = "_a _c _copy _crc _full _h _id _k _k2 _lines _nth _pass _r _s _sha _t _times _w a at b base_failed best blocks body c cells clean_chars clean_text copies copy crc d doc e fp g h id k keep_crc keep_id kept m n n_dup_lines n_repeat_words n_symbols n_words name other own place r rate rid root rows s sha size source_size t target text_sha256 total u v w word_chars x".split()


def test_stages_keep_whatever_columns_there_are(spark, tmp_path):
    from statera.llm.common import table

    rnd = random.Random(5)
    line = lambda: " ".join("word%d" % rnd.randrange(300) for _ in range(rnd.randrange(6, 30))) + "."
    texts = ["\n".join(line() for _ in range(6)) for _ in range(30)]
    texts += [texts[0]] * 3 + [texts[1].replace(texts[1].split()[3], "other", 1), None, "", "too short"]
    ids = list(range(len(texts)))
    ids[4] = ids[5] = None
    rows = [(i, t, "en", "s%d" % (k % 3), len(t or ""), *[f"{c}{k}" for c in CLASHES], {"k": k}) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[7], rows[7], (*rows[8][:5], *["alike"] * len(CLASHES), {}), rows[9][:2] + ("fr",) + rows[9][3:]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES) + ", `a map.` map<string,int>"
    df = spark.createDataFrame(rows, schema)
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1], []).append(r)
    seen = []
    for turn in (df.repartition(3), df.repartition(2)):
        docs = turn
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = table(stage(spark, docs, ""), f"clash-{name}")
            assert docs.columns == df.columns, name
        out = docs.collect()
        assert 20 < len({r.text for r in out}) <= 31
        for r in out:
            assert any(tuple(r) == was for was in by_text[r.text])
        seen.append(Counter(str(r) for r in out))
    assert seen[0] == seen[1]
    every = mixing.mix(df, weights=(1,), most=3)
    plan = mixing.copies(df, weights=(1,), most=3).groupBy("doc_id").sum("copies").collect()
    assert Counter(r.doc_id for r in every.collect()) == Counter({r[0]: r[1] for r in plan if r[1]})


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
