import random
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from statera.llm import exact_dedup, simhash
from statera.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, fp string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, "x") for i, t in pairs], SCHEMA).repartition(4)


def odd_texts():
    rnd = random.Random(7)
    long = "".join(rnd.choice("ab") for _ in range(3000))
    return [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "c"), (8, "c" + long), (9, long[:1000] * 3), (9, long[:1000] * 3), (10, long[:1000]), (None, "a"), (None, "z"), (11, "é" * 500), (12, "é" * 499 + "e")]


def wanted(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        out[i, max(ids, default=None), len(groups[t or ""])] += 1
    return out, len(groups)


def test_classes(spark):
    pairs = odd_texts()
    want, n = wanted(pairs)
    for block, bits in ((16, 64), (4096, 64), (16, 3), (7, 64)):  # few key bits: keys of different blocks are equal
        rows = exact_dedup.classes(frame(spark, pairs), block=block, key_bits=bits).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
        assert sum(r.kept for r in rows) == n
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_kept_rows(spark):
    pairs = odd_texts()
    kept = exact_dedup.drop_duplicates(frame(spark, pairs)).collect()
    assert len(kept) == wanted(pairs)[1] == len({r.text or "" for r in kept})
    assert kept[0].asDict().keys() == set(x.split()[0] for x in SCHEMA.split(", "))


def test_no_rows(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert exact_dedup.classes(empty).count() == 0
    assert simhash.clusters(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c", "A b\tc\nd", "ÀÉ x y z w", " ".join(rnd.choice(["x", "Yy", "zé"]) for _ in range(200))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert simhash.fingerprint("a b c d") == xxhash.xxh64_intdigest(b"a b c d", 42)


def roots(fps):
    fps, parent = list(fps), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                parent[find(x)] = find(y)
    return {f: find(f) for f in fps}


def near_fps():
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:25]:
        for _ in range(rnd.randrange(1, 6)):
            g = f
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                g ^= 1 << b
            fps.add(g)
    base = rnd.getrandbits(64)  # a dense cell
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10)}
    return fps


def test_links(spark):
    fps = near_fps()
    want = roots(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    assert simhash.advised_subgrids(1000) < simhash.advised_subgrids(10**10)
    for cell, subgrids in ((simhash.CELL, 7), (20, 7), (simhash.CELL, 5), (40, 9)):  # with few members a cell, dense cells are cut into chunks
        found = {r.node: r.root for r in components(simhash.near_edges(df, cell, subgrids)).collect()}
        groups, ours = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[want[f]].add(f)
            s = simhash._signed(f)
            ours[found.get(s, s)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_clusters(spark):
    rnd = random.Random(11)
    words = ["w%d" % i for i in range(500)]
    base = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(12)]
    pairs = [(i, t) for i, t in enumerate(base)] + [(50 + i, t.replace(t.split()[7], "zz", 1)) for i, t in enumerate(base)]
    pairs += [(100, base[2].upper()), (200, None), (201, ""), (None, base[3]), (None, "alone at last here"), (4, base[4]), (4, base[5])]
    df = frame(spark, pairs)
    prints = [(i, slow_fingerprint(t)) for i, t in pairs]
    want = roots({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[want[f]] = min(i, least.get(want[f], i))
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.clusters(df).collect())
    assert got == Counter((i, simhash._signed(f), least.get(want[f])) for i, f in prints)
    kept = simhash.keep_one(df).collect()
    assert Counter(want[slow_fingerprint(r.text)] for r in kept) == Counter(set(want.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} <= set(least.values())


def test_components_of_a_chain(spark):
    rnd = random.Random(5)
    ids = list(range(60))
    rnd.shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(ids, 0), 100: 100, 101: 100}
    assert components(edges.filter(F.lit(False))).count() == 0
