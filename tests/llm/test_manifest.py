import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from statera.llm import merkle_manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def levels(hs):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(of, i):
    out = []
    for hs in of[:-1]:
        a = i // 3 * 3
        out.append(("".join(hs[a:i]), "".join(hs[i + 1 : a + 3])))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(upper, at)
            hurt = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            h = leaf(r, r["text"].replace("\n", "")) if hurt else own
            for left, right in steps:
                h = sha(left, h, right)
            out.append((r["doc_id"], own, trees[s][-1][0], upper[-1][0], sha(*[a + b for a, b in steps]), h, h == upper[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp long, path string"


def some(n, sources, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", f"a\nb {i}", "plain", "é\n\n"])
        rows.append({"doc_id": rnd.choice([i, i, i, None, 3]), "source": rnd.choice(sources), "lang": rnd.choice(["en", None]), "n_chars": rnd.choice([i, None]), "text": text, "grp": 1, "path": "x"})
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (3, ["a"]), (4, [None, "", "z"]), (130, ["hot"] * 6 + [None, "", "~", "é", "Z", "a"]), (28, ["one"])])
def test_rows_equal_a_tree_in_memory(spark, tmp_path, n, sources):
    rows = some(n, sources, n)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    got = M.op11(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_no_rows_and_own_replica(spark):
    df = spark.createDataFrame(some(12, ["a", "b"], 1), SCHEMA)
    assert M.audited(M.manifest(df.limit(0))).count() == 0
    assert M.audited(M.manifest(df)).filter("NOT verified").count() == 0


def test_a_long_text_and_another_replica(spark):
    rows = some(10, ["a", "b"], 2) + [{"doc_id": 77, "source": "a", "lang": "en", "n_chars": 1, "text": "x" * 3_000_000, "grp": 0, "path": None}]
    df = spark.createDataFrame(rows, SCHEMA)
    changed = M.leaf(**{c: F.when((F.col("doc_id") == 77) & (F.lit(c) == "text"), F.lit("y")).otherwise(F.col(c).cast("string")) for c in M._COLUMNS})
    bad = M.audited(M.manifest(df, changed)).filter("NOT verified").collect()
    assert [r.doc_id for r in bad] == [77]
