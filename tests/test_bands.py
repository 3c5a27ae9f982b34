import random

import pytest
from pyspark.sql import functions as F

from statera.sources import bands as B


def runs_of(rows):
    """Plain loop over the gaps of sorted rows."""
    gaps = [(c + d) / 2 - (a + b) / 2 for (a, b), (c, d) in zip(rows, rows[1:])]
    out, at = [], 0
    while at < len(gaps):
        mean, n, end = gaps[at], 1, at
        while end + 1 < len(gaps) and abs(gaps[end + 1] - mean) <= 0.08 * mean:
            end, n = end + 1, n + 1
            mean += (gaps[end] - mean) / n
        out.append(rows[at : end + 2])
        at = end + 1
    return out


def drawn(seed):
    """A page of bands: a few stretches, each of its own pitch, heights that wobble."""
    r, y, rows = random.Random(seed), 10, []
    for _ in range(r.randint(1, 4)):
        pitch = r.randint(14, 60)
        for _ in range(r.randint(1, 9)):
            h = r.randint(4, 9) if seed % 3 else 8
            rows.append((y, y + h))
            y += pitch + r.choice([0, 0, 0, 1])
        y += r.randint(0, 80)
    return rows


def test_runs_and_tables_as_a_loop_gives(spark):
    pages = {f"d{i}": drawn(i) for i in range(60)}
    df = spark.createDataFrame([(d, 1, a, b) for d, rows in pages.items() for a, b in rows], "doc_id string, page int, top int, bottom int").repartition(5)
    got = {}
    for x in B.pitch_runs(df).orderBy("doc_id", "run", "row").collect():
        got.setdefault(x.doc_id, {}).setdefault(x.run, []).append((x.top, x.bottom))
    assert {d: list(r.values()) for d, r in got.items()} == {d: runs_of(rows) for d, rows in pages.items() if len(rows) > 1}

    promised, want = [], []
    for d, rows in pages.items():
        runs = runs_of(rows)
        most = max((len(r) for r in runs), default=0)
        promised.append((d, 1, most + (int(d[1:]) % 10 == 0)))
        best = [r for r in runs if len(r) == most]
        if len(best) != 1 or int(d[1:]) % 10 == 0:
            continue
        heights = [b - a for a, b in best[0]]
        mean = sum(heights) / len(heights)
        if (sum((h - mean) ** 2 for h in heights) / len(heights)) ** 0.5 / mean <= 0.25:
            want += [(d, i + 1, a, b) for i, (a, b) in enumerate(best[0])]
    found = B.table_rows(df, spark.createDataFrame(promised, "doc_id string, page int, n_rows int"))
    assert sorted((x.doc_id, x.line_no, x.top, x.bottom) for x in found.collect()) == sorted(want)
    assert len({w[0] for w in want}) > 10


def test_bands_of_ink(spark):
    rows = [(5, 2), (5, 9), (6, 18), (7, 30), (8, 17), (20, 40), (21, 40), (22, None), (30, 90), (31, 90), (32, 90)] + [(y, 50) for y in range(40, 81)]
    ink = spark.createDataFrame([("a", 1, 100, y, n) for y, n in rows] + [("b", 1, 2, y, 1) for y in range(3)] + [("b", 2, 2, y, 0) for y in range(9)], "doc_id string, page int, width int, y int, ink int")
    got = sorted(tuple(x) for x in B.print_rows(ink.withColumn("top", F.lit("clash"))).collect())
    assert got == [("a", 1, 30, 33), ("b", 1, 0, 3)]  # of two rows, with 2 rows, over 40 rows, and with too little ink: none


def test_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id string, page int, top int, bottom int")
    assert B.pitch_runs(none).count() == 0
    some = spark.createDataFrame([("a", 1, 3, None), ("a", 1, None, 9), ("a", 1, 1, 5), (None, None, 1, 5), (None, None, 11, 15), (None, None, 11, 15)], "doc_id string, page int, top int, bottom int")
    assert [tuple(x) for x in B.pitch_runs(some).orderBy("row").collect()] == [(None, None, 0, 0, 1, 5), (None, None, 0, 1, 11, 15)]


@pytest.mark.parametrize("n", [400])
def test_a_long_page(spark, n):
    df = spark.range(n).select(F.lit("a").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") * 20).cast("int").alias("top"), (F.col("id") * 20 + 8).cast("int").alias("bottom"))
    out = B.pitch_runs(df).agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("run")).first()
    assert (out.n, out.run) == (n, 0)
