"""Running sums, ranks and pages by steps against plain sorting."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera.operators import calibration as C
from statera.operators import review as V
from statera.operators.ranks import ranked, share_step

R = random.Random(5)
#: Continuous scores, most of them close to 1, a third of them the same, some at the ends, some missing.
SCORES = [R.choice([1 - 10 ** R.uniform(-9, 0), R.random(), 0.5, 0.5, 0.0, 1.0, None]) for _ in range(3000)]
ROWS = [(f"f{i:05}", R.choice(["amount", "amount", "date", None]), c, R.random() < 0.8) for i, c in enumerate(SCORES)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "field_id string, family string, confidence double, correct boolean").repartition(7)


def low(c):
    return (c is not None, c or 0.0)


def test_sweep(samples):
    got = {(x.family, x.threshold): (x.n, x.accepted, x.right) for x in C.sweep(samples).collect()}
    want = {}
    for family in ("amount", "date", None):
        mine = [(c, k) for _, f, c, k in ROWS if f == family]
        for t in {c for c, _ in mine}:
            taken = [k for c, k in mine if low(c) >= low(t)]
            want[family, t] = (len(mine), len(taken), sum(taken))
    assert got == want


def test_steps_never_fall(spark):
    values = sorted([c for c in SCORES if c is not None] + [5e-324, 1e-300, 1 - 2**-53, 0.5 + 2**-53, 0.5 - 2**-54])
    steps = [x.s for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", share_step(F.col("v")).alias("s")).orderBy("i").collect()]
    assert steps == sorted(steps)
    distinct = Counter(s for s, _ in {(s, v) for s, v in zip(steps, values, strict=True)})
    assert max(distinct.values()) <= 20  # of some 1,200 different scores, most of them within a thousandth of 1


def test_ranks_with_nulls(samples):
    out = ranked(samples, ["family"], F.col("field_id"), [F.col("confidence")], share_step(F.col("confidence")))
    got = {x.field_id: (x.rn, x.n) for x in out.collect()}
    want = {}
    for family in ("amount", "date", None):
        mine = sorted(((low(c), hashlib.md5(i.encode()).hexdigest(), i) for i, f, c, _ in ROWS if f == family))
        want |= {m[2]: (r + 1, len(mine)) for r, m in enumerate(mine)}
    assert got == want


@pytest.mark.parametrize("offset", [0, 11, 700, 1500, 2990, 3000, 9000])
def test_pages(samples, monkeypatch, offset):
    """Pages in the flat third, across its edges, at the end and past it."""
    monkeypatch.setattr(V, "SHALLOW", 10)
    steps = [share_step(F.col("confidence")), F.col("confidence"), *[F.substring("field_id", 1, n) for n in (3, 4, 5)]]
    got = V.page(samples, ["confidence", "field_id"], 50, offset, steps)
    want = sorted(ROWS, key=lambda r: (low(r[2]), r[0]))[offset : offset + 50]
    assert [x.field_id for x in got.collect()] == [w[0] for w in want]
    assert got.columns == samples.columns


def test_limits(samples):
    with pytest.raises(ValueError, match="offset"):
        V.page(samples, ["field_id"], 50, -1)
