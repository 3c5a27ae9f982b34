import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera.constants import GRAMMARS, SCHEDULES, TIERS
from statera.functions import scalar as S
from statera.operators import generate as N
from statera.operators import metrics as E
from statera.operators import reconcile as R


def test_patterns(spark):
    rows = spark.range(50).withColumn("k", F.col("id").cast("string"))
    for name, patterns in GRAMMARS.items():
        for pattern in patterns.values():
            got = [r.t for r in rows.select(N.expand(pattern, "k", name).alias("t")).collect()]
            assert all(re.fullmatch(pattern, t) for t in got) and len(set(got)) > 30
    with pytest.raises(ValueError):
        N.expand(r"\w", "k", "x")
    assert rows.select(F.min(S.vin_ok(N.make_vin("k")))).first()[0]


def test_quotas():
    carry, total = dict.fromkeys(N.SPLITS, 0.0), Counter()
    for n in (1, 1, 2, 3, 1, 5, 7, 1, 1):
        quotas, carry = N.split_quotas(n, carry)
        assert sum(quotas.values()) == n and min(quotas.values()) >= 0
        total.update(quotas)
    assert abs(total["train"] - 11) <= 1 and abs(total["test"] - 5.5) <= 1
    assert N.split_quotas(4, {})[0] == {"train": 2, "calibration": 1, "test": 1}


def test_dataset_is_reconciled_as_injected(spark):
    mix = {(t, tier): 3 for t in SCHEDULES for tier in TIERS[:5]} | {("parts_statement", "csv"): 30}
    made = {k: v.cache() for k, v in N.dataset(spark, mix, dealers=5, months=2, rate=80).items()}
    manifest = made["manifest"].collect()
    assert len(manifest) == sum(mix.values()) == len({r.doc_id for r in manifest})
    assert Counter((r.doc_type, r.tier) for r in manifest) == Counter(mix)
    splits = Counter(r.split for r in manifest)
    assert abs(splits["train"] - len(manifest) / 2) <= 1 and abs(splits["test"] - len(manifest) / 4) <= 1
    assert any(r.doc_id.endswith("-02") for r in manifest)  # the pool was used up
    heads, lines, injections = made["statements"], made["lines"], made["injections"].collect()
    foot = lines.groupBy("doc_id").agg(F.sum("amount_cents").alias("s"), F.max("line_no").alias("last"), F.count("*").alias("n"))
    assert heads.join(foot, "doc_id").filter("total_cents <> s OR last <> n").count() == 0
    kinds = Counter(i.expected_exception for i in injections)
    assert set(kinds) == set(N.APPLY_ORDER) and max(Counter(i.doc_id for i in injections).values()) <= 3
    assert 0.6 * len(manifest) < len({i.doc_id for i in injections}) <= 0.95 * len(manifest)
    found = R.reconcile(heads, lines, made["ledger"])[1]
    cells = E.score_recon(found, made["injections"]).collect()
    injected, caught = sum(c.injected for c in cells), sum(c.detected_true for c in cells)
    # A line that is moved past its period and copied, or the like, may be seen as another kind; most are seen as what they are.
    assert injected == len(injections) and caught >= 0.9 * injected
    again = N.dataset(spark, mix, dealers=5, months=2, rate=80)
    for name in ("lines", "injections", "manifest"):
        assert Counter(map(str, again[name].collect())) == Counter(map(str, made[name].collect()))


def test_what_is_reconciled_after_injection_is_written(spark):
    """No plan holds the generator's draws again."""
    from statera.plans.dataset_queries import _hurt

    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in _hurt(spark, "/root/testdata/sf0.001")]
    assert len(plans) == 4 and max(map(len, plans)) < 1000
