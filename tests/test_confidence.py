import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from statera.operators import calibration as C
from statera.operators import confidence as K
from statera.operators import signals as G
from statera.operators.ranks import ranked


def test_threshold(spark):
    right = [True, True, True, False, True, True, False, False, True, False]
    rows = [(f"f{i}", "amount", c, k) for i, (c, k) in enumerate(zip([0.99, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3], right, strict=True))]
    rows += [("g", "text", 0.9, False)]
    got = {r.family: (r.threshold, r.accepted, r.n) for r in C.choose_thresholds(spark.createDataFrame(rows, "field_id string, family string, confidence double, correct boolean")).collect()}
    assert got == {"amount": (0.9, 3, 10), "text": (None, 0, 1)}


def test_reliability_and_error(spark):
    rows = [(f"f{i:02}", "date", i / 20, i % 2 == 0) for i in range(20)]
    bins = C.reliability(spark.createDataFrame(rows, "field_id string, family string, confidence double, correct boolean"))
    got = sorted((r.bin, r.n, r.right) for r in bins.collect())
    assert got == [(i, 2, 1) for i in range(10)]
    gap = np.mean([abs((4 * i + 1) / 40 - 0.5) for i in range(10)])
    assert C.calibration_error(bins).first().ece == pytest.approx(gap)
    seven = C.reliability(spark.createDataFrame(rows[:17], "field_id string, family string, confidence double, correct boolean"), 10).collect()
    want = [(i + 1) * 17 // 10 - i * 17 // 10 for i in range(10)]
    assert [r.n for r in sorted(seven, key=lambda r: r.bin)] == want


def test_logistic_separates(spark):
    x = np.column_stack([np.ones(40), np.repeat([0.0, 1.0], 20)])
    y = np.repeat([0.0, 1.0], 20)
    w = C.logistic(x, y)
    assert w[0] < 0 < w[0] + w[1]
    rows = [("a", [float(i % 2)], i % 2 == 1, "train") for i in range(40)]
    models = C.fit(spark.createDataFrame(rows, "family string, features array<double>, correct boolean, split string"))
    assert models.first().weights == pytest.approx(C.logistic(np.column_stack([np.ones(40), np.arange(40) % 2]), np.arange(40) % 2).tolist())
    scored = C.score(spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "family string, features array<double>"), models)
    assert {r.family: r.confidence > 0.5 for r in scored.collect()} == {"a": True, "b": False}


def test_wrong_split_raises(spark):
    rows = spark.createDataFrame([("a", [1.0], True, "test")], "family string, features array<double>, correct boolean, split string")
    with pytest.raises(PySparkException):
        C.fit(rows).collect()


def test_only_suspect(spark):
    lines = spark.createDataFrame([("d", 1, 200000), ("d", 2, 25000), ("d", 3, 20000)], "doc_id string, line_no int, amount_cents long")
    totals = spark.createDataFrame([("d", 145000, None)], "doc_id string, total long, previous long")
    deltas = G.footing_delta(lines, totals)
    assert deltas.first().delta == -100000
    assert [(r.doc_id, r.line_no) for r in G.residual_suspects(lines, deltas).collect()] == [("d", 1)]


def test_marque(spark):
    rows = [("a", "invoice_number", "M1234567"), ("a", "ro_number", "RO123456"), ("b", "invoice_number", "M1234567"), ("b", "ro_number", "RO-123456"), ("c", "invoice_number", "?")]
    got = {r.doc_id: r.oem for r in G.marque_vote(spark.createDataFrame(rows, "doc_id string, name string, value string")).collect()}
    assert got == {"a": "meridian", "b": None, "c": None}


def extraction(spark, n=60):
    """Documents with right, wrong and unread fields, and their labels."""
    rnd = random.Random(7)
    fields, labels = [], []
    for i in range(n):
        doc, split = f"d{i}", ("train", "train", "calibration", "test")[i % 4]
        route = rnd.choice(["csv", "scanned_pdf", "digital_pdf"])
        cents = [rnd.randrange(100, 9000) for _ in range(3)]
        wrong = rnd.random() < 0.4
        for k, c in enumerate(cents, 1):
            bad = wrong and k == 1
            read = c + (1000 if bad else 0)
            text = f"{read // 100}.{read % 100:02d}" if rnd.random() < 0.9 else "n/a"
            fields.append((f"{doc}:{k}:a", doc, k, "line_amount", "amount", text, k, route, 1.0 if rnd.random() < 0.5 else None))
            labels.append((f"{doc}:{k}:a", text != "n/a" and not bad, split))
            fields.append((f"{doc}:{k}:i", doc, k, "invoice_number", "reference", f"M{rnd.randrange(10**7):07d}" if rnd.random() < 0.7 else "?", k, route, None))
            labels.append((f"{doc}:{k}:i", fields[-1][5] != "?", split))
        total = sum(cents)
        fields.append((f"{doc}:t", doc, None, "total", "amount", f"{total // 100}.{total % 100:02d}", 0, route, None))
        fields.append((f"{doc}:x", doc, None, "description", "text", "words", 9, route, None))  # a family without labels
    labels += [("nowhere", True, "train")]
    df = spark.createDataFrame(fields, "field_id string, doc_id string, line_no int, name string, family string, raw_text string, reading_pos int, route string, self_consistency double")
    return G.typed(df), spark.createDataFrame(labels, "field_id string, correct boolean, split string")


def slow_pass(rows, calibrate):
    """confidence and status by plain loops over rows (field_id, family, features, label or None)."""
    def fit(x, y, steps):
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w -= 0.5 * (x.T @ (p - y) / len(y) + 1e-3 * w)
        return w

    out = {}
    for family in {f for _, f, _, _ in rows}:
        mine = [(i, np.array([1.0, *x]), lab) for i, f, x, lab in rows if f == family]
        train = [(x, lab[0]) for _, x, lab in mine if lab and lab[1] == "train"]
        if not train:
            out |= {i: (0.0, "needs_review") for i, _, _ in mine}
            continue
        w = fit(np.stack([x for x, _ in train]), np.array([y for _, y in train], float), 500)
        conf = {i: 1 / (1 + math.exp(-min(40, max(-40, x @ w)))) for i, x, _ in mine}
        cal = [(conf[i], lab[0]) for i, _, lab in mine if lab and lab[1] == "calibration"]
        if calibrate:
            z = lambda c: min(40, max(-40, math.log(c / (1 - c))))
            v = fit(np.array([[1.0, z(c)] for c, _ in cal]), np.array([y for _, y in cal], float), 2000)
            scale = lambda c: 1 / (1 + math.exp(-min(40, max(-40, v[0] + v[1] * z(c)))))
            conf, cal = {i: scale(c) for i, c in conf.items()}, [(scale(c), y) for c, y in cal]
        best = None
        for bar in sorted({c for c, _ in cal}):
            kept = [y for c, y in cal if c >= bar - 1e-12]
            if sum(kept) / len(kept) >= C.TARGETS[family] and (best is None or len(kept) > best[0]):
                best = (len(kept), bar)
        for i in conf:
            out[i] = (0.0, "needs_review") if best is None else (conf[i], "auto_accepted" if conf[i] >= best[1] - 1e-9 else "needs_review")
    return out


@pytest.mark.parametrize("calibrate", [False, True])
def test_confidence_pass(spark, calibrate):
    fields, labels = extraction(spark)
    got = K.apply_confidence(fields, labels, calibrate=calibrate)
    named = {r.field_id: (r.correct, r.split) for r in labels.collect()}
    rows = [(r.field_id, r.family, r.x, named.get(r.field_id)) for r in G.attach(fields).select("field_id", "family", C.encode().alias("x")).collect()]
    assert all(len(x) == 17 for _, _, x, _ in rows)
    want = slow_pass(rows, calibrate)
    out = {r.field_id: (r.confidence, r.status) for r in got.fields.collect()}
    assert out.keys() == want.keys() and {s for _, s in out.values()} == {"auto_accepted", "needs_review"}
    for i, (c, s) in want.items():
        assert out[i] == (pytest.approx(c, abs=1e-9), s), i
    assert got.scalers.count() == (2 if calibrate else 0) and {r.family for r in got.models.collect()} == {"amount", "reference"}
    signals = {r.field_id: r for r in G.attach(fields).collect()}
    for i in range(60):  # a wrong amount alone in its document is the suspect
        flagged = [k for k in (1, 2, 3) if signals[f"d{i}:{k}:a"].suspect]
        assert len(flagged) <= 1 and (not flagged or signals[f"d{i}:t"].footing_ok == 0.0)


def test_bound_on_vectors(spark):
    rows = [("a", [float(i)], i % 2 == 0, "train") for i in range(4000)] * 2
    df = spark.createDataFrame(rows, "family string, features array<double>, correct boolean, split string")
    few = C._vectors(df, "features", "train", 500).collect()
    assert 350 < len(few) < 650 and all(r.n == 2 for r in few)
    assert C._vectors(df, "features", "train", 10_000).count() == 4000


def test_every_vector_counts(spark):
    """A family with more vectors than a task holds is fitted on all of them, part by part."""
    rnd = random.Random(9)
    rows = [("big", [rnd.random(), rnd.random()], rnd.random() < 0.3, "train") for _ in range(400)] + [("small", [float(i % 3), 1.0], i % 3 == 1, "train") for i in range(30)]
    models = {m.family: m.weights for m in C.fit(spark.createDataFrame(rows, "family string, features array<double>, correct boolean, split string"), 40, most=60).collect()}
    for family in ("big", "small"):
        mine = [r for r in rows if r[0] == family]
        want = C.logistic(np.array([[1.0, *r[1]] for r in mine]), np.array([r[2] for r in mine], float), 40)
        assert models[family] == pytest.approx(want.tolist(), abs=1e-9)


def test_every_confidence_counts(spark, monkeypatch):
    monkeypatch.setattr(C, "PLATT_STEPS", 30)
    rnd = random.Random(4)
    rows = [("a", rnd.choice([0.0, 1.0, rnd.random(), rnd.random()]), rnd.random() < 0.6, "calibration") for _ in range(300)]
    got = C.fit_platt(spark.createDataFrame(rows, "family string, confidence double, correct boolean, split string"), most=40).first()
    z = np.array([-40.0 if c == 0 else 40.0 if c == 1 else math.log(c / (1 - c)) for _, c, _, _ in rows])
    want = C.logistic(np.column_stack([np.ones(300), z]), np.array([r[2] for r in rows], float), 30)
    assert (got.intercept, got.slope) == pytest.approx(tuple(want), abs=1e-9)


def test_ranks_with_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), rnd.choice([0.5, 0.5, 0.5, rnd.random()]), f"k{i}") for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g string, v double, k string"), ["g"], F.col("k"), [F.col("v")], F.floor(F.col("v") * 64)).collect()
    for g in "xy":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], hashlib.md5(r[2].encode()).hexdigest()))
        assert {r.k: r.rn for r in got if r.g == g} == {r[2]: i for i, r in enumerate(order, 1)}


def test_sweep_layout(spark):
    rows = [("amount", c / 50, c % 7 != 0) for c in range(50)]
    s = spark.createDataFrame(rows, "family string, confidence double, correct boolean")
    applied = spark.createDataFrame([("amount", 0.9), ("date", None)], "family string, threshold double")
    out = C.sweep_curve(s, s, applied).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out))) and out[-1].threshold == 0.9 and 0.9 in [r.threshold for r in out[:-1]]
    for r in out:
        kept = [k for _, c, k in rows if c >= r.threshold - 1e-12]
        assert (r.accepted, r.right) == (len(kept), sum(kept)) and r.accepted > 0
    back = C.recovered_sweeps(spark.createDataFrame(out)).first()
    assert back.applied == back.achieved and back.curve_points == len(out) - 1
    with pytest.raises(PySparkException):
        C.recovered_sweeps(spark.createDataFrame([r for r in out[:-1] if r.threshold != 0.9] + out[-1:])).collect()


def test_signals_move_a_field_once(spark, tmp_path):
    """All that a document says of its fields is read in one layout."""
    kind = "field_id string, doc_id string, line_no int, name string, family string, raw_text string, value string, value_cents long, value_date date, reading_pos int, route string"
    path = str(tmp_path / "fields")
    spark.createDataFrame([("f", "d", 1, "line_amount", "amount", "1.00", "1.00", 100, None, 1, "csv")], kind).write.parquet(path)
    plan = G.attach(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_fields_without_a_document_have_no_neighbours(spark):
    kind = "field_id string, doc_id string, line_no int, name string, family string, raw_text string, value string, value_cents long, value_date date, reading_pos int, route string"
    rows = [("a", None, 1, "line_amount", "amount", "1.00", "1.00", 100, None, 1, "csv"), ("t", None, None, "total", "amount", "9.00", "9.00", 900, None, 0, "csv")]
    got = G.attach(spark.createDataFrame([*rows, *[(f"x{r[0]}", "d", *r[2:]) for r in rows]], kind)).collect()
    assert {r.field_id: (r.footing_ok, r.suspect) for r in got} == {"a": (None, False), "t": (None, False), "xa": (0.0, True), "xt": (0.0, False)}


def test_fields_judged_in_place_are_moved_once(spark):
    """Fields and truth are dealt by document once; signals and labels need no other move."""
    from statera.operators import metrics as E

    rows = [(f"d{i % 4}" if i != 11 else None, None if i % 5 == 4 else i // 4, "line_amount" if i % 2 else "invoice_number") for i in range(24)]
    fields = spark.createDataFrame([(f"f{i}", d, n, name, "amount" if i % 2 else "reference", ["M1", "7.00", "x", ""][i % 4], i, "csv", 0.5) for i, (d, n, name) in enumerate(rows)],
        "field_id string, doc_id string, line_no int, name string, family string, raw_text string, reading_pos int, route string, self_consistency double")
    truth = spark.createDataFrame([(*r, None if i % 2 else "M01", 700 if i % 2 else None, None) for i, r in enumerate(dict.fromkeys(rows)) if i % 6] + [("d1", 1, "description", "t", None, None)],
        "doc_id string, line_no int, name string, truth string, truth_cents bigint, truth_day date")
    cols = [*fields.columns, "value", "value_cents", "value_date", "correct"]
    want = E.judged(G.typed(fields), truth).select(cols)
    got = E.judged_in_place(fields, truth)
    assert got.columns == cols and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.filter("correct").count() > 1
    plan = G.attach(got)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning(doc_id") == 1 and "SortMergeJoin" not in physical
