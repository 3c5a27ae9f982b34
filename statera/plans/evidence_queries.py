"""Queries over evidence signals, the confidence pass, evaluation and costs, with the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statera.constants import GRAMMARS, OEMS, ROUTES, TARGETS
from statera.functions import scalar as S
from statera.operators import calibration as C
from statera.operators import confidence as K
from statera.operators import costs
from statera.operators import metrics as E
from statera.operators import signals as G
from statera.plans.base import book
from statera.plans.scalar_queries import _AMOUNT, _DATE, _PRICED
from statera.plans.views import load
from statera.scratch import scratch_dir, table

QUERIES, ORACLE_SQL, query = book()


def _extracted(spark, d):
    return G.typed(load(spark, d, "extracted"))


_P = f"p AS MATERIALIZED (SELECT *, CASE WHEN family = 'amount' THEN {_AMOUNT} END AS cents, CASE WHEN family = 'date' THEN {_DATE} END AS day FROM extracted)"


@query("op_A2_truth_delta", "SELECT doc_id, (sum(amount_cents) FILTER (tag <> 3) + sum(CASE WHEN tag = 3 THEN amount_cents - 900 ELSE 0 END) + coalesce(sum(900) FILTER (tag = 3), 0) - max(total_cents))::BIGINT AS delta FROM statement_lines JOIN heads USING (doc_id) GROUP BY doc_id HAVING sum(amount_cents) FILTER (tag <> 3) IS NOT NULL", "statement_lines", "heads")
def a2(spark, d):
    """Truth's own arithmetic: previous + lines + adjustments - total. An offset of 900 printed on a line is an adjustment of truth."""
    lines = load(spark, d, "statement_lines")
    own = lines.withColumn("adjusted", F.col("tag") == 3).withColumn("amount_cents", F.when(F.col("tag") == 3, F.col("amount_cents") - 900).otherwise(F.col("amount_cents")))
    heads = lines.groupBy("doc_id").agg((F.count_if(F.col("tag") == 3) * 900).alias("adjustments"), F.count_if(F.col("tag") != 3).alias("plain"))
    heads = load(spark, d, "heads").select("doc_id", F.col("total_cents").alias("total")).join(heads.filter("plain > 0"), "doc_id").withColumn("previous", F.lit(0))
    return G.truth_delta(own, heads).select("doc_id", "delta")


def _votes() -> str:
    hit = lambda o: " + ".join(f"(name = '{n}' AND regexp_full_match(raw_text, '{p[o]}'))::INT" for n, p in GRAMMARS.items())
    return "[" + ", ".join(f"{{'o': '{o}', 'n': sum({hit(o)})}}" for o in OEMS) + "]"


_GRAMMAR = "CASE name " + " ".join(f"WHEN '{n}' THEN CASE oem " + " ".join(f"WHEN '{o}' THEN regexp_full_match(raw_text, '{p[o]}')" for o in OEMS) + " ELSE " + " OR ".join(f"regexp_full_match(raw_text, '{p[o]}')" for o in OEMS) + " END" for n, p in GRAMMARS.items()) + " END"
_SIGNALS = f"""
WITH {_P},
dl AS MATERIALIZED (SELECT doc_id, total - coalesce(prev, 0) - coalesce(lines, 0) AS delta FROM (SELECT doc_id, max(cents) FILTER (name = 'total') AS total, max(cents) FILTER (name = 'previous_balance') AS prev,
    sum(cents) FILTER (name = 'line_amount') AS lines FROM p GROUP BY 1) t WHERE total IS NOT NULL),
su AS MATERIALIZED (SELECT doc_id, line_no FROM (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM p JOIN dl USING (doc_id)
    WHERE name = 'line_amount' AND cents IS NOT NULL AND abs(delta) > 1 AND delta + cents <> 0 AND ((delta + cents > 0) = (cents > 0))) t WHERE n = 1),
vt AS MATERIALIZED (SELECT doc_id, {_votes()} AS v FROM p WHERE raw_text IS NOT NULL GROUP BY 1),
oe AS MATERIALIZED (SELECT doc_id, CASE WHEN list_max(list_transform(v, lambda x: x.n)) > 0 AND len(list_filter(v, lambda x: x.n = list_max(list_transform(v, lambda y: y.n)))) = 1
    THEN list_filter(v, lambda x: x.n = list_max(list_transform(v, lambda y: y.n)))[1].o END AS oem FROM vt),
an AS MATERIALIZED (SELECT doc_id, field_id AS anchor_id, day AS anchor FROM p WHERE name = 'statement_date' AND day IS NOT NULL),
md AS MATERIALIZED (SELECT a.field_id, (list(b.day ORDER BY b.day))[len(list(b.day)) // 2 + 1] AS middle FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field_id <> b.field_id AND b.day IS NOT NULL
    LEFT JOIN an ON an.doc_id = a.doc_id WHERE a.day IS NOT NULL AND (an.anchor IS NULL OR an.anchor_id = a.field_id) GROUP BY 1),
sg AS MATERIALIZED (SELECT p.*, CASE WHEN family = 'amount' THEN CASE WHEN abs(delta) <= 1 THEN 1.0::DOUBLE WHEN delta IS NOT NULL THEN 0.0::DOUBLE END END AS footing_ok,
  name = 'line_amount' AND su.line_no IS NOT NULL AS suspect,
  CASE family WHEN 'amount' THEN (cents IS NOT NULL)::INT::DOUBLE WHEN 'date' THEN CASE WHEN day IS NULL THEN 0.0::DOUBLE ELSE
    (abs(day - CASE WHEN anchor IS NOT NULL AND anchor_id <> field_id THEN anchor ELSE middle END) <= 60)::INT::DOUBLE END END AS validator_pass,
  ({_GRAMMAR})::INT::DOUBLE AS grammar_match,
  CASE WHEN length(raw_text) > 0 THEN length(regexp_replace(raw_text, '[^O0I1lS5B8Z2]', '', 'g'))::DOUBLE / length(raw_text) ELSE 0.0::DOUBLE END AS char_ambiguity
FROM p LEFT JOIN dl USING (doc_id) LEFT JOIN oe USING (doc_id) LEFT JOIN an USING (doc_id) LEFT JOIN md USING (field_id) LEFT JOIN su ON su.doc_id = p.doc_id AND su.line_no = p.line_no)
"""


def _signals(spark, d):
    return G.attach(_extracted(spark, d))


@query("op_M1_attach_signals", _SIGNALS + "SELECT field_id, self_consistency, footing_ok, suspect, validator_pass, grammar_match, round(char_ambiguity, 9) AS char_ambiguity FROM sg", "extracted")
def m1(spark, d):
    return _signals(spark, d).select("field_id", "self_consistency", "footing_ok", "suspect", "validator_pass", "grammar_match", F.round("char_ambiguity", 9).alias("char_ambiguity"))


@query("op_R29_absent_signal", "SELECT field_id, coalesce(CASE WHEN family = 'amount' THEN 0.25::DOUBLE END, self_consistency) AS self_consistency, CASE WHEN family = 'amount' THEN 0.75::DOUBLE END AS det_llm_agreement FROM extracted", "extracted")
def r29(spark, d):
    """Agreement measured upstream comes in for the fields it names; others keep what their row carries."""
    x = _extracted(spark, d)
    context = x.filter("family = 'amount'").select("field_id", F.lit(0.25).alias("self_consistency"), F.lit(0.75).alias("det_llm_agreement"))
    return G.attach(x, context).select("field_id", "self_consistency", "det_llm_agreement")


_pairs = [x for n in C.SIGNALS for x in (f"({n} IS NOT NULL)::INT::DOUBLE", f"coalesce({n}, 0.0)::DOUBLE")]
_X = "[" + ", ".join([*_pairs, "suspect::INT::DOUBLE", "char_ambiguity", *[f"(route = '{r}')::INT::DOUBLE" for r in ROUTES]]) + "]"


@query("op_M2_encode", _SIGNALS + f", en AS (SELECT field_id, {_X} AS x FROM (SELECT *, NULL::DOUBLE AS det_llm_agreement FROM sg) s) SELECT field_id, len(x)::INT AS n, list_aggregate(list_transform(x, lambda v: round(v * 1000000)::BIGINT::VARCHAR), 'string_agg', ' ') AS x FROM en", "extracted")
def m2(spark, d):
    x = C.encode()
    whole = F.array_join(F.transform(x, lambda v: F.round(v * 1000000).cast("bigint").cast("string")), " ")
    return _signals(spark, d).select("field_id", F.size(x).alias("n"), whole.alias("x"))


def _labels(spark, d, x):
    """Truth enters as a bit a field, with the split of its document."""
    judged = E.judged(x, load(spark, d, "truth_values")).filter("correct IS NOT NULL")
    return judged.join(load(spark, d, "manifest").select("doc_id", "split"), "doc_id").select("field_id", "correct", "split")


_JUDGED = f"""
{_P},
t AS MATERIALIZED (SELECT doc_id, name, coalesce(line_no, 0) AS at, truth, truth_cents, truth_day FROM truth_values),
j AS MATERIALIZED (SELECT p.*, CASE family WHEN 'amount' THEN CASE WHEN truth_cents IS NOT NULL THEN coalesce(cents = truth_cents, false) END
    WHEN 'date' THEN CASE WHEN truth_day IS NOT NULL THEN coalesce(day = truth_day, false) END
    ELSE CASE WHEN truth IS NOT NULL THEN coalesce(regexp_replace(regexp_replace(upper(replace(replace(raw_text, '-', ''), ' ', '')), '^0+', ''), '^([^0-9]*)0+', '\\1')
        = regexp_replace(regexp_replace(upper(replace(replace(truth, '-', ''), ' ', '')), '^0+', ''), '^([^0-9]*)0+', '\\1'), false) END END AS correct
  FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.name = p.name AND t.at = coalesce(p.line_no, 0))
"""


@query("op_J17_truth_resolution", f"WITH {_JUDGED} SELECT field_id, correct FROM j", "extracted", "truth_values")
def j17(spark, d):
    return E.judged(_extracted(spark, d), load(spark, d, "truth_values")).select("field_id", "correct")




@query(
    "op_A4_field_accuracy",
    f"""WITH {_JUDGED}, doc AS MATERIALIZED (SELECT doc_id, tier FROM manifest WHERE split = 'test'),
    a AS (SELECT family, tier, count(*) AS in_truth, count(text) AS expected FROM truth_values v JOIN doc USING (doc_id)
      LEFT JOIN printed r ON r.doc_id = v.doc_id AND r.key = coalesce(v.line_no::VARCHAR, 'header') || ':' || v.name
      WHERE coalesce(truth, truth_cents::VARCHAR, truth_day::VARCHAR) IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT family, tier, count(correct) AS extracted, count(*) - count(correct) AS spurious, count(*) FILTER (correct) AS canonical, count(*) FILTER (correct IS NOT NULL AND raw_text = text) AS raw
      FROM j JOIN doc USING (doc_id) LEFT JOIN printed r ON r.doc_id = j.doc_id AND r.key = coalesce(j.line_no::VARCHAR, 'header') || ':' || j.name GROUP BY 1, 2)
    SELECT family, tier, in_truth, expected, coalesce(extracted, 0) AS extracted, coalesce(spurious, 0) AS spurious, coalesce(canonical, 0) AS canonical, coalesce(raw, 0) AS raw
    FROM a LEFT JOIN s USING (family, tier) WHERE expected > 0""",
    "extracted", "truth_values", "printed",
)
def a4(spark, d):
    return E.score_fields(_extracted(spark, d), load(spark, d, "truth_values"), load(spark, d, "printed"), load(spark, d, "manifest"), "test")


def _judged(spark, d):
    """Extracted fields with correct and split, dealt by document once."""
    split = load(spark, d, "manifest").select("doc_id", "split")
    return E.judged_in_place(load(spark, d, "extracted"), load(spark, d, "truth_values")).join(split, "doc_id", "left")


def _train(spark, d):
    return K.labelled(K.with_signals(_judged(spark, d), None, ("field_id",)))


@query("op_M3_fit_logistic")
def m3(spark, d):
    """family and weights of the scorers over all 17 features. Iterative: tests hold it against a plain gradient loop."""
    return C.fit(_train(spark, d).filter("split = 'train'"))


QUERIES["op_R1_fit_scorers"] = QUERIES["op_M3_fit_logistic"]


@query("op_M4_predict")
def m4(spark, d):
    rows = _train(spark, d)
    return C.score(rows, C.fit(rows.filter("split = 'train'"))).select("field_id", F.round("confidence", 6).alias("confidence"))


@query("op_M5_fit_platt")
def m5(spark, d):
    return C.fit_platt(load(spark, d, "samples").filter("split = 'calibration'"))


@query("op_M6_rescale", "SELECT field_id, round(CASE family WHEN 'amount' THEN 1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, 1.5 * z - 0.5)))) WHEN 'date' THEN 1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, 0.5 * z + 1)))) ELSE confidence END, 6) AS confidence FROM (SELECT *, CASE WHEN confidence <= 0 THEN -40.0::DOUBLE WHEN confidence >= 1 THEN 40.0::DOUBLE ELSE greatest(-40.0::DOUBLE, least(40.0::DOUBLE, ln(confidence / (1 - confidence)))) END AS z FROM samples) s", "samples")
def m6(spark, d):
    """Given scalers; a family without one keeps its confidence."""
    scalers = spark.createDataFrame([("amount", 1.5, -0.5), ("date", 0.5, 1.0)], "family string, slope double, intercept double")
    return C.rescale(load(spark, d, "samples"), scalers).select("field_id", F.round("confidence", 6).alias("confidence"))


@query("op_M8_split_guard", "SELECT family, count(*) AS n FROM samples WHERE split = 'train' GROUP BY family", "samples")
def m8(spark, d):
    """Every row passes the guard; one of another split ends the job (tests)."""
    return C.guarded(load(spark, d, "samples").filter("split = 'train'"), "train").groupBy("family", "split").agg(F.count(F.lit(1)).alias("n")).drop("split")


@query("op_M9_apply_confidence")
def m9(spark, d):
    out = K.apply_confidence(_judged(spark, d), None, keep=("field_id",))
    return out.fields.select("field_id", F.round("confidence", 6).alias("confidence"), "status")


@query("op_M9_apply_calibrated")
def m9_calibrated(spark, d):
    out = K.apply_confidence(_judged(spark, d), None, calibrate=True, keep=("field_id",))
    return out.fields.select("field_id", F.round("confidence", 6).alias("confidence"), "status")


_targets = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TARGETS.items())
_SWEEP = "SELECT DISTINCT family, confidence AS threshold, count(*) OVER (PARTITION BY family) AS n, count(*) OVER w AS accepted, (sum(correct::INT) OVER w)::BIGINT AS r FROM c WINDOW w AS (PARTITION BY family ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING)"
_CHOSEN = f"c AS MATERIALIZED (SELECT * FROM samples WHERE split = 'calibration'), t AS MATERIALIZED (SELECT * FROM samples WHERE split = 'test'), s AS MATERIALIZED ({_SWEEP}), g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY accepted DESC) AS i FROM s WHERE r::DOUBLE / accepted >= CASE family {_targets} END), h AS MATERIALIZED (SELECT f.family, g.threshold, coalesce(g.accepted, 0) AS accepted, coalesce(g.r, 0) AS r, f.n FROM (SELECT family, count(*) AS n FROM c GROUP BY family) f LEFT JOIN (SELECT * FROM g WHERE i = 1) g USING (family))"


@query("op_M11_calibrate_report", f"WITH {_CHOSEN}, rb AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY confidence, md5(field_id), field_id) AS rn, count(*) OVER (PARTITION BY family) AS n_all FROM c), b AS (SELECT family, (10 * rn - 1) // n_all AS bin, count(*) AS n, avg(confidence) AS m, sum(correct::INT)::DOUBLE AS k FROM rb GROUP BY 1, 2), e AS (SELECT family, sum(n * abs(m - k / n)) / sum(n) AS ece FROM b GROUP BY family) SELECT family, round(threshold, 9) AS threshold, round(r::DOUBLE / nullif(accepted, 0), 9) AS precision, round(1 - accepted::DOUBLE / n, 9) AS review_rate, round(ece, 9) AS ece FROM h JOIN e USING (family)", "samples")
def m11(spark, d):
    s = load(spark, d, "samples").filter("split = 'calibration'")
    ece = C.calibration_error(C.reliability(s))
    t = C.choose_thresholds(s)
    return t.join(ece, "family").select("family", F.round("threshold", 9).alias("threshold"), F.round(F.try_divide("right", "accepted"), 9).alias("precision"), F.round(1 - F.col("accepted") / F.col("n"), 9).alias("review_rate"), F.round("ece", 9).alias("ece"))


@query("op_M12_platt_cells")
def m12(spark, d):
    """The scalers of a calibrated pass, as they are published."""
    x = _extracted(spark, d)
    out = K.apply_confidence(x, _labels(spark, d, x), calibrate=True)
    return out.scalers.select("family", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


_MODELS = [("amount", [0.5, 1.0, -0.25]), ("date", [-1.0, 0.0, 2.0])]


@query("op_R2_samples", "SELECT field_id, round(1 / (1 + exp(-(CASE family WHEN 'amount' THEN 0.5 + confidence - 0.25 * (l_linenumber % 2) ELSE -1 + 2.0 * (l_linenumber % 2) END))), 9) AS confidence FROM samples WHERE family IN ('amount', 'date')", "samples")
def r2(spark, d):
    """Rows of the families that have a model, scored by it."""
    models = spark.createDataFrame(_MODELS, "family string, weights array<double>")
    x = load(spark, d, "samples").withColumn("features", F.array("confidence", (F.col("l_linenumber") % 2).cast("double"))).drop("confidence")
    return K.samples(x, models).select("field_id", F.round("confidence", 9).alias("confidence"))


@query("op_R3_threshold_lookup", f"WITH {_CHOSEN} SELECT field_id, round(threshold, 9) AS threshold FROM samples LEFT JOIN (SELECT family, threshold FROM h) h USING (family)", "samples")
def r3(spark, d):
    s = load(spark, d, "samples")
    return K.with_threshold(s, C.choose_thresholds(s.filter("split = 'calibration'"))).select("field_id", F.round("threshold", 9).alias("threshold"))


_CURVE = f"""WITH {_CHOSEN},
ap AS (SELECT family, threshold FROM h WHERE threshold IS NOT NULL),
pt AS (SELECT DISTINCT family, threshold FROM (SELECT family, i / 40.0::DOUBLE AS threshold FROM ap, range(41) r(i) UNION ALL SELECT * FROM ap) u),
cv AS (SELECT pt.family, pt.threshold, count(c.family) AS n, count(*) FILTER (c.confidence >= pt.threshold) AS accepted, count(*) FILTER (c.confidence >= pt.threshold AND correct) AS r FROM pt JOIN c ON c.family = pt.family GROUP BY 1, 2),
ac AS (SELECT ap.family, ap.threshold, count(*) AS n, count(*) FILTER (t.confidence >= ap.threshold) AS accepted, count(*) FILTER (t.confidence >= ap.threshold AND correct) AS r FROM ap JOIN t ON t.family = ap.family GROUP BY 1, 2),
al AS (SELECT *, 0 AS last FROM cv WHERE accepted > 0 OR (family, threshold) IN (SELECT (family, threshold) FROM ap) UNION ALL SELECT *, 1 FROM ac),
sw AS (SELECT family, row_number() OVER (PARTITION BY family ORDER BY last, threshold) - 1 AS ordinal, threshold, n, accepted, r, last FROM al)
"""


def _curve(spark, d):
    s = load(spark, d, "samples")
    cal, test = s.filter("split = 'calibration'"), s.filter("split = 'test'")
    return K.sections(cal, test, table(C.choose_thresholds(cal), "thresholds"))


@query("op_W4_sweep_curve", _CURVE + 'SELECT family, ordinal, round(threshold, 9) AS threshold, n, accepted, r AS "right", round(CASE WHEN accepted = 0 THEN 1 ELSE r::DOUBLE / accepted END, 9) AS precision, round(1 - accepted::DOUBLE / n, 9) AS review_rate FROM sw', "samples")
def w4(spark, d):
    out = _curve(spark, d)[1]
    return out.select("family", F.col("ordinal").cast("bigint").alias("ordinal"), F.round("threshold", 9).alias("threshold"), "n", "accepted", "right", F.round("precision", 9).alias("precision"), F.round("review_rate", 9).alias("review_rate"))


@query("op_W5_sweep_recovery", _CURVE + "SELECT a.family, round(a.threshold, 9) AS threshold, c.accepted AS applied, a.accepted AS achieved, (SELECT count(*) FROM sw b WHERE b.family = a.family AND b.last = 0) AS curve_points FROM sw a JOIN sw c ON c.family = a.family AND c.threshold = a.threshold AND c.last = 0 WHERE a.last = 1", "samples")
def w5(spark, d):
    out = C.recovered_sweeps(table(_curve(spark, d)[1], "sweep"))
    return out.select("family", F.round("achieved.threshold", 9).alias("threshold"), F.col("applied.accepted").alias("applied"), F.col("achieved.accepted").alias("achieved"), "curve_points")


@query("op_A12_summary_tile", _PRICED + f", sx AS (SELECT CASE WHEN confidence >= 0.9 THEN 'auto_accepted' ELSE 'needs_review' END AS status FROM samples) SELECT (SELECT count(*) FROM manifest WHERE k % 10 <> 9) AS documents_processed, (SELECT count(*) FROM sx) AS fields_extracted, (SELECT count(*) FROM sx WHERE status = 'auto_accepted') AS auto_accepted, (SELECT count(*) FROM sx WHERE status = 'needs_review') AS review_queue_depth, (SELECT count(*) FROM injections WHERE dollar_impact_cents % 4 <> 0) AS open_exception_count, (SELECT coalesce(sum(abs(dollar_impact_cents)), 0)::BIGINT FROM injections WHERE dollar_impact_cents % 4 <> 0) AS gross_dollars_at_risk_cents, (SELECT coalesce(sum(CASE WHEN list_price_microusd <> 0 THEN list_price_microusd ELSE listed END), 0)::BIGINT FROM c) AS list_price_microusd", "llm_calls", "manifest", "samples", "injections")
def a12(spark, d):
    docs = load(spark, d, "manifest").withColumn("route", F.when(F.col("k") % 10 == 9, "unprocessable").otherwise(F.col("route")))
    fields = load(spark, d, "samples").select(F.when(F.col("confidence") >= 0.9, "auto_accepted").otherwise("needs_review").alias("status"))
    exceptions = load(spark, d, "injections").withColumn("status", F.when(F.col("dollar_impact_cents") % 4 == 0, "resolved").otherwise("open"))
    return E.summary(docs, fields, exceptions, load(spark, d, "llm_calls"))


@query("op_A13_summary_ratios", ORACLE_SQL["op_A12_summary_tile"].replace(" SELECT (SELECT count(*) FROM manifest", ", tile AS (SELECT (SELECT count(*) FROM manifest", 1) + ") SELECT CASE WHEN documents_processed = 0 THEN 0 ELSE list_price_microusd // documents_processed END AS cost_per_document, round(CASE WHEN fields_extracted = 0 THEN 0 ELSE auto_accepted::DOUBLE / fields_extracted END, 9) AS auto_accept_rate FROM tile")
def a13(spark, d):
    return E.summary_ratios(a12(spark, d)).withColumn("auto_accept_rate", F.round("auto_accept_rate", 9))


_RUN = "SELECT route, CASE WHEN route = 'scanned_pdf' THEN 'unserved' ELSE 'served' END AS outcome, count(*) AS n FROM manifest WHERE split = 'test' GROUP BY 1, 2"


@query("op_A22_run_counts", _RUN, "manifest")
def a22(spark, d):
    return E.run_counts(load(spark, d, "manifest").filter("split = 'test'"))


@query("op_R6_run_notes", f"SELECT 'Routed by file signature. Routes read: csv, digital_pdf, xlsx.' || CASE WHEN count(*) FILTER (outcome = 'unserved') > 0 THEN ' Routed but not read: ' || string_agg(route || ' (' || n || ')', ', ' ORDER BY route) FILTER (outcome = 'unserved') || '.' ELSE '' END AS notes FROM ({_RUN}) r", "manifest")
def r6(spark, d):
    return E.run_notes(E.run_counts(load(spark, d, "manifest").filter("split = 'test'")))


def _cards(spark, d):
    modes = F.when(F.col("mode").isNull(), F.array().cast("array<string>")).otherwise(F.array("mode"))
    return load(spark, d, "scorecards").withColumn("modes", modes)


@query("op_P14_scorecard_picker", "SELECT run_id FROM (SELECT * FROM scorecards ORDER BY evaluated DESC, created_at DESC, run_id DESC LIMIT 1) q", "scorecards")
def p14(spark, d):
    return E.latest_scorecard(_cards(spark, d)).select("run_id")


@query("op_P15_counterpart_picker", "SELECT a.run_id, b.mode, min(b.run_id) AS other_run_id FROM scorecards a JOIN scorecards b ON a.config_hash = b.config_hash AND a.split = b.split AND a.run_id <> b.run_id AND b.mode IS NOT NULL AND (a.mode IS NULL OR a.mode <> b.mode) GROUP BY 1, 2", "scorecards")
def p15(spark, d):
    return E.counterparts(_cards(spark, d))


@query("op_T7_response_cache", "SELECT call_id, prompt_tokens > 200 AS cached, CASE WHEN prompt_tokens > 200 THEN 'r' || completion_tokens END AS response FROM llm_calls", "llm_calls")
def t7(spark, d):
    """Calls whose request key the cache holds need no model; recording twice changes nothing."""
    calls = load(spark, d, "llm_calls").withColumn("request_key", S.request_key(call="call_id", model="model"))
    answers = calls.filter("prompt_tokens > 200").select("request_key", F.concat(F.lit("r"), F.col("completion_tokens").cast("string")).alias("response"))
    cache = costs.recorded(answers.filter("response LIKE '%2'"), answers)
    return costs.with_cache(calls, cache).select("call_id", "cached", "response")


def _attempts(spark, d):
    """The calls as two attempts, the second of which finds every other call in the cache; each is reported twice and stands once."""
    path = f"{scratch_dir(spark)}/calls-{uuid.uuid4().hex}"
    calls = load(spark, d, "llm_calls")
    for _ in range(2):
        costs.append(path, calls.withColumn("cached", F.lit(False)), "a1")
        costs.append(path, calls.withColumn("cached", F.col("seq") % 2 == 0), "a2")
    return costs.recorded_calls(spark, path)


@query("op_T8_append_ledger", "SELECT run_id, 2 * count(*) AS n, (sum(prompt_tokens) + coalesce(sum(prompt_tokens) FILTER (seq % 2 <> 0), 0))::BIGINT AS prompt FROM llm_calls GROUP BY 1", "llm_calls")
def t8(spark, d):
    return _attempts(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt"))


@query("op_R24_call_accounting", _PRICED + "SELECT call_id, a.cached, http_status <> 200 AS failed, CASE WHEN a.cached THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN a.cached THEN 0 ELSE listed END AS list_price_microusd FROM c JOIN (SELECT call_id AS cid, false AS cached FROM llm_calls UNION ALL SELECT call_id, seq % 2 = 0 FROM llm_calls) a ON a.cid = c.call_id", "llm_calls")
def r24(spark, d):
    return _attempts(spark, d).select("call_id", "cached", "failed", "prompt_tokens", "list_price_microusd")
