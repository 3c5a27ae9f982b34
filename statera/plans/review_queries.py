"""Queries over signals, calibration, review and set operations, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statera.constants import GRAMMARS, OEMS, TARGETS
from statera.functions import scalar as S
from statera.operators import calibration as C
from statera.operators import metrics as M
from statera.operators import review as V
from statera.operators import signals as G
from statera.operators.ranks import share_step
from statera.plans.scalar_queries import _AMOUNT, _DATE
from statera.plans.base import book
from statera.plans.views import load

QUERIES, ORACLE_SQL, query = book()


def _totals(spark, d):
    """What the statements claim: the lines' sum, off by a line's amount in every fifth document."""
    lines = load(spark, d, "statement_lines")
    return lines.groupBy("doc_id").agg((F.sum("amount_cents") + F.max(F.when(F.col("l_orderkey") % 5 == 0, F.col("amount_cents")).otherwise(0))).alias("total"), F.lit(0).cast("bigint").alias("previous"))


_TOTALS = "totals AS (SELECT doc_id, (sum(amount_cents) + max(CASE WHEN l_orderkey % 5 = 0 THEN amount_cents ELSE 0 END))::BIGINT AS total FROM statement_lines GROUP BY doc_id)"
_DELTA = f"WITH {_TOTALS}, dl AS (SELECT doc_id, (total - sum(amount_cents))::BIGINT AS delta FROM totals JOIN statement_lines USING (doc_id) GROUP BY doc_id, total)"


@query("op_A1_footing_delta", _DELTA + " SELECT doc_id, delta FROM dl", "statement_lines")
def a1(spark, d):
    return G.footing_delta(load(spark, d, "statement_lines"), _totals(spark, d))


@query("op_A3_subtotal", "SELECT doc_id, sum(amount_cents)::BIGINT AS subtotal FROM statement_lines GROUP BY doc_id", "statement_lines")
def a3(spark, d):
    return load(spark, d, "statement_lines").groupBy("doc_id").agg(F.sum("amount_cents").alias("subtotal"))


@query("op_A17_residual_suspect", _DELTA + ", s AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM statement_lines JOIN dl USING (doc_id) WHERE abs(delta) > 1 AND delta + amount_cents <> 0 AND ((delta + amount_cents > 0) = (amount_cents > 0))) SELECT doc_id, line_no FROM s WHERE n = 1", "statement_lines")
def a17(spark, d):
    lines = load(spark, d, "statement_lines")
    return G.residual_suspects(lines, G.footing_delta(lines, _totals(spark, d)))


@query("op_M1c_footing_ok", _DELTA + " SELECT doc_id, CASE WHEN abs(delta) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM dl", "statement_lines")
def m1c(spark, d):
    return G.footing_delta(load(spark, d, "statement_lines"), _totals(spark, d)).select("doc_id", G.footing_ok("delta").alias("ok"))


def _votes():
    cells = []
    for oem in OEMS:
        hits = " + ".join(f"(name = '{n}' AND regexp_full_match(value, '{p[oem]}'))::INT" for n, p in GRAMMARS.items())
        cells.append(f"sum({hits}) AS {oem}")
    return ", ".join(cells)


_REFS = "refs AS (SELECT doc_id, 'ro_number' AS name, ro_number AS value FROM statement_lines UNION ALL SELECT doc_id, 'invoice_number', invoice_number FROM statement_lines UNION ALL SELECT doc_id, 'program_code', program_code FROM statement_lines)"


@query("op_A15_marque_vote", f"WITH {_REFS}, v AS (SELECT doc_id, {_votes()} FROM refs GROUP BY doc_id), w AS (SELECT doc_id, list_filter([{{'o': 'meridian', 'n': meridian}}, {{'o': 'northstar', 'n': northstar}}, {{'o': 'kaizen', 'n': kaizen}}, {{'o': 'atlas', 'n': atlas}}], lambda x: x.n = greatest(meridian, northstar, kaizen, atlas)) AS l FROM v) SELECT doc_id, CASE WHEN len(l) = 1 AND l[1].n > 0 THEN l[1].o END AS oem FROM w", "statement_lines")
def a15(spark, d):
    lines = load(spark, d, "statement_lines")
    refs = lines.unpivot("doc_id", ["ro_number", "invoice_number", "program_code"], "name", "value")
    return G.marque_vote(refs)


@query("op_A16_other_median_date", "SELECT a.doc_id, a.line_no, (list(b.line_date ORDER BY b.line_date, b.line_no))[count(*) // 2 + 1] AS middle FROM statement_lines a JOIN statement_lines b ON a.doc_id = b.doc_id AND a.line_no <> b.line_no GROUP BY 1, 2 UNION ALL SELECT doc_id, max(line_no), NULL FROM statement_lines GROUP BY doc_id HAVING count(*) = 1", "statement_lines")
def a16(spark, d):
    return G.other_median_date(load(spark, d, "statement_lines").select("doc_id", "line_no", "line_date"))


@query("op_A18_reported_rows", "SELECT doc_id, count(DISTINCT line_no) AS n, max(line_no) AS last FROM statement_lines GROUP BY doc_id HAVING count(DISTINCT line_no) = max(line_no)", "statement_lines")
def a18(spark, d):
    return load(spark, d, "statement_lines").groupBy("doc_id").agg(F.count_distinct("line_no").alias("n"), F.max("line_no").alias("last")).filter("n = last")


_PARSED = f"p AS (SELECT *, CASE WHEN family = 'amount' THEN {_AMOUNT} END AS cents, CASE WHEN family = 'date' THEN {_DATE} END AS day FROM fields)"


@query("op_M1a_validator_pass", f"WITH {_PARSED} SELECT field_id, CASE name WHEN 'line_amount' THEN (cents IS NOT NULL)::INT::DOUBLE WHEN 'line_date' THEN CASE WHEN day IS NULL THEN 0.0::DOUBLE ELSE (day BETWEEN DATE '1998-06-01' - 60 AND DATE '1998-06-01' + 60)::INT::DOUBLE END END AS result FROM p", "fields")
def m1a(spark, d):
    f = load(spark, d, "fields").withColumn("cents", F.when(F.col("family") == "amount", S.amount_cents("raw_text"))).withColumn("day", F.when(F.col("family") == "date", S.parse_date("raw_text")))
    return f.select("field_id", G.validator_pass("name", "raw_text", "cents", "day", F.lit("1998-06-01").cast("date")).alias("result"))


_any_invoice = " OR ".join(f"regexp_full_match(raw_text, '{p}')" for p in GRAMMARS["invoice_number"].values())


@query("op_M1b_grammar_match", f"SELECT field_id, CASE WHEN name = 'invoice_number' THEN CASE WHEN l_partkey % 2 = 0 THEN ({_any_invoice})::INT::DOUBLE ELSE regexp_full_match(raw_text, '{GRAMMARS['invoice_number']['meridian']}')::INT::DOUBLE END END AS result FROM fields", "fields")
def m1b(spark, d):
    oem = F.when(F.col("l_partkey") % 2 == 1, "meridian")
    return load(spark, d, "fields").select("field_id", G.grammar_match("name", "raw_text", oem).alias("result"))


def _test(spark, d):
    return load(spark, d, "samples").filter("split = 'test'")


_T = "t AS (SELECT * FROM samples WHERE split = 'test')"


@query("op_A7_reliability_bins", f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY confidence, md5(field_id), field_id) AS rn, count(*) OVER (PARTITION BY family) AS n_all FROM t) SELECT family, ((10 * rn - 1) // n_all)::INT AS bin, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, sum(correct::INT)::BIGINT AS right FROM r GROUP BY 1, 2".replace(" AS right", ' AS "right"'), "samples")
def a7(spark, d):
    return C.reliability(_test(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("op_A8_calibration_error", f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY confidence, md5(field_id), field_id) AS rn, count(*) OVER (PARTITION BY family) AS n_all FROM t), b AS (SELECT family, ((10 * rn - 1) // n_all)::INT AS bin, count(*) AS n, avg(confidence) AS m, sum(correct::INT)::DOUBLE AS k FROM r GROUP BY 1, 2) SELECT family, round(sum(n * abs(m - k / n)) / sum(n), 9) AS ece FROM b GROUP BY family", "samples")
def a8(spark, d):
    return C.calibration_error(C.reliability(_test(spark, d))).withColumn("ece", F.round("ece", 9))


_SWEEP = "SELECT DISTINCT family, confidence AS threshold, count(*) OVER (PARTITION BY family) AS n, count(*) OVER w AS accepted, (sum(correct::INT) OVER w)::BIGINT AS r FROM c WINDOW w AS (PARTITION BY family ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING)"
_C = "c AS (SELECT * FROM samples WHERE split = 'calibration')"


@query("op_A9_sweep_points", f"WITH {_C}, s AS ({_SWEEP}) SELECT family, round(threshold, 9) AS threshold, n, accepted, r AS \"right\" FROM s", "samples")
def a9(spark, d):
    return C.sweep(load(spark, d, "samples").filter("split = 'calibration'")).withColumn("threshold", F.round("threshold", 9))


_targets = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TARGETS.items())
_CHOSEN = f"WITH {_C}, s AS ({_SWEEP}), g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY accepted DESC) AS i FROM s WHERE r::DOUBLE / accepted >= CASE family {_targets} END), h AS (SELECT f.family, g.threshold, coalesce(g.accepted, 0) AS accepted, coalesce(g.r, 0) AS r, f.n FROM (SELECT family, count(*) AS n FROM c GROUP BY family) f LEFT JOIN (SELECT * FROM g WHERE i = 1) g USING (family))"


@query("op_W3_choose_thresholds", _CHOSEN + ' SELECT family, round(threshold, 9) AS threshold, accepted, r AS "right", n FROM h', "samples")
def w3(spark, d):
    return C.choose_thresholds(load(spark, d, "samples").filter("split = 'calibration'")).withColumn("threshold", F.round("threshold", 9))


QUERIES["op_M7_choose_thresholds"], ORACLE_SQL["op_M7_choose_thresholds"] = QUERIES["op_W3_choose_thresholds"], ORACLE_SQL["op_W3_choose_thresholds"]


@query("op_A21_eval_headline", _CHOSEN + ' SELECT count(*) AS n, count(*) FILTER (confidence >= threshold) AS accepted, count(*) FILTER (confidence >= threshold AND correct) AS "right" FROM samples JOIN h USING (family) WHERE split = \'test\'', "samples")
def a21(spark, d):
    s = load(spark, d, "samples")
    return C.headline(s.filter("split = 'test'"), C.choose_thresholds(s.filter("split = 'calibration'")))


def _features(spark, d):
    s = load(spark, d, "samples")
    x = F.array(F.col("confidence"), (F.col("l_partkey") % 5 / 5).cast("double"), (F.col("l_linenumber") % 2).cast("double"))
    return s.withColumn("features", x)


_LATEST = "l AS (SELECT field_id, arg_max(new_value, seq) AS new_value FROM corrections GROUP BY field_id)"


@query("op_W1_newest_correction", f"WITH {_LATEST} SELECT * FROM l", "corrections")
def w1(spark, d):
    return V.latest(load(spark, d, "corrections"), "field_id", "new_value", "seq")


@query("op_P4_latest_value", f"WITH {_LATEST} SELECT 'U' || c_custkey AS field_id, coalesce(new_value, c_name) AS current FROM customer LEFT JOIN l ON field_id = 'U' || c_custkey", "corrections")
def p4(spark, d):
    f = load(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("field_id"), F.col("c_name").alias("value"))
    return V.with_latest(f, load(spark, d, "corrections")).select("field_id", "current")


@query("op_P5_effective_typed", f"SELECT field_id, CASE WHEN l_partkey % 2 = 0 THEN {_AMOUNT} ELSE -7 END AS cents FROM fields WHERE family = 'amount'", "fields")
def p5(spark, d):
    f = load(spark, d, "fields").filter("family = 'amount'").withColumn("new_value", F.when(F.col("l_partkey") % 2 == 0, F.col("raw_text")))
    return V.effective_typed(f.withColumn("value_cents", F.lit(-7).cast("bigint")).withColumn("value_date", F.lit(None).cast("date"))).select("field_id", "cents")


@query("op_P1_split_filter", "SELECT field_id FROM samples WHERE split = 'test'", "samples")
def p1(spark, d):
    return _test(spark, d).select("field_id")


@query("op_P2_optional_filter", "SELECT field_id FROM samples WHERE family = 'date'", "samples")
def p2(spark, d):
    return V.optional(load(spark, d, "samples"), family="date", split=None).select("field_id")


@query("op_P3_impact_floor", "SELECT entry_id FROM ledger WHERE abs(amount_cents - 5000000) >= 1000000", "ledger")
def p3(spark, d):
    return load(spark, d, "ledger").filter(F.abs(F.col("amount_cents") - 5000000) >= 1000000).select("entry_id")


@query("op_P7_processed", "SELECT call_id FROM llm_calls WHERE http_status <> 500", "llm_calls")
def p7(spark, d):
    return load(spark, d, "llm_calls").filter("http_status <> 500").select("call_id")


@query("op_P8_lookup", "SELECT entry_id, amount_cents FROM ledger WHERE entry_id = 'E5-1'", "ledger")
def p8(spark, d):
    return load(spark, d, "ledger").filter("entry_id = 'E5-1'").select("entry_id", "amount_cents")


@query("op_P9_same_line_neighbours", "SELECT a.field_id, count(b.field_id) AS n FROM fields a JOIN fields b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.field_id <> b.field_id GROUP BY 1", "fields")
def p9(spark, d):
    f = load(spark, d, "fields")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "line_no")) - 1
    return f.select("field_id", n.alias("n")).filter("n > 0")


@query("op_P11_doc_type_fallback", "SELECT s.doc_id, CASE WHEN length(s.doc_id) % 2 = 0 THEN s.doc_type ELSE l.t END AS doc_type FROM statements s JOIN (SELECT dealer_id, max(doc_type) AS t FROM ledger GROUP BY 1) l USING (dealer_id)", "statements")
def p11(spark, d):
    t = load(spark, d, "ledger").groupBy("dealer_id").agg(F.max("doc_type").alias("t"))
    s = load(spark, d, "statements").join(t, "dealer_id", "left")
    return s.select("doc_id", F.coalesce(F.when(F.length("doc_id") % 2 == 0, F.col("doc_type")), "t").alias("doc_type"))


@query("op_P12_statement_assembly", f"WITH {_PARSED} SELECT doc_id, line_no, max(cents) AS amount_cents, max(day) AS line_date, max(CASE WHEN name = 'invoice_number' THEN raw_text END) AS invoice_number, CASE WHEN max(cents) >= 0 THEN 'charge' ELSE 'credit' END AS line_type FROM p GROUP BY 1, 2 HAVING max(cents) IS NOT NULL AND max(day) IS NOT NULL", "fields")
def p12(spark, d):
    return V.assemble(load(spark, d, "fields"))


@query("op_W9_review_queue", "SELECT field_id, round(confidence, 9) AS confidence FROM (SELECT * FROM samples ORDER BY confidence, field_id LIMIT 50 OFFSET 100) q", "samples")
def w9(spark, d):
    return V.page(load(spark, d, "samples"), ["confidence", "field_id"], 50, 100).select("field_id", F.round("confidence", 9).alias("confidence"))


@query("op_W9_deep_page", "SELECT field_id, round(confidence, 9) AS confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence, field_id) AS i, count(*) OVER () AS n FROM samples) q WHERE i > n * 3 // 4 AND i <= n * 3 // 4 + 50", "samples")
def w9_deep(spark, d):
    """The page at three quarters of the queue: what is before it is counted by steps, not sorted."""
    x = load(spark, d, "samples")
    steps = [share_step(F.col("confidence")), F.col("confidence"), *[F.substring("field_id", 1, n) for n in (3, 4, 5, 6)]]
    return V.page(x, ["confidence", "field_id"], 50, x.count() * 3 // 4, steps).select("field_id", F.round("confidence", 9).alias("confidence"))


@query("op_W10_exceptions_topk", "SELECT entry_id, amount_cents FROM (SELECT * FROM ledger ORDER BY abs(amount_cents) DESC, entry_id LIMIT 50) q", "ledger")
def w10(spark, d):
    return V.page(load(spark, d, "ledger"), [F.desc(F.abs("amount_cents")), "entry_id"]).select("entry_id", "amount_cents")


@query("op_W12_documents_by_id", "SELECT doc_id FROM statements ORDER BY doc_id", "statements")
def w12(spark, d):
    return load(spark, d, "statements").select("doc_id").orderBy("doc_id")


@query("op_W13_interleave", "SELECT entry_id, row_number() OVER (PARTITION BY schedule ORDER BY md5(entry_id)) AS turn FROM ledger", "ledger")
def w13(spark, d):
    return V.round_robin(load(spark, d, "ledger"), "schedule", "entry_id").select("entry_id", "turn")


@query("op_W7_line_ordinals", "SELECT field_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM fields WHERE name = 'line_amount' AND raw_text <> 'n/a'", "fields")
def w7(spark, d):
    rows = load(spark, d, "fields").filter("name = 'line_amount' AND raw_text <> 'n/a'")
    return rows.select("field_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("ordinal"))


@query("op_W8_midpoints", "SELECT doc_id, line_no, (line_no + lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no)) / 2.0::DOUBLE AS boundary FROM statement_lines", "statement_lines")
def w8(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return load(spark, d, "statement_lines").select("doc_id", "line_no", ((F.col("line_no") + F.lead("line_no").over(w)) / 2).alias("boundary"))


@query("op_U1_set_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u1(spark, d):
    o = load(spark, d, "orders")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return pick("F").subtract(pick("O"))


@query("op_U2_set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u2(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(load(spark, d, "customer").select("c_custkey")).distinct()


@query("op_U3_distinct", "SELECT DISTINCT provider, model FROM llm_calls", "llm_calls")
def u3(spark, d):
    return load(spark, d, "llm_calls").select("provider", "model").distinct()


@query("op_U4_concatenate", "SELECT 'n' AS kind, n_name AS name FROM nation UNION ALL SELECT 'r', r_name FROM region")
def u4(spark, d):
    n = load(spark, d, "nation").select(F.lit("n").alias("kind"), F.col("n_name").alias("name"))
    return n.unionByName(load(spark, d, "region").select(F.lit("r").alias("kind"), F.col("r_name").alias("name")))


@query("op_U5_box_intersection", "SELECT p_partkey, greatest(p_size, 10)::INT AS lo, least(p_size + 20, 40)::INT AS hi FROM part WHERE greatest(p_size, 10) < least(p_size + 20, 40)")
def u5(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.greatest(F.col("p_size"), F.lit(10)).alias("lo"), F.least(F.col("p_size") + 20, F.lit(40)).alias("hi"))
    return p.filter("lo < hi")


def _old_new(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    return c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name"))


@query("op_U6_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def u6(spark, d):
    return V.upsert(*_old_new(spark, d), ["c_custkey"])


@query("op_U7_insert_missing", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def u7(spark, d):
    return V.insert_missing(*_old_new(spark, d), ["c_custkey"])


@query("op_U8_replace_documents", "SELECT doc_id, line_no FROM statement_lines WHERE length(doc_id) % 2 = 0 OR line_no = 1", "statement_lines")
def u8(spark, d):
    x = load(spark, d, "statement_lines").select("doc_id", "line_no")
    odd = x.filter("length(doc_id) % 2 = 1")
    return V.replace_documents(x, odd.filter("line_no = 1"), odd)


@query("op_U9_append_correction", "SELECT correction_id, field_id, lag(new_value) OVER (PARTITION BY field_id ORDER BY seq) AS old_value, new_value FROM corrections", "corrections")
def u9(spark, d):
    """Each entry of the log with the value it replaced."""
    old = F.lag("new_value").over(Window.partitionBy("field_id").orderBy("seq"))
    return load(spark, d, "corrections").select("correction_id", "field_id", old.alias("old_value"), "new_value")


@query("op_P17_carry_decisions", "SELECT 'U' || c_custkey AS field_id, CASE WHEN 'U' || c_custkey IN (SELECT field_id FROM corrections) THEN 'human_corrected' WHEN c_custkey % 4 = 0 THEN 'human_accepted' ELSE 'needs_review' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS confidence FROM customer", "corrections")
def p17(spark, d):
    f = load(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("field_id"), "c_custkey")
    old = f.select("field_id", F.when(F.col("c_custkey") % 4 == 0, "human_accepted").otherwise("auto_accepted").alias("status"), F.lit(0.5).alias("confidence"))
    fresh = f.select("field_id", F.lit("needs_review").alias("status"), F.lit(0.25).alias("confidence"))
    return V.carry_decisions(fresh, old, load(spark, d, "corrections"))


@query("op_J20_semi_join_restore", "SELECT c_custkey FROM customer WHERE 'U' || c_custkey IN (SELECT field_id FROM corrections)", "corrections")
def j20(spark, d):
    c = load(spark, d, "customer").withColumn("field_id", F.concat(F.lit("U"), F.col("c_custkey").cast("string")))
    return c.join(load(spark, d, "corrections"), "field_id", "left_semi").select("c_custkey")


@query("op_J21_reattach_resolution", "SELECT entry_id AS exception_id, CASE WHEN l_partkey % 2 = 0 AND l_partkey % 6 <> 0 THEN 'resolved' ELSE 'open' END AS status FROM ledger", "ledger")
def j21(spark, d):
    e = load(spark, d, "ledger").select(F.col("entry_id").alias("exception_id"), F.col("amount_cents").alias("dollar_impact_cents"), F.lit(None).cast("bigint").alias("statement_amount_cents"), F.col("amount_cents").alias("ledger_amount_cents"), "l_partkey")
    r = e.filter("l_partkey % 2 = 0").withColumn("ledger_amount_cents", F.when(F.col("l_partkey") % 6 == 0, F.col("ledger_amount_cents") + 1).otherwise(F.col("ledger_amount_cents"))).withColumn("resolution", F.lit("ok")).drop("l_partkey")
    return V.reattach_resolutions(e, r).select("exception_id", "status")


@query("op_A20_reconciliation_delta", "SELECT dealer_id AS doc_id, count(*) FILTER (l_partkey % 2 = 0 AND l_partkey % 3 <> 0) AS cleared, count(*) FILTER (l_partkey % 2 = 1 AND l_partkey % 3 = 0) AS added, (coalesce(sum(amount_cents) FILTER (l_partkey % 3 = 0), 0) - coalesce(sum(amount_cents) FILTER (l_partkey % 2 = 0), 0))::BIGINT AS risk_change FROM ledger WHERE l_partkey % 2 = 0 OR l_partkey % 3 = 0 GROUP BY 1", "ledger")
def a20(spark, d):
    e = load(spark, d, "ledger").select(F.col("dealer_id").alias("doc_id"), F.col("entry_id").alias("exception_id"), F.col("amount_cents").alias("dollar_impact_cents"), "l_partkey")
    return V.delta(e.filter("l_partkey % 2 = 0"), e.filter("l_partkey % 3 = 0"))


@query("op_J16_label_join", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j16(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("op_J19_queue_join", "SELECT f.field_id, s.doc_type FROM fields f JOIN statements s USING (doc_id)", "fields", "statements")
def j19(spark, d):
    return load(spark, d, "fields").join(load(spark, d, "statements"), "doc_id").select("field_id", "doc_type")


@query("op_A6_ratios", "SELECT split, sum(correct::INT)::BIGINT AS num, count(*) AS den, round(sum(correct::INT)::DOUBLE / nullif(count(*), 0), 9) AS ratio FROM samples GROUP BY split", "samples")
def a6(spark, d):
    g = load(spark, d, "samples").groupBy("split").agg(F.sum(F.col("correct").cast("int")).alias("num"), F.count(F.lit(1)).alias("den"))
    return g.withColumn("ratio", F.round(F.try_divide("num", "den"), 9))


@query("op_A23_dollars_at_risk", "SELECT expected_exception, coalesce(sum(abs(dollar_impact_cents)) FILTER (dollar_impact_cents % 4 <> 0), 0)::BIGINT AS risk FROM injections GROUP BY 1", "injections")
def a23(spark, d):
    x = load(spark, d, "injections").withColumn("status", F.when(F.col("dollar_impact_cents") % 4 == 0, "resolved").otherwise("open"))
    return x.groupBy("expected_exception").agg(M.dollars_at_risk().alias("risk"))
