"""Queries over joins and matching, with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.operators import metrics as E
from statera.operators import reconcile as R
from statera.plans.base import book
from statera.plans.views import load
from statera.scratch import table

QUERIES, ORACLE_SQL, query = book()


def _three(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, d, "statements"), load(spark, d, "statement_lines"), load(spark, d, "ledger")


_REF = "nullif(regexp_replace(upper(replace(replace({}, '-', ''), ' ', '')), '^0+', ''), '')"
_KEY = (
    "CASE {0}doc_type WHEN 'parts_statement' THEN " + _REF.format("{1}invoice_number") + " WHEN 'warranty_credit_memo' THEN " + _REF.format("{1}claim_number")
    + " WHEN 'floorplan_statement' THEN " + _REF.format("{1}vin") + " ELSE " + _REF.format("{1}program_code") + " || '|' || " + _REF.format("{1}vin") + " END"
)
_CORE = f"""
WITH b AS MATERIALIZED (SELECT s.doc_id, s.period_start, s.period_end, l.*, {_KEY.format("s.", "l.")} AS key, l.post_date BETWEEN s.period_start AND s.period_end AS expected
  FROM statements s JOIN ledger l ON s.dealer_id = l.dealer_id AND s.doc_type = l.doc_type AND l.post_date BETWEEN s.period_start - 60 AND s.period_end + 60),
a AS MATERIALIZED (SELECT t.*, s.doc_type, s.period_start, s.period_end, {_KEY.format("s.", "t.")} AS key FROM statement_lines t JOIN statements s USING (doc_id)),
a1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, key, amount_cents ORDER BY line_no) AS i FROM a WHERE key IS NOT NULL),
b1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, key, amount_cents ORDER BY entry_pos, entry_id) AS i FROM b WHERE key IS NOT NULL),
m1 AS MATERIALIZED (SELECT a1.doc_id, line_no, entry_id FROM a1 JOIN b1 USING (doc_id, key, amount_cents, i)),
a2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS i FROM a ANTI JOIN m1 USING (doc_id, line_no) WHERE key IS NOT NULL),
b2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY entry_pos, entry_id) AS i FROM b ANTI JOIN m1 USING (doc_id, entry_id) WHERE key IS NOT NULL),
m2 AS MATERIALIZED (SELECT a2.doc_id, line_no, entry_id FROM a2 JOIN b2 USING (doc_id, key, i)),
a3 AS MATERIALIZED (SELECT * FROM a ANTI JOIN m1 USING (doc_id, line_no) ANTI JOIN m2 USING (doc_id, line_no)),
b3 AS MATERIALIZED (SELECT * FROM b ANTI JOIN m1 USING (doc_id, entry_id) ANTI JOIN m2 USING (doc_id, entry_id)),
p3 AS MATERIALIZED (SELECT a3.doc_id, a3.line_no, b3.entry_id, b3.entry_pos, a3.amount_cents AS x, b3.amount_cents AS y, abs(a3.line_date - b3.post_date) AS days,
  CASE a3.doc_type WHEN 'parts_statement' THEN damerau_levenshtein({_REF.format("a3.invoice_number")}, {_REF.format("b3.invoice_number")}) <= 1
    WHEN 'warranty_credit_memo' THEN damerau_levenshtein({_REF.format("a3.claim_number")}, {_REF.format("b3.claim_number")}) <= 1
    WHEN 'floorplan_statement' THEN damerau_levenshtein({_REF.format("a3.vin")}, {_REF.format("b3.vin")}) <= 1 OR right(a3.vin, 8) = right(b3.vin, 8)
    ELSE damerau_levenshtein({_REF.format("a3.program_code")}, {_REF.format("b3.program_code")}) <= 1 OR damerau_levenshtein({_REF.format("a3.vin")}, {_REF.format("b3.vin")}) <= 1
      OR right(a3.vin, 8) = right(b3.vin, 8) END AS hit
  FROM a3 JOIN b3 ON a3.doc_id = b3.doc_id),
c3 AS MATERIALIZED (SELECT *, 0.5::DOUBLE * CASE WHEN coalesce(hit, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + 0.35::DOUBLE * CASE WHEN x = y THEN 1.0::DOUBLE WHEN abs(x - y) * 100 <= abs(y) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - days / 45.0::DOUBLE) AS score, (x <> y)::INT AS inexact FROM p3),
g3 AS MATERIALIZED (SELECT doc_id, list({{'o': -score, 'inexact': inexact, 'days': days, 'line_no': line_no, 'entry_pos': entry_pos, 'entry_id': entry_id, 'score': score}}
    ORDER BY -score, inexact, days, line_no, entry_pos, entry_id) AS c FROM c3 WHERE score >= 0.6 GROUP BY doc_id),
m3 AS MATERIALIZED (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda y: y.line_no = x[1].line_no OR y.entry_id = x[1].entry_id)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS p FROM g3),
m AS MATERIALIZED (SELECT *, 'exact' AS pass, 1.0::DOUBLE AS score FROM m1 UNION ALL SELECT *, 'reference', 1.0 FROM m2
  UNION ALL SELECT doc_id, p.line_no, p.entry_id, 'fuzzy', p.score FROM m3),
f AS MATERIALIZED (SELECT m.doc_id, m.line_no, m.entry_id, m.pass, m.score, a.key, a.doc_type, a.amount_cents AS line_cents, b.amount_cents AS entry_cents,
    a.line_date BETWEEN a.period_start AND a.period_end AS in_line, b.post_date BETWEEN a.period_start AND a.period_end AS in_entry
  FROM m JOIN a ON a.doc_id = m.doc_id AND a.line_no = m.line_no JOIN b ON b.doc_id = m.doc_id AND b.entry_id = m.entry_id),
x AS MATERIALIZED (SELECT doc_id, line_no, entry_id, line_cents, entry_cents, CASE WHEN line_cents = entry_cents THEN CASE WHEN in_line <> in_entry THEN 'timing_difference' END
    WHEN doc_type IN ('warranty_credit_memo', 'incentive_statement') AND line_cents < entry_cents THEN 'short_pay' ELSE 'amount_mismatch' END AS t FROM f
  UNION ALL SELECT a.doc_id, a.line_no, NULL, a.amount_cents, NULL,
    CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.doc_id = a.doc_id AND f.key = a.key AND f.line_cents = a.amount_cents) THEN 'duplicate' ELSE 'missing_from_ledger' END
    FROM a ANTI JOIN m USING (doc_id, line_no)
  UNION ALL SELECT doc_id, NULL, entry_id, NULL, amount_cents, 'missing_from_statement' FROM b ANTI JOIN m USING (doc_id, entry_id) WHERE expected),
e AS MATERIALIZED (SELECT 'exc-oracle-' || doc_id || '-' || t || coalesce('-line-' || line_no, '') || coalesce('-entry-' || entry_id, '') AS exception_id, t AS exception_type, doc_id, line_no, entry_id,
    line_cents AS statement_amount_cents, entry_cents AS ledger_amount_cents,
    (CASE t WHEN 'duplicate' THEN line_cents WHEN 'missing_from_ledger' THEN line_cents WHEN 'missing_from_statement' THEN -entry_cents WHEN 'timing_difference' THEN 0
      WHEN 'short_pay' THEN entry_cents - line_cents ELSE line_cents - entry_cents END)::BIGINT AS dollar_impact_cents,
    (CASE WHEN t = 'timing_difference' THEN line_cents ELSE 0 END)::BIGINT AS memo_amount_cents, 'open' AS status FROM x WHERE t IS NOT NULL)
"""
_V = ("statements", "statement_lines")


@query("op_J1_reconcile", _CORE + "SELECT * FROM e", *_V)
def j1(spark, d):
    return R.reconcile(*_three(spark, d))[1]


@query("op_J15_match_records", _CORE + "SELECT doc_id, line_no, entry_id, pass || ':' || coalesce(key, entry_id) AS match_key, round(score, 9) AS score FROM f", *_V)
def j15(spark, d):
    return R.reconcile(*_three(spark, d))[0].withColumn("score", F.round("score", 9))


@query("op_J2_blocking", _CORE + "SELECT doc_id, entry_id, expected FROM b", *_V)
def j2(spark, d):
    s, _, ledger = _three(spark, d)
    return R.blocked(s, ledger).select("doc_id", "entry_id", "expected")


@query("op_J3_expected", _CORE + "SELECT doc_id, entry_id FROM b WHERE expected", *_V)
def j3(spark, d):
    s, _, ledger = _three(spark, d)
    return R.blocked(s, ledger).filter("expected").select("doc_id", "entry_id")


@query("op_J4_primary_key", _CORE + "SELECT doc_id, line_no, key FROM a", *_V)
def j4(spark, d):
    s, lines, _ = _three(spark, d)
    return R.keyed_lines(s, lines).select("doc_id", "line_no", "key")


@query("op_J5_exact_pass", _CORE + "SELECT * FROM m1", *_V)
def j5(spark, d):
    s, lines, ledger = _three(spark, d)
    return R.rank_zip(R.keyed_lines(s, lines), R.blocked(s, ledger), ["doc_id", "key", "amount_cents"])


@query("op_J6_reference_pass", _CORE + "SELECT doc_id, line_no, entry_id FROM m2", *_V)
def j6(spark, d):
    return R.settled(*_three(spark, d)).filter("pass = 'reference'").select("doc_id", "l.line_no", "e.entry_id")


@query("op_J7_fuzzy_candidates", _CORE + "SELECT doc_id, line_no, entry_id, round(score, 9) AS score, inexact, days::INT AS days FROM c3 WHERE score >= 0.6", *_V)
def j7(spark, d):
    return R.open_candidates(R.settled(*_three(spark, d))).select("doc_id", "line_no", "entry_id", F.round("score", 9).alias("score"), "inexact", "days")


@query("op_J8_greedy_assignment", _CORE + "SELECT doc_id, p.line_no AS line_no, p.entry_id AS entry_id FROM m3", *_V)
def j8(spark, d):
    return R.greedy(R.open_candidates(R.settled(*_three(spark, d)))).select("doc_id", "line_no", "entry_id")


for _id, _slug, _type in (("J9", "duplicates", "duplicate"), ("J10", "missing_from_ledger", "missing_from_ledger"), ("J11", "missing_from_statement", "missing_from_statement")):

    @query(f"op_{_id}_{_slug}", _CORE + f"SELECT doc_id, line_no, entry_id, dollar_impact_cents FROM e WHERE exception_type = '{_type}'", *_V)
    def _one(spark, d, t=_type):
        return R.reconcile(*_three(spark, d))[1].filter(F.col("exception_type") == t).select("doc_id", "line_no", "entry_id", "dollar_impact_cents")


@query("op_J12_match_classification", _CORE + "SELECT exception_type, count(*) AS n FROM e WHERE line_no IS NOT NULL AND entry_id IS NOT NULL GROUP BY exception_type", *_V)
def j12(spark, d):
    e = R.reconcile(*_three(spark, d))[1]
    return e.filter("line_no IS NOT NULL AND entry_id IS NOT NULL").groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))


@query("op_J13_impact_signs", _CORE + "SELECT exception_type, sum(dollar_impact_cents)::BIGINT AS impact, sum(memo_amount_cents)::BIGINT AS memo FROM e GROUP BY exception_type", *_V)
def j13(spark, d):
    e = R.reconcile(*_three(spark, d))[1]
    return e.groupBy("exception_type").agg(F.sum("dollar_impact_cents").alias("impact"), F.sum("memo_amount_cents").alias("memo"))


@query("op_J14_exception_ids", _CORE + "SELECT exception_id FROM e", *_V)
def j14(spark, d):
    return R.reconcile(*_three(spark, d))[1].select("exception_id")




_DET = """, d AS (SELECT DISTINCT i.discrepancy_id, e.exception_id, e.exception_type, i.dollar_impact_cents AS injected_cents
  FROM injections i LEFT JOIN statement_lines t ON t.doc_id = i.doc_id AND t.source_entry_id = i.entry_id
  JOIN e ON e.doc_id = i.doc_id AND e.exception_type = i.expected_exception AND (e.line_no = t.line_no OR e.entry_id = i.entry_id))
"""


@query("op_J18_detection_match", _CORE + _DET + "SELECT discrepancy_id, exception_id FROM d", *_V, "injections")
def j18(spark, d):
    e = table(R.reconcile(*_three(spark, d))[1], "exceptions")
    return E.detections(e, load(spark, d, "injections"), load(spark, d, "statement_lines")).select("discrepancy_id", "exception_id")


_CELLS = """
SELECT coalesce(i.t, x.t) AS exception_type, coalesce(injected, 0) AS injected, coalesce(injected_cents, 0) AS injected_cents, coalesce(detected_true, 0) AS detected_true,
  coalesce(detected_false, 0) AS detected_false, coalesce(caught_cents, 0) AS caught_cents
FROM (SELECT expected_exception AS t, count(*) AS injected, sum(abs(dollar_impact_cents))::BIGINT AS injected_cents FROM injections GROUP BY 1) i
FULL JOIN (SELECT exception_type AS t, count(*) FILTER (exception_id IN (SELECT exception_id FROM d)) AS detected_true,
    count(*) FILTER (exception_id NOT IN (SELECT exception_id FROM d)) AS detected_false FROM e GROUP BY 1) x ON i.t = x.t
LEFT JOIN (SELECT exception_type AS t, sum(abs(injected_cents))::BIGINT AS caught_cents FROM (SELECT DISTINCT discrepancy_id, exception_type, injected_cents FROM d) GROUP BY 1) c ON c.t = x.t
"""


@query("op_A5_recon_cells", _CORE + _DET + _CELLS, *_V, "injections")
def a5(spark, d):
    return E.score_recon(table(R.reconcile(*_three(spark, d))[1], "exceptions"), load(spark, d, "injections"), load(spark, d, "statement_lines"))




@query("op_J7b_amount_similarity", "SELECT entry_id, CASE WHEN s = amount_cents THEN 1.0::DOUBLE WHEN abs(s - amount_cents) * 100 <= abs(amount_cents) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT *, amount_cents + (l_partkey % 3) * 900 AS s FROM ledger) x", "ledger")
def j7b(spark, d):
    x = load(spark, d, "ledger").withColumn("s", F.col("amount_cents") + F.col("l_partkey") % 3 * 900)
    return x.select("entry_id", S.amount_score("s", "amount_cents").alias("score"))


@query("op_J7c_date_similarity", "SELECT entry_id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - (l_partkey % 60) / 45.0::DOUBLE), 9) AS score FROM ledger", "ledger")
def j7c(spark, d):
    x = load(spark, d, "ledger")
    return x.select("entry_id", F.round(S.date_score("post_date", F.date_add("post_date", (F.col("l_partkey") % 60).cast("int"))), 9).alias("score"))
