"""Queries over generated ledgers, statements and discrepancies. Digest draws are spelt out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.constants import OEMS, SCHEDULES
from statera.operators import generate as N
from statera.operators import metrics as E
from statera.operators import reconcile as R
from statera.plans.base import book
from statera.plans.views import load
from statera.scratch import table

QUERIES, ORACLE_SQL, query = book()


def _draw(key: str, salt: str, n: str) -> str:
    return f"(('0x' || substr(md5('42:{salt}:' || {key}), 1, 12))::BIGINT % {n})"


_OEMS, _KINDS = list(OEMS), list(SCHEDULES.values())
_CELL = "dealer_id || ':' || schedule || ':' || strftime(month, '%Y%m')"
_AMOUNT = "CASE schedule " + " ".join(f"WHEN '{k}' THEN {lo} + floor({'pow(u, 3)' if k == 'warranty_receivable' else 'u'} * {hi - lo})" for k, (lo, hi) in N.AMOUNTS.items()) + " END"
_LEDGER = f"""
SELECT entry_id, dealer_id, oem, schedule, month + {_draw("entry_id", "day", "day(last_day(month))")}::INT AS post_date, ({_AMOUNT})::BIGINT AS amount_cents
FROM (SELECT *, ({_draw("entry_id", "amount", "1099511627776")} + 0.5::DOUBLE) / 1099511627776.0::DOUBLE AS u FROM (
  SELECT *, 'led-' || schedule || '-' || dealer_id || '-' || strftime(month, '%Y%m') || '-' || lpad(i::VARCHAR, 5, '0') AS entry_id FROM (
    SELECT *, unnest(range(1, 25 - {_draw(_CELL, "count", "12")})) AS i FROM (
      SELECT *, unnest([DATE '2025-01-01', DATE '2025-02-01', DATE '2025-03-01', DATE '2025-04-01']) AS month FROM (
        SELECT *, unnest({_KINDS}) AS schedule FROM (SELECT 'dlr-' || lpad(s_suppkey::VARCHAR, 5, '0') AS dealer_id, ({_OEMS})[s_suppkey % 4 + 1] AS oem FROM supplier) d) s) m) c) e) x
"""


def _made(spark, d):
    """A ledger with as many dealers as there are suppliers."""
    n = load(spark, d, "supplier").count()
    return N.ledger(spark, dealers=n)


@query("op_G1_ledger_generator", _LEDGER)
def g1(spark, d):
    return _made(spark, d).select("entry_id", "dealer_id", "oem", "schedule", "post_date", "amount_cents")


@query("op_F28_expand_pattern", "SELECT entry_id, 'M' || " + " || ".join(_draw("entry_id", f"invoice_number:1:{i}", "10") + "::VARCHAR" for i in range(7)) + f" AS invoice_number FROM ({_LEDGER}) l WHERE oem = 'meridian' AND schedule = 'parts_payable'")
def f28(spark, d):
    return _made(spark, d).filter("oem = 'meridian' AND schedule = 'parts_payable'").select("entry_id", "invoice_number")


_V, _W = "0123456789ABCDEFGHJKLMNPRSTUVWXYZ", (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
_VALUES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9)
_SUM = " + ".join(f"list_extract({list(_VALUES)}, instr('{_V}', substr(vin, {i + 1}, 1))) * {w}" for i, w in enumerate(_W) if w)


@query("op_G2_vin_maker", f"SELECT entry_id, substr(vin, 1, 8) || CASE r WHEN 10 THEN 'X' ELSE r::VARCHAR END || substr(vin, 10, 8) AS vin FROM (SELECT entry_id, vin, ({_SUM}) % 11 AS r FROM ledger) l", "ledger")
def g2(spark, d):
    """Every VIN of the ledger with the check digit that makes it valid."""
    return load(spark, d, "ledger").select("entry_id", N.with_check_digit("vin").alias("vin"))


_COMPOSED = f"""g AS MATERIALIZED ({_LEDGER}),
ln AS MATERIALIZED (SELECT 'doc-' || dealer_id || '-' || schedule || '-' || strftime(post_date, '%Y%m') AS doc_id, row_number() OVER (PARTITION BY dealer_id, schedule, strftime(post_date, '%Y%m') ORDER BY post_date, entry_id) AS line_no, * FROM g)"""


@query("op_G3_statement_composer", f"WITH {_COMPOSED} SELECT doc_id, max(line_no)::INT AS lines, sum(amount_cents)::BIGINT AS total_cents, date_trunc('month', min(post_date))::DATE AS period_start, last_day(max(post_date)) AS period_end, arg_min(entry_id, line_no) AS first_entry FROM ln GROUP BY 1")
def g3(spark, d):
    heads, lines = N.compose(_made(spark, d))
    shape = lines.groupBy("doc_id").agg(F.max("line_no").alias("lines"), F.min_by("source_entry_id", "line_no").alias("first_entry"))
    return heads.join(shape, "doc_id").select("doc_id", "lines", "total_cents", "period_start", "period_end", "first_entry")


@query("op_G4_statement_number", f"WITH {_COMPOSED} SELECT doc_id, upper(substr(oem, 1, 1)) || '-' || right(dealer_id, 5) || '-' || lpad((row_number() OVER (PARTITION BY dealer_id ORDER BY doc_id))::VARCHAR, 4, '0') AS statement_number FROM (SELECT DISTINCT doc_id, dealer_id, oem FROM ln) s")
def g4(spark, d):
    return N.numbered(N.compose(_made(spark, d))[0]).select("doc_id", "statement_number")


def _hurt(spark, d):
    """ledger, statements, lines and injections, each written: what reads them plans over a scan and not over every draw again."""
    made = table(_made(spark, d), "made")
    heads, lines = N.compose(made)
    heads, lines, injections = N.inject(table(heads, "composed"), table(lines, "composed-lines"))
    return made, table(heads, "hurt"), lines, table(injections, "injections")


@query("op_G5_injections")
def g5(spark, d):
    """The discrepancies put in, each with whether the reconciliation finds it. Tests hold totals, numbers and counts."""
    ledger, heads, lines, injections = _hurt(spark, d)
    found = R.reconcile(heads, lines, ledger)[1]
    hits = E.detections(found, injections).select("discrepancy_id").distinct().withColumn("found", F.lit(True))
    return injections.join(hits, "discrepancy_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("op_G6_dataset_plan", f"WITH {_COMPOSED} SELECT DISTINCT doc_id, {_draw('doc_id', 'inject', '100')} < 65 AS injected FROM ln")
def g6(spark, d):
    """The documents that get discrepancies: at least one kind is open to every statement."""
    heads, lines = N.compose(_made(spark, d))
    hurt = N.chosen_kinds(heads, lines).select("doc_id").distinct().withColumn("injected", F.lit(True))
    return heads.select("doc_id").join(hurt, "doc_id", "left").withColumn("injected", F.coalesce("injected", F.lit(False)))


@query("op_R26_sole_source", "SELECT doc_id, line_no, coalesce(count(source_entry_id) OVER (PARTITION BY doc_id, source_entry_id) = 1, false) AS sole FROM statement_lines", "statement_lines")
def r26(spark, d):
    return N.sole_sources(load(spark, d, "statement_lines")).select("doc_id", "line_no", "sole")


@query("op_G7_rendered_values", "SELECT doc_id, line_no || ':invoice_number' AS key, invoice_number AS text FROM statement_lines WHERE invoice_number IS NOT NULL UNION ALL SELECT doc_id, line_no || ':line_date', strftime(line_date, '%m/%d/%Y') FROM statement_lines UNION ALL SELECT doc_id, line_no || ':line_amount', '$' || regexp_replace((amount_cents // 100)::VARCHAR, '^(\\d{1,3})(\\d{3})$', '\\1,\\2') || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') FROM statement_lines", "statement_lines")
def g7(spark, d):
    lines = load(spark, d, "statement_lines").withColumn("description", F.lit(None).cast("string")).withColumns({c: F.lit(None).cast("string") for c in ("claim_number", "ro_number", "vin", "program_code")})
    return N.printed_values(lines)


_QUOTAS = """
RECURSIVE st AS (SELECT doc_type, tier, count(*) AS n, row_number() OVER (ORDER BY doc_type, tier) AS i FROM manifest GROUP BY 1, 2),
rc AS (
  SELECT 0::BIGINT AS i, 0::DOUBLE AS ct, 0::DOUBLE AS cc, 0::DOUBLE AS ce, 0::BIGINT AS qt, 0::BIGINT AS qc
  UNION ALL
  SELECT i, et - qt, ec - qc, ee - qe, qt, qc FROM (
    SELECT i, et, ec, ee, (ft + list_contains(w, 't')::INT)::BIGINT AS qt, (fc + list_contains(w, 'c')::INT)::BIGINT AS qc, (fe + list_contains(w, 'e')::INT)::BIGINT AS qe FROM (
      SELECT *, list_transform(list_sort([{'d': ft - et, 't': 0, 's': 't'}, {'d': fc - ec, 't': -1, 's': 'c'}, {'d': fe - ee, 't': -2, 's': 'e'}])[1:greatest(n - ft - fc - fe, 0)::BIGINT], lambda x: x.s) AS w FROM (
        SELECT *, greatest(floor(et), 0) AS ft, greatest(floor(ec), 0) AS fc, greatest(floor(ee), 0) AS fe FROM (
          SELECT st.i, n, n * 0.5::DOUBLE + ct AS et, n * 0.25::DOUBLE + cc AS ec, n * 0.25::DOUBLE + ce AS ee FROM rc JOIN st ON st.i = rc.i + 1) x) y) z) q)
SELECT doc_id, doc_type, tier, CASE WHEN rn <= qt THEN 'train' WHEN rn <= qt + qc THEN 'calibration' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY doc_type, tier ORDER BY md5(doc_id), doc_id) AS rn FROM manifest) m JOIN st USING (doc_type, tier) JOIN rc ON rc.i = st.i
"""


@query("op_W14_split_quotas", "WITH " + _QUOTAS.strip(), "manifest")
def w14(spark, d):
    """50/25/25 a stratum, the remainders carried on from stratum to stratum."""
    return N.assign_splits(load(spark, d, "manifest").select("doc_id", "doc_type", "tier"), ["doc_type", "tier"])


_SLOTS = "SELECT doc_type, unnest(range(n + 5)) AS slot, 'csv' AS tier FROM (SELECT doc_type, count(*) AS n FROM heads2 GROUP BY 1) t"


@query(
    "op_W15_reuse_numbering",
    f"""WITH {_COMPOSED}, heads2 AS MATERIALIZED (SELECT DISTINCT doc_id, oem, CASE schedule {' '.join(f"WHEN '{s}' THEN '{t}'" for t, s in SCHEDULES.items())} END AS doc_type FROM ln),
    tn AS (SELECT *, row_number() OVER (PARTITION BY doc_type, oem ORDER BY md5(doc_id), doc_id) AS rn FROM heads2),
    po AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY rn, oem) - 1 AS place, count(*) OVER (PARTITION BY doc_type) AS pool FROM tn),
    sl AS ({_SLOTS})
    SELECT sl.doc_type, slot, doc_id AS base_id, slot // pool + 1 AS occurrence, CASE WHEN slot // pool = 0 THEN doc_id ELSE doc_id || '-' || lpad((slot // pool + 1)::VARCHAR, 2, '0') END AS doc_id
    FROM sl JOIN po ON po.doc_type = sl.doc_type AND po.place = slot % pool""",
)
def w15(spark, d):
    heads = table(N.compose(_made(spark, d))[0], "composed")
    slots = heads.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")).select("doc_type", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + 4)).alias("slot"), F.lit("csv").alias("tier"))
    return N.plan_documents(heads, slots).drop("tier")


@query("op_R27_dataset")
def r27(spark, d):
    """The whole orchestration: the manifest of a planned, hurt and split set. Tests reconcile it."""
    mix = {(t, tier): 25 for t in SCHEDULES for tier in ("clean_digital", "scan_light", "scan_heavy", "csv", "xlsx")}
    return N.dataset(spark, mix, dealers=load(spark, d, "supplier").count(), months=2)["manifest"]


@query("op_R28_stray_total_row", f"SELECT doc_id, {_draw('doc_id', 'stray', 'greatest(n - 1, 1)')} + 1 AS after FROM (SELECT doc_id, count(*) AS n FROM statement_lines GROUP BY 1) t", "statement_lines")
def r28(spark, d):
    n = load(spark, d, "statement_lines").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", N.stray_total_row("doc_id", "n").alias("after"))
