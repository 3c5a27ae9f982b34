"""Queries over the review store, with the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from statera.constants import OEMS
from statera.operators import calibration as C
from statera.operators import reviewdb as W
from statera.operators import signals as G
from statera.plans.base import book
from statera.plans.views import load
from statera.scratch import scratch_dir, table

QUERIES, ORACLE_SQL, query = book()
_OEMS = list(OEMS)


@query("op_P6_identity_validity", "SELECT doc_id FROM manifest WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 5 <> 4", "manifest")
def p6(spark, d):
    """Identities as text, some of them missing or unreadable: an unknown marque, a day that isn't one."""
    m = load(spark, d, "manifest")
    oem = F.when(F.col("k") % 5 == 4, "unknown").otherwise(F.element_at(F.array(*map(F.lit, _OEMS)), (F.col("k") % 4 + 1).cast("int")))
    start = F.when(F.col("k") % 11 == 0, "2024-02-30").otherwise(F.col("period_start").cast("string"))
    rows = m.withColumn("oem", oem).withColumn("period_start", start).withColumn("period_end", F.when(F.col("k") % 13 != 0, F.col("period_end").cast("string"))).withColumn("dealer_id", F.when(F.col("k") % 7 != 0, F.col("dealer_id")))
    return W.reconcilable(rows).select("doc_id")


def _stored(spark, d):
    """Half of the documents were extracted; the others are files: empty, delimited, or neither."""
    m = load(spark, d, "manifest")
    extraction = m.filter("k % 2 = 0").select("doc_id", "route", F.lit(None).cast("string").alias("error"), F.when(F.col("k") % 4 == 0, "parts_statement").alias("doc_type"))
    body = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "number,date,amount,text\n1,2,3,4\n").otherwise("no marks here")
    files = m.select(F.col("doc_id").alias("path"), body.cast("binary").alias("content"))
    return m, extraction, files


_ROUTED = "CASE WHEN k % 2 = 0 THEN route WHEN k % 3 = 1 THEN 'csv' ELSE 'unprocessable' END AS route, CASE WHEN k % 2 = 0 THEN NULL WHEN k % 3 = 0 THEN 'empty' WHEN k % 3 = 2 THEN 'unrecognized' END AS error"


@query("op_P10_routing_fallback", f"SELECT doc_id, {_ROUTED} FROM manifest", "manifest")
def p10(spark, d):
    m, extraction, files = _stored(spark, d)
    return W.routed(m.drop("route"), extraction, files).select("doc_id", "route", "error")


@query("op_R7_document_rows", f"SELECT doc_id, CASE WHEN k % 4 = 0 THEN 'parts_statement' ELSE doc_type END AS doc_type, tier, {_ROUTED}, split, dealer_id, period_start, period_end FROM manifest", "manifest")
def r7(spark, d):
    m, extraction, files = _stored(spark, d)
    return W.document_rows(m.drop("route"), extraction, files)


def _decided(spark, d):
    """Findings, decisions on half of them of which a third are about other amounts, and stored rows of some documents."""
    e = load(spark, d, "injections").select(F.col("discrepancy_id").alias("exception_id"), "doc_id", "dollar_impact_cents", F.col("dollar_impact_cents").alias("statement_amount_cents"), F.lit(None).cast("bigint").alias("ledger_amount_cents"))
    some = e.filter("dollar_impact_cents % 2 = 0").withColumn("resolution", F.lit("paid"))
    some = some.withColumn("statement_amount_cents", F.when(F.col("dollar_impact_cents") % 6 == 0, F.col("statement_amount_cents") + 1).otherwise(F.col("statement_amount_cents")))
    old = load(spark, d, "manifest").filter("k % 3 = 0").select("doc_id", F.concat(F.lit("run-"), F.col("k").cast("string")).alias("run_id"))
    return W.exception_rows(e, some, old)


@query("op_R10_exception_row", "SELECT discrepancy_id AS exception_id, CASE WHEN dollar_impact_cents % 2 = 0 AND dollar_impact_cents % 6 <> 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN dollar_impact_cents % 2 = 0 AND dollar_impact_cents % 6 <> 0 THEN 'paid' END AS resolution FROM injections", "injections")
def r10(spark, d):
    return _decided(spark, d).select("exception_id", "status", "resolution")


@query("op_R8_run_id", "SELECT discrepancy_id AS exception_id, CASE WHEN k % 3 = 0 THEN 'run-' || k ELSE 'review' END AS run_id FROM injections JOIN manifest USING (doc_id)", "injections", "manifest")
def r8(spark, d):
    return _decided(spark, d).select("exception_id", "run_id")


@query("op_P13_assembly_with_truth", "SELECT h.doc_id, CASE WHEN k % 23 = 0 THEN 'x' ELSE '' END || statement_number AS statement_number, statement_date FROM heads h", "heads")
def p13(spark, d):
    """Number and date as read from the fields; truth's date where the field is missing or doesn't parse."""
    x = G.typed(load(spark, d, "extracted")).filter("line_no IS NULL")
    read = x.groupBy("doc_id").agg(F.max(F.when(F.col("name") == "statement_number", F.col("value"))).alias("statement_number"), F.max(F.when(F.col("name") == "statement_date", F.col("value_date"))).alias("statement_date"))
    return W.with_truth_numbers(read, load(spark, d, "heads"))


_VISION = "l_partkey % 2 = 0"
_BOXED = "l_partkey % 7 <> 0"


@query("op_R11_crop_source", f"SELECT field_id, CASE WHEN l_partkey % 3 = 0 AND {_BOXED} THEN 0.25::DOUBLE END AS box, CASE WHEN {_VISION} THEN f.line_no END AS row_position, CASE WHEN {_VISION} THEN e.rows END AS expected_rows, CASE WHEN {_VISION} AND {_BOXED} THEN 0.25::DOUBLE END AS hint FROM fields f LEFT JOIN (SELECT doc_id, CASE WHEN count(DISTINCT line_no) = max(line_no) THEN max(line_no) END AS rows FROM fields WHERE {_VISION} GROUP BY 1) e USING (doc_id)", "fields")
def r11(spark, d):
    f = load(spark, d, "fields").withColumn("source", F.when(F.col("l_partkey") % 2 == 0, "llm_vision").otherwise("deterministic")).withColumn("crop_kind", F.when(F.col("l_partkey") % 3 == 0, "exact_bbox").otherwise("row_band"))
    f = f.withColumn("page", F.lit(1)).withColumns({c: F.lit(v) for c, v in (("y0", 0.1), ("x1", 0.5), ("y1", 0.2))}).withColumn("x0", F.when(F.col("l_partkey") % 7 != 0, F.lit(0.25)))
    out = W.crop_sources(f)
    return out.select("field_id", F.col("bbox.x0").alias("box"), "row_position", "expected_rows", F.col("hint.x0").alias("hint"))


@query("op_S8c_bbox_sanity", "SELECT p_partkey, p_size <= 32 AND p_size BETWEEN 1.5 AND 200 AS ok FROM part")
def s8c(spark, d):
    """Boxes a 32nd of the page high, and p_size of these wide."""
    wide = F.col("p_size") * F.lit(0.03125)
    return load(spark, d, "part").select("p_partkey", W.plausible_box(F.lit(0.0), F.lit(0.46875), wide, F.lit(0.5)).alias("ok"))


@query("op_R14_review_detail", "SELECT f.field_id, f.name, f.raw_text, m.tier, f.self_consistency, coalesce(string_agg(o.name || '=' || o.raw_text, ',' ORDER BY o.name, o.raw_text, o.field_id), '') AS neighbours FROM extracted f JOIN manifest m ON m.doc_id = f.doc_id LEFT JOIN extracted o ON o.doc_id = f.doc_id AND o.line_no = f.line_no AND o.field_id <> f.field_id WHERE f.name = 'line_amount' GROUP BY 1, 2, 3, 4, 5", "extracted", "manifest")
def r14(spark, d):
    x = G.typed(load(spark, d, "extracted"))
    out = W.asked_detail(x, F.col("name") == "line_amount", load(spark, d, "manifest"), ("self_consistency",))
    beside = F.array_join(F.transform("neighbours", lambda n: F.concat(n["name"], F.lit("="), n["raw_text"])), ",")
    return out.select("field_id", "item.name", "item.raw_text", "document.tier", "signals.self_consistency", beside.alias("neighbours"))


@query("op_R21_provider_pool", "SELECT DISTINCT provider FROM llm_calls WHERE provider IN ('google', 'groq')", "llm_calls")
def r21(spark, d):
    return W.provider_pool(load(spark, d, "llm_calls"), {"google": ("vision", "text"), "groq": ("vision",), "local": ("text",)}, "vision")


@query("op_U13_add_column", "SELECT n_nationkey, NULL::INTEGER AS rank, n_name, NULL::VARCHAR AS note, n_regionkey FROM nation")
def u13(spark, d):
    wanted = StructType([StructField("n_nationkey", IntegerType()), StructField("rank", IntegerType()), StructField("n_name", StringType()), StructField("note", StringType())])
    return W.migrated(W.migrated(load(spark, d, "nation"), wanted), wanted)


_STORED = "WITH c AS (SELECT * FROM samples WHERE split = 'test'), s AS (SELECT DISTINCT family, confidence AS threshold, count(*) OVER (PARTITION BY family) AS n, count(*) OVER w AS accepted, sum(correct::INT) OVER w AS r FROM c WINDOW w AS (PARTITION BY family ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING)), g AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY accepted DESC) AS i FROM s WHERE r::DOUBLE / accepted >= CASE family WHEN 'amount' THEN 0.995 WHEN 'reference' THEN 0.995 WHEN 'date' THEN 0.99 ELSE 0.97 END)"


@query("op_U14_replace_all", _STORED + " SELECT family, round(threshold, 9) AS threshold, accepted, 'run-2' AS run_id FROM g WHERE i = 1", "samples")
def u14(spark, d):
    """A second run's thresholds take the place of all of the first's, whatever families these had."""
    store, s = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", load(spark, d, "samples")
    first = C.choose_thresholds(s.filter("split = 'calibration'"), {f: 0.1 for f in ("amount", "date", "reference", "text")})
    W.replace_thresholds(store, first.unionByName(first.withColumn("family", F.lit("other"))), "run-1")
    W.replace_thresholds(store, C.choose_thresholds(s.filter("split = 'test'")), "run-2")
    return spark.read.parquet(f"{store}/thresholds").select("family", F.round("threshold", 9).alias("threshold"), "accepted", "run_id")


@query("op_T2_batch_order", "SELECT doc_id, count(*) + 3 AS rows, true AS in_order FROM statement_lines GROUP BY 1", "statement_lines")
def t2(spark, d):
    """The batch's rows as they come: each against the one before it, inside a part of the result and across the parts' edges."""
    from statera.sources.files import to_csv

    place = F.struct("doc_id", "row_no")
    out = W.batch(to_csv(load(spark, d, "statement_lines"))).filter(F.size("cells") > 0)
    out = table(out.select("doc_id", "row_no", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("came")), "batch-order")
    last = F.lag(place).over(Window.partitionBy("part").orderBy("came"))
    rows = out.withColumn("ok", F.coalesce(last < place, F.lit(True)))
    edges = out.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    edges = edges.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")) < F.col("first"), F.lit(True)).alias("edge"))  # a row a part
    return rows.join(F.broadcast(edges), "part").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("ok") & F.col("edge")).alias("in_order"))


@query("op_S12_table_sink", "SELECT (SELECT count(*) FROM manifest) AS documents, count(*) AS fields, (SELECT count(*) FROM injections) AS exceptions, count(*) FILTER (CASE WHEN l_partkey % 5 = 0 THEN false ELSE confidence >= 0.5 END) AS auto_accepted FROM samples", "manifest", "samples", "injections")
def s12(spark, d):
    """A store built over an older one: the fields a person accepted there keep that status, so they aren't counted as auto accepted."""
    at = lambda n: f"{scratch_dir(spark)}/{n}-{uuid.uuid4().hex}"
    docs, e, s = load(spark, d, "manifest"), load(spark, d, "injections"), load(spark, d, "samples")
    status = F.when(F.col("confidence") >= 0.5, "auto_accepted").otherwise("needs_review")
    fields = s.select("field_id", "family", "confidence", status.alias("status"))
    human = s.select("field_id", "family", "confidence", F.when(F.col("l_partkey") % 5 == 0, "human_accepted").otherwise("needs_review").alias("status"))
    bars = table(C.choose_thresholds(s.filter("split = 'calibration'")), "thresholds")
    before, now = at("store"), at("store")
    W.build(spark, before, docs, human, e, bars, "run-1")
    return W.build(spark, now, docs, fields, e, bars, "run-2", old=before)
