"""Queries over the remaining operators, with the SQL for the same rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.operators import calibration as C
from statera.operators import generate as N
from statera.operators import reconcile as R
from statera.operators import review as V
from statera.plans import review_queries as Q
from statera.plans.base import book
from statera.plans.views import load
from statera.scratch import scratch_dir, table
from statera.sources import files as X
from statera.sources.workbooks import workbook

QUERIES, ORACLE_SQL, query = book()


def to_xlsx(lines):
    """doc_id, content: one workbook per statement with captions stacked over two rows."""
    rows = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "invoice_number", F.col("line_date").cast("string").alias("day"), S.format_cents("amount_cents").alias("amount")))).alias("rows"))

    def run(batches):
        for batch in batches:
            books = []
            for r in batch.column(1):
                body = [[x["invoice_number"] or "", x["day"], x["amount"]] for x in r.as_py()]
                books.append(workbook([["Account"], ["Invoice", "Post", "Net"], ["Number", "Date", "Amount"], *body, ["TOTALS", "", "0"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books, pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id string, content binary")


@query("op_S6_xlsx_reader", "SELECT doc_id, line_no, 'line_date' AS name, line_date::VARCHAR AS value FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_amount', (amount_cents // 100)::VARCHAR || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') FROM statement_lines", "statement_lines")
def s6(spark, d):
    rows = X.sheets(to_xlsx(load(spark, d, "statement_lines")), "xlsx")
    return X.line_fields(rows, stacked=True).filter("family <> 'reference'").select("doc_id", "line_no", "name", "value")


@query("op_S6b_stacked_header", "SELECT DISTINCT doc_id, 2 AS header_row FROM statement_lines", "statement_lines")
def s6b(spark, d):
    return X.headers(X.sheets(to_xlsx(load(spark, d, "statement_lines")), "xlsx"), stacked=True).select("doc_id", "header_row")


@query("op_R18_xlsx_rows", "SELECT doc_id, count(*) + 4 AS n FROM statement_lines GROUP BY 1", "statement_lines")
def r18(spark, d):
    return X.cell_rows(to_xlsx(load(spark, d, "statement_lines")), "xlsx").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("op_S3_zip_test", "SELECT DISTINCT doc_id AS path, 'xlsx' AS route, NULL::VARCHAR AS error FROM statement_lines", "statement_lines")
def s3(spark, d):
    return X.route(to_xlsx(load(spark, d, "statement_lines")).withColumnRenamed("doc_id", "path"))


@query("op_S5a_encoding", "SELECT p_partkey, p_name || 'é' AS text FROM part")
def s5a(spark, d):
    """The same caption in UTF-8 with a mark and in cp1252, read alike."""
    even = F.col("p_partkey") % 2 == 0
    body = F.when(even, F.concat(F.lit(b"\xef\xbb\xbf"), F.col("p_name").cast("binary"), F.lit("é".encode()))).otherwise(F.concat(F.col("p_name").cast("binary"), F.lit("é".encode("cp1252"))))
    rows = X.cell_rows(X.dealt(load(spark, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").cast("string").alias("doc_id"), body.alias("content")))
    return rows.groupBy("doc_id").agg(F.array_join(F.flatten(F.collect_list("cells")), ",").alias("text")).select(F.col("doc_id").cast("bigint").alias("p_partkey"), "text")


QUERIES["op_S5b_bom_strip"], ORACLE_SQL["op_S5b_bom_strip"] = QUERIES["op_S5a_encoding"], ORACLE_SQL["op_S5a_encoding"]


@query("op_S5c_delimiter_sniff", "SELECT p_partkey::VARCHAR AS doc_id, 3 AS cells FROM part")
def s5c(spark, d):
    mark = F.element_at(F.array(F.lit(","), F.lit("|"), F.lit("\t")), (F.col("p_partkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("a"), mark, F.lit("b"), mark, F.lit("c\n"))
    rows = X.cell_rows(X.dealt(load(spark, d, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("doc_id"), F.repeat(line, F.lit(3)).cast("binary").alias("content")))
    return rows.filter("row_no = 0").select("doc_id", F.size("cells").alias("cells"))


@query("op_S5e_column_map", "SELECT DISTINCT doc_id, 'invoice_number,line_date,line_amount' AS names FROM statement_lines", "statement_lines")
def s5e(spark, d):
    return X.headers(X.sheets(X.to_csv(load(spark, d, "statement_lines")))).select("doc_id", F.array_join("names", ",").alias("names"))


@query("op_S19_guarded_extract", "SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'truncated' END AS error FROM part")
def s19(spark, d):
    """Damaged workbooks end as rows with an error, and the others go on."""
    good = workbook([["a"]])
    i = F.col("p_partkey") % 3
    body = F.when(i == 0, F.lit(b"")).when(i == 1, F.lit(b"PK\x03\x04 no archive")).otherwise(F.lit(good))
    return X.cell_rows(load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), body.alias("content")), "xlsx").select("doc_id", "error")


@query("op_S11_json_sink", "SELECT schedule, count(*) AS n FROM ledger GROUP BY 1", "ledger")
def s11(spark, d):
    path = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    load(spark, d, "ledger").select("schedule", "entry_id").write.json(path)
    return spark.read.schema("schedule string, entry_id string").json(path).groupBy("schedule").agg(F.count(F.lit(1)).alias("n"))


@query("op_J7a_reference_similarity", "SELECT entry_id, (damerau_levenshtein(invoice_number, b) <= 1)::INT::DOUBLE AS score FROM (SELECT entry_id, invoice_number, CASE l_partkey % 3 WHEN 0 THEN invoice_number WHEN 1 THEN 'Z' || substr(invoice_number, 2, 20) ELSE 'ZZ' || substr(invoice_number, 3, 20) END AS b FROM ledger) x", "ledger")
def j7a(spark, d):
    x = load(spark, d, "ledger").withColumn("doc_type", F.lit("parts_statement"))
    b = F.when(F.col("l_partkey") % 3 == 0, F.col("invoice_number")).when(F.col("l_partkey") % 3 == 1, F.expr("concat('Z', substr(invoice_number, 2, 20))")).otherwise(F.expr("concat('ZZ', substr(invoice_number, 3, 20))"))
    x = x.withColumn("a_refs", R.primary_references()).withColumn("invoice_number", b).withColumn("b_refs", R.primary_references())
    return x.select("entry_id", R.reference_score().alias("score"))


@query("op_J7d_total_score", "SELECT entry_id, round(0.5::DOUBLE * (damerau_levenshtein(invoice_number, b) <= 1)::INT + 0.35::DOUBLE * CASE WHEN s = amount_cents THEN 1.0::DOUBLE WHEN abs(s - amount_cents) * 100 <= abs(amount_cents) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (l_partkey % 60) / 45.0::DOUBLE), 9) AS score FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN invoice_number WHEN 1 THEN 'Z' || substr(invoice_number, 2, 20) ELSE 'ZZ' || substr(invoice_number, 3, 20) END AS b, amount_cents + (l_partkey % 5) * 900 AS s FROM ledger) x", "ledger")
def j7d(spark, d):
    x = load(spark, d, "ledger").withColumn("doc_type", F.lit("parts_statement")).withColumn("a_refs", R.primary_references())
    b = F.when(F.col("l_partkey") % 3 == 0, F.col("invoice_number")).when(F.col("l_partkey") % 3 == 1, F.expr("concat('Z', substr(invoice_number, 2, 20))")).otherwise(F.expr("concat('ZZ', substr(invoice_number, 3, 20))"))
    x = x.withColumn("invoice_number", b).withColumn("b_refs", R.primary_references())
    x = x.withColumn("s", F.col("amount_cents") + F.col("l_partkey") % 5 * 900).withColumn("day", F.date_add("post_date", (F.col("l_partkey") % 60).cast("int")))
    return x.select("entry_id", F.round(R.total_score("s", "amount_cents", "post_date", "day"), 9).alias("score"))


@query("op_W2_rank_pairing", "SELECT a.entry_id AS x, b.entry_id AS y FROM (SELECT *, row_number() OVER (PARTITION BY dealer_id, post_date ORDER BY entry_pos) AS i FROM ledger WHERE l_orderkey % 2 = 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY dealer_id, post_date ORDER BY entry_pos) AS i FROM ledger WHERE l_orderkey % 2 = 1) b USING (dealer_id, post_date, i)", "ledger")
def w2(spark, d):
    x = load(spark, d, "ledger").select(F.col("dealer_id").alias("doc_id"), F.col("post_date").cast("string").alias("key"), "entry_pos", "entry_id", "l_orderkey")
    lines, entries = x.filter("l_orderkey % 2 = 0"), x.filter("l_orderkey % 2 = 1")
    pairs = R.rank_zip(lines.withColumn("line_no", F.col("entry_pos")).drop("entry_id"), entries, ["doc_id", "key"])
    return pairs.join(lines.select(F.col("entry_pos").alias("line_no"), F.col("entry_id").alias("x")), "line_no").select("x", F.col("entry_id").alias("y"))


QUERIES["op_W6_equal_count_bins"], ORACLE_SQL["op_W6_equal_count_bins"] = Q.QUERIES["op_A7_reliability_bins"], Q.ORACLE_SQL["op_A7_reliability_bins"]


@query("op_W11_page_bounds", "SELECT field_id FROM (SELECT * FROM samples ORDER BY confidence, field_id LIMIT 500) q", "samples")
def w11(spark, d):
    return V.page(load(spark, d, "samples"), ["confidence", "field_id"], 500, 0).select("field_id")


@query("op_U10_accept", "SELECT field_id, CASE WHEN max(seq) % 2 = 0 THEN 'human_accepted' ELSE 'needs_review' END AS status FROM corrections GROUP BY 1", "corrections")
def u10(spark, d):
    """The newest decision of the log is the status; accepting twice changes nothing."""
    log = load(spark, d, "corrections").withColumn("status", F.when(F.col("seq") % 2 == 0, "human_accepted").otherwise("needs_review"))
    return V.latest(log.unionByName(log), "field_id", "status", "seq")


@query("op_U11_resolve", "SELECT field_id AS exception_id, arg_max(new_value, seq) AS resolution FROM corrections GROUP BY 1", "corrections")
def u11(spark, d):
    log = load(spark, d, "corrections").select(F.col("field_id").alias("exception_id"), F.col("new_value").alias("resolution"), "seq")
    return V.latest(log, "exception_id", "resolution", "seq")


QUERIES["op_M1d_residual_suspect"], ORACLE_SQL["op_M1d_residual_suspect"] = Q.QUERIES["op_A17_residual_suspect"], Q.ORACLE_SQL["op_A17_residual_suspect"]
QUERIES["op_M1e_date_window_centre"], ORACLE_SQL["op_M1e_date_window_centre"] = Q.QUERIES["op_A16_other_median_date"], Q.ORACLE_SQL["op_A16_other_median_date"]
QUERIES["op_M10_reliability_section"], ORACLE_SQL["op_M10_reliability_section"] = Q.QUERIES["op_A8_calibration_error"], Q.ORACLE_SQL["op_A8_calibration_error"]


@query("op_R9_document_fields", "SELECT field_id FROM fields WHERE doc_id LIKE 'D1-%' ORDER BY field_id", "fields")
def r9(spark, d):
    return load(spark, d, "fields").filter("doc_id LIKE 'D1-%'").select("field_id").orderBy("field_id")


@query("op_R12_crop_kind_upsert", "SELECT field_id, CASE WHEN l_partkey % 2 = 0 THEN 'row_band' ELSE 'full_page' END AS kind FROM fields", "fields")
def r12(spark, d):
    f = load(spark, d, "fields")
    return V.upsert(f.select("field_id", F.lit("full_page").alias("kind")), f.filter("l_partkey % 2 = 0").select("field_id", F.lit("row_band").alias("kind")), ["field_id"])


@query("op_R15_sweep_order", "SELECT round(threshold, 9) AS threshold, row_number() OVER (ORDER BY threshold) - 1 AS ordinal FROM (SELECT DISTINCT confidence AS threshold FROM samples WHERE family = 'date' AND split = 'test') x", "samples")
def r15(spark, d):
    """The order a sweep is drawn in, kept as a column: one curve has at most as many points as distinct thresholds."""
    x = load(spark, d, "samples").filter("family = 'date' AND split = 'test'").select("family", F.col("confidence").alias("threshold")).distinct()
    return x.select(F.round("threshold", 9).alias("threshold"), (F.row_number().over(Window.partitionBy("family").orderBy("threshold")).cast("bigint") - 1).alias("ordinal"))


_UNIT = f"((('0x' || substr(md5('{N.SEED}:amount:' || entry_id), 1, 12))::BIGINT % 1099511627776 + 0.5) / 1099511627776.0::DOUBLE)"
_DRAWS = " ".join(f"WHEN '{kind}' THEN {low} + floor({f'pow({_UNIT}, 3)' if kind == 'warranty_receivable' else _UNIT} * {high - low})::BIGINT" for kind, (low, high) in N.AMOUNTS.items())


@query("op_R25_amount_draw", f"SELECT entry_id, CASE schedule {_DRAWS} END AS cents FROM ledger", "ledger")
def r25(spark, d):
    return load(spark, d, "ledger").select("entry_id", N.draw_amount("entry_id").alias("cents"))
