"""Queries over file and page readers, with the SQL for the same rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.plans.base import book
from statera.plans.views import load
from statera.scratch import scratch_dir, table
from statera.sources import answers as A
from statera.sources import bands as P
from statera.sources import files as X
from statera.sources import pdf as D
from statera.sources import workbooks as B

QUERIES, ORACLE_SQL, query = book()


def _pages_as_files(spark, d):
    """The pages' own bytes, some of them empty, behind a PDF's signature without a trailer, or behind a broken archive's."""
    i = F.col("page_id") % 6
    body = F.when(i == 0, F.lit("")).when(i == 1, F.concat(F.lit("%PDF-1.4 "), "html")).when(i == 2, F.concat(F.lit("PK\x03\x04"), "html")).otherwise(F.col("html"))
    return load(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), body.cast("binary").alias("content"))


@query("op_S1_router")
def s1(spark, d):
    """Routes whole pages by their bytes. The sniff decodes a head cut at a byte, for which SQL has no words; tests hold it."""
    return X.route(_pages_as_files(spark, d))


@query("op_S2_pdf_text_layer", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 4 = 0 THEN 'unprocessable' WHEN page_id % 4 = 1 THEN 'unprocessable' WHEN 2 * length(replace(url, '/', '')) >= 200 THEN 'digital_pdf' WHEN page_id % 4 = 2 AND 12 * length(replace(url, '/', '')) >= 200 THEN 'digital_pdf' ELSE 'scanned_pdf' END AS route, CASE page_id % 4 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'truncated' END AS error FROM pages")
def s2(spark, d):
    """Bytes tell damage, a table of words tells the text layer: here a page of words made of the url, many times over or twice."""
    pages = load(spark, d, "pages")
    i = F.col("page_id") % 4
    body = F.concat(F.lit("%PDF-1.4\n"), F.when(i == 0, "/Encrypt").otherwise(""), "html", F.when(i == 1, "").otherwise("\n%%EOF"))
    files = pages.select(F.col("page_id").cast("string").alias("path"), body.cast("binary").alias("content"))
    shown = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.when(i == 2, 12).otherwise(2).alias("n"), F.translate("url", "/", "").alias("text"))
    words = shown.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    layers = D.text_layer(shown.select("doc_id", "page"), words).withColumnRenamed("doc_id", "path")
    return X.route(files, layers)


@query("op_S4_delimited_sniff")
def s4(spark, d):
    """Whole texts go in; the sniff takes the head it always takes, 8,192 bytes. Tests hold it against a byte-wise version."""
    return load(spark, d, "documents").select("doc_id", X.looks_delimited(F.col("text").cast("binary")).alias("ok"))


def _csv(spark, d):
    return X.sheets(X.to_csv(load(spark, d, "statement_lines")))


_VALUES = "SELECT doc_id, line_no, 'invoice_number' AS name, invoice_number AS raw_text FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_date', line_date::VARCHAR FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_amount', '$' || regexp_replace((amount_cents // 100)::VARCHAR, '^(\\d{1,3})(\\d{3})$', '\\1,\\2') || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') FROM statement_lines"


@query("op_S5f_row_unpivot", _VALUES, "statement_lines")
def s5f(spark, d):
    return X.line_fields(_csv(spark, d)).select("doc_id", "line_no", "name", "raw_text")


@query("op_S14_csv_sink", "SELECT doc_id, count(*) + 3 AS rows, sum(amount_cents)::BIGINT AS cents, 'Total' AS last FROM statement_lines GROUP BY 1", "statement_lines")
def s14(spark, d):
    """Statements written as CSV text and parsed again by Spark's own reader of CSV: rows, amounts, and the total's row."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    X.to_csv(load(spark, d, "statement_lines")).select("doc_id", F.explode(F.split(F.rtrim(F.col("content").cast("string")), "\n")).alias("line")).write.parquet(path)
    lines = spark.read.schema("doc_id string, line string").parquet(path).filter("line <> ''")
    cells = lines.withColumn("c", F.from_csv("line", "a string, b string, c string"))
    cents = F.sum(F.when(~F.col("c.a").isin("Total"), S.amount_cents("c.c"))).alias("cents")
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), cents, F.max(F.when(F.col("c.a") == "Total", F.col("c.a"))).alias("last"))


@query("op_S16_ceilings", f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > {X.MOST_CELL} THEN 'too_large' END AS error, 1::BIGINT AS rows FROM (SELECT doc_id, repeat(replace(replace(replace(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' '), ',', ' '), '|', ' '), '\"', ' '), 4) AS text FROM documents) t")
def s16(spark, d):
    """Texts as files of a single cell, through the reader and its own ceilings: a cell over 64 KiB ends as a row that says too_large."""
    text = F.repeat(F.regexp_replace(F.coalesce("text", F.lit("")), '[\n\r,|"]', " "), F.lit(4))
    files = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.cast("binary").alias("content"))
    return X.cell_rows(files).groupBy("doc_id").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("rows"))


@query("op_S10_json_reader", "SELECT l_orderkey AS k, l_linenumber AS line, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem")
def s10(spark, d):
    """Nested JSON documents, one an order, parsed and exploded again."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.round("l_quantity").cast("bigint").alias("q"))
    x = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").alias("k"), F.collect_list(line).alias("lines"))).alias("j"))
    doc = x.select(F.from_json("j", "k bigint, lines array<struct<line:int,q:bigint>>").alias("d"))
    return doc.select("d.k", F.explode("d.lines").alias("l")).select("k", "l.line", "l.q")


@query("op_S6a_zip_bomb", "SELECT p_partkey::VARCHAR AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'too_large' END AS error FROM part")
def s6a(spark, d):
    """An archive whose members say they inflate beyond the ceiling is not inflated."""
    body = F.when(F.col("p_partkey") % 5 == 0, F.lit(B.bomb())).otherwise(F.lit(B.workbook([["a"]])))
    return X.cell_rows(X.dealt(load(spark, d, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("doc_id"), body.alias("content")), "xlsx").select("doc_id", "error")


@query("op_S6c_cell_text", "SELECT doc_id, line_no, line_date::VARCHAR AS day, '$' || regexp_replace((amount_cents // 100)::VARCHAR, '^(\\d{1,3})(\\d{3})$', '\\1,\\2') || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') AS money, (amount_cents // 100)::VARCHAR AS plain, CASE WHEN line_no % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM statement_lines", "statement_lines")
def s6c(spark, d):
    """Typed cells of workbooks: serial dates, money in a currency format, plain numbers, flags."""
    days = F.datediff("line_date", F.lit("1899-12-30").cast("date"))
    row = F.struct("line_no", days.alias("day"), S.format_cents("amount_cents").alias("money"), F.expr("amount_cents DIV 100").alias("plain"))
    rows = load(spark, d, "statement_lines").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches):
        for batch in batches:
            made = [B.workbook([[(x["day"], 1), (x["money"], 2), (x["plain"], 0), (x["line_no"] % 2 == 0, 0)] for x in r.as_py()]) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    c = lambda i: F.get(F.col("cells"), F.lit(i))
    cells = X.cell_rows(rows.mapInArrow(run, "doc_id string, content binary"), "xlsx")
    return cells.select("doc_id", (F.col("row_no") + 1).alias("line_no"), c(0).alias("day"), c(1).alias("money"), c(2).alias("plain"), c(3).alias("flag"))


def _statement_words(spark, d):
    """Statements as words on a page: labels with values beside or under them, a caption row in which one caption takes two lines and one is
    unknown, and a row a line, a hundred rows a page."""
    word = lambda text, x0, x1, top: F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), top.cast("double").alias("top"), (top + 9).cast("double").alias("bottom"))
    lit = F.lit
    heads = load(spark, d, "heads")
    total = S.styled_amount("total_cents", lit("dollar_comma"))
    top = [
        word(lit("Statement"), 20, 60, lit(10)), word(lit("No."), 62, 80, lit(10)), word(F.col("statement_number"), 90, 150, lit(11)), word(lit("Statement"), 200, 240, lit(10)), word(lit("Date:"), 242, 260, lit(10)),
        word(F.col("statement_date").cast("string"), 270, 330, lit(10)), word(lit("Total"), 20, 50, lit(30)), word(lit("Due"), 52, 70, lit(30)), word(lit("page"), 300, 320, lit(30)), word(total, 30, 90, lit(42)),
        word(lit("Invoice"), 20, 60, lit(60)), word(lit("No"), 62, 75, lit(60)), word(lit("Trans"), 120, 150, lit(60)), word(lit("Date"), 152, 170, lit(60)), word(lit("Line"), 220, 240, lit(60)), word(lit("Net"), 320, 335, lit(60)), word(lit("Amount"), 337, 370, lit(60)),
    ]
    head = heads.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.array(*top)).alias("word_pos", "w"))
    at = F.col("line_no") * 12 + 70
    cells = [word(F.col("invoice_number"), 20, 70, at), word(F.col("line_date").cast("string"), 120, 170, at), word(F.col("line_no").cast("string"), 225, 235, at), word(S.format_cents("amount_cents"), 330, 370, at)]
    body = load(spark, d, "statement_lines").select("doc_id", F.lit(1).alias("page"), "line_no", F.posexplode(F.array(*cells)).alias("p", "w")).withColumn("word_pos", F.col("line_no") * 10 + 100 + F.col("p")).drop("line_no", "p")
    every = head.unionByName(body)
    return every.select("doc_id", "page", F.lit(612.0).alias("page_width"), F.lit(9000.0).alias("page_height"), "word_pos", "w.*")


@query("op_S7b_header_row", "SELECT doc_id, name, x0, x1 FROM heads, (VALUES ('invoice_number', 20.0::DOUBLE, 75.0::DOUBLE), ('line_date', 120.0, 170.0), (NULL, 220.0, 240.0), ('line_amount', 320.0, 370.0)) v(name, x0, x1)", "heads")
def s7b(spark, d):
    return D.caption_rows(D.page_rows(_statement_words(spark, d))).select("doc_id", "name", "x0", "x1")


@query("op_S7f_label_values", "SELECT doc_id, 'statement_number' AS name, statement_number AS text FROM heads UNION ALL SELECT doc_id, 'statement_date', statement_date::VARCHAR FROM heads UNION ALL SELECT doc_id, 'total', '$' || regexp_replace(regexp_replace((total_cents // 100)::VARCHAR, '(\\d)(\\d{3})$', '\\1,\\2'), '^(\\d{1,3})(\\d{3},)', '\\1,\\2') || '.' || lpad((total_cents % 100)::VARCHAR, 2, '0') FROM heads", "heads")
def s7f(spark, d):
    return D.labelled_values(D.page_rows(_statement_words(spark, d))).select("doc_id", "name", "text")


@query("op_S7_pdf_fields", "SELECT 'fld-' || doc_id || '-' || lpad(line_no::VARCHAR, 4, '0') || '-' || name AS field_id, value FROM (SELECT doc_id, line_no, 'invoice_number' AS name, invoice_number AS value FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_date', line_date::VARCHAR FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_amount', (amount_cents // 100)::VARCHAR || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') FROM statement_lines) l UNION ALL SELECT 'fld-' || doc_id || '-header-statement_number', statement_number FROM heads UNION ALL SELECT 'fld-' || doc_id || '-header-statement_date', statement_date::VARCHAR FROM heads UNION ALL SELECT 'fld-' || doc_id || '-header-total', (total_cents // 100)::VARCHAR || '.' || lpad((total_cents % 100)::VARCHAR, 2, '0') FROM heads", "heads", "statement_lines")
def s7(spark, d):
    return D.read(_statement_words(spark, d)).select("field_id", "value")


def _answers(spark, d):
    """Each statement as two readings of it: dates and amounts that the first can't normalise, amounts that the second reads otherwise,
    dates it misses, totals it can't read; every third document was read once."""
    value = lambda raw, normalized: F.struct(raw.alias("raw"), normalized.alias("normalized"))
    x = load(spark, d, "statement_lines")
    money, day, p = S.format_cents("amount_cents"), F.col("line_date").cast("string"), F.col("l_partkey")
    printed = F.date_format("line_date", "MM/dd/yyyy")
    number = value(F.col("invoice_number"), F.col("invoice_number")).alias("invoice_number")
    first = F.struct(F.col("line_no").alias("row_position"), number, value(printed, F.when(p % 4 == 0, "unclear").otherwise(day)).alias("line_date"), value(F.concat(F.lit("$"), money), F.when(p % 5 == 0, "?").otherwise(money)).alias("line_amount"))
    then = F.struct(F.col("line_no").alias("row_position"), number, F.when(p % 11 != 0, value(printed, day)).alias("line_date"), value(money, F.when(p % 7 == 0, "1.00").otherwise(money)).alias("line_amount"))
    lines = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(first)).alias("a"), F.sort_array(F.collect_list(then)).alias("b"))
    both = load(spark, d, "heads").join(lines, "doc_id").join(load(spark, d, "manifest").select("doc_id", "doc_type"), "doc_id")
    total = S.format_cents("total_cents")
    answer = lambda c, seen: F.to_json(F.struct(value(total, seen).alias("total"), F.col(c).alias("lines")))
    second = F.when(F.col("k") % 3 != 0, answer("b", F.when(F.col("k") % 4 == 1, "?").otherwise(total)))
    return both.select("doc_id", "doc_type", answer("a", total).alias("answer"), second.alias("second"))


_ANSWERED = """SELECT 'fld-' || l.doc_id || '-' || lpad(line_no::VARCHAR, 4, '0') || '-' || name AS field_id, value, CASE WHEN m.k % 3 <> 0 THEN same::INT::DOUBLE END AS self_consistency
FROM (SELECT doc_id, line_no, 'invoice_number' AS name, invoice_number AS value, true AS same FROM statement_lines
UNION ALL SELECT doc_id, line_no, 'line_date', line_date::VARCHAR, l_partkey % 4 <> 0 AND l_partkey % 11 <> 0 FROM statement_lines
UNION ALL SELECT doc_id, line_no, 'line_amount', (amount_cents // 100)::VARCHAR || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0'), l_partkey % 5 <> 0 AND (l_partkey % 7 <> 0 OR amount_cents = 100) FROM statement_lines) l
JOIN manifest m USING (doc_id) WHERE name <> 'invoice_number' OR m.doc_type = 'parts_statement'
UNION ALL SELECT 'fld-' || doc_id || '-header-total', (total_cents // 100)::VARCHAR || '.' || lpad((total_cents % 100)::VARCHAR, 2, '0'), CASE WHEN k % 3 <> 0 THEN (k % 4 <> 1)::INT::DOUBLE END FROM heads"""


@query("op_S8a_answer_fields", f"SELECT field_id, value FROM ({_ANSWERED}) a", "heads", "statement_lines", "manifest")
def s8a(spark, d):
    return A.fields(_answers(spark, d)).select("field_id", "value")


@query("op_S8b_self_consistency", f"SELECT field_id, self_consistency FROM ({_ANSWERED}) a", "heads", "statement_lines", "manifest")
def s8b(spark, d):
    return A.fields(_answers(spark, d)).select("field_id", "self_consistency")


def _bands(spark, d):
    """A statement's lines as bands of ink, 24 pixels apart, some of them shifted or higher."""
    top = F.col("line_no") * 24 + F.when(F.col("l_partkey") % 6 == 0, 5).otherwise(F.col("l_partkey") % 2).cast("int")
    x = load(spark, d, "statement_lines").select("doc_id", F.lit(1).alias("page"), "line_no", top.alias("top"), (top + F.when(F.col("l_partkey") % 10 == 0, 14).otherwise(8)).alias("bottom"))
    return x


_BANDS = """WITH RECURSIVE b AS (SELECT doc_id, line_no::INT AS i, top::INT AS top, (top + CASE WHEN l_partkey % 10 = 0 THEN 14 ELSE 8 END)::INT AS bottom
FROM (SELECT *, line_no * 24 + CASE WHEN l_partkey % 6 = 0 THEN 5 ELSE l_partkey % 2 END AS top FROM statement_lines) x),
g AS (SELECT a.doc_id, a.i, (b.top + b.bottom) / 2.0::DOUBLE - (a.top + a.bottom) / 2.0::DOUBLE AS gap FROM b a JOIN b ON b.doc_id = a.doc_id AND b.i = a.i + 1),
f AS (SELECT doc_id, i, gap AS pitch, 1 AS seen, 0 AS run FROM g WHERE i = 1
UNION ALL SELECT g.doc_id, g.i, CASE WHEN abs(gap - pitch) <= 0.08::DOUBLE * pitch THEN pitch + (gap - pitch) / (seen + 1) ELSE gap END, CASE WHEN abs(gap - pitch) <= 0.08::DOUBLE * pitch THEN seen + 1 ELSE 1 END, CASE WHEN abs(gap - pitch) <= 0.08::DOUBLE * pitch THEN run ELSE run + 1 END FROM f JOIN g ON g.doc_id = f.doc_id AND g.i = f.i + 1),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 1 AS hi FROM f GROUP BY 1, 2),
w AS (SELECT r.doc_id, r.run, i - lo AS row, top, bottom FROM r JOIN b ON b.doc_id = r.doc_id AND b.i BETWEEN lo AND hi)
"""


@query("op_W16_even_pitch_runs", _BANDS + "SELECT doc_id, run, row::INT AS row, top, bottom FROM w", "statement_lines")
def w16(spark, d):
    return P.pitch_runs(_bands(spark, d)).drop("page")


@query("op_W16_table_rows", _BANDS + ", z AS (SELECT doc_id, run, count(*) AS n, avg(bottom - top) AS m, stddev_pop(bottom - top) AS s FROM w GROUP BY 1, 2), y AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS ties, max(n) OVER (PARTITION BY doc_id) AS most FROM z), e AS (SELECT doc_id, count(*) - (max(l_orderkey) % 2) AS n_rows FROM statement_lines GROUP BY 1) SELECT w.doc_id, (w.row + 1)::INT AS line_no, top, bottom FROM w JOIN y USING (doc_id, run) JOIN e USING (doc_id) WHERE y.n = y.most AND ties = 1 AND s / m <= 0.25 AND y.n = e.n_rows", "statement_lines")
def w16_table(spark, d):
    """The rows of pages whose table has as many as were promised: all lines, or all but one where the last order's number is odd."""
    promised = load(spark, d, "statement_lines").groupBy("doc_id").agg((F.count(F.lit(1)) - F.max("l_orderkey") % 2).alias("n_rows")).withColumn("page", F.lit(1))
    return P.table_rows(_bands(spark, d), promised).drop("page")
