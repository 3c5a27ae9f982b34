"""Queries over sources and streams, with the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.operators import reconcile as R
from statera.scratch import scratch_dir, table
from statera.sources import files as X
from statera.sources import words as P
from statera.streaming import jobs as T
from statera.plans.base import book
from statera.plans.recon_queries import _CORE, _V
from statera.plans.views import load

QUERIES, ORACLE_SQL, query = book()


@query("op_S5_csv_reader", "SELECT doc_id, line_no, 'invoice_number' AS name, regexp_replace(upper(replace(replace(invoice_number, '-', ''), ' ', '')), '^0+', '') AS value FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_date', line_date::VARCHAR FROM statement_lines UNION ALL SELECT doc_id, line_no, 'line_amount', (amount_cents // 100)::VARCHAR || '.' || lpad((amount_cents % 100)::VARCHAR, 2, '0') FROM statement_lines", "statement_lines")
def s5(spark, d):
    files = X.to_csv(load(spark, d, "statement_lines"))
    return X.line_fields(X.sheets(files)).select("doc_id", "line_no", "name", "value")


@query("op_S5d_header_detection", "SELECT DISTINCT doc_id, 1 AS header_row FROM statement_lines", "statement_lines")
def s5d(spark, d):
    return X.headers(X.sheets(X.to_csv(load(spark, d, "statement_lines")))).select("doc_id", "header_row")


@query("op_S5g_field_builder", "SELECT 'fld-' || doc_id || '-' || lpad(line_no::VARCHAR, 4, '0') || '-line_amount' AS field_id, 'auto_accepted' AS status FROM statement_lines", "statement_lines")
def s5g(spark, d):
    files = X.to_csv(load(spark, d, "statement_lines"))
    return X.line_fields(X.sheets(files)).filter("name = 'line_amount'").select("field_id", "status")


@query("op_S17_path_containment", "SELECT p_partkey, p_partkey % 4 = 0 AS ok FROM part")
def s17(spark, d):
    i = F.col("p_partkey") % 4
    path = F.when(i == 0, "a/b.csv").when(i == 1, "/etc/a").when(i == 2, "a/../../b").otherwise("C:\\x")
    return load(spark, d, "part").select("p_partkey", X.safe_path(path).alias("ok"))


@query("op_S13_copy_scoped", "SELECT call_id FROM llm_calls WHERE run_id = 'run-1' AND seq >= 500", "llm_calls")
def s13(spark, d):
    return load(spark, d, "llm_calls").filter("run_id = 'run-1' AND seq >= 500").select("call_id")


def _words(spark, d):
    """Statement lines as words on a page: three columns, a row each 12 points."""
    lines = load(spark, d, "statement_lines").select("doc_id", F.lit(1).alias("page"), "line_no", "invoice_number", F.col("line_date").cast("string").alias("day"), S.format_cents("amount_cents").alias("amount"))
    top = F.col("line_no") * 12.0 + 0.5 * F.col("k")
    rows = lines.select("doc_id", "page", "line_no", F.posexplode(F.array("invoice_number", "day", "amount")).alias("k", "text"))
    return rows.select("doc_id", "page", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), (F.col("line_no") * 3 + F.col("k")).alias("word_pos"), "text", (F.col("k") * 100.0 + 20).alias("x0"), (F.col("k") * 100.0 + 80).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


@query("op_S7a_row_clustering", "SELECT doc_id, (line_no - 1)::INT AS row_id, 3::BIGINT AS n FROM statement_lines", "statement_lines")
def s7a(spark, d):
    return P.cluster_rows(_words(spark, d)).groupBy("doc_id", "row_id").agg(F.count(F.lit(1)).alias("n"))


def _spans(spark, d):
    docs = load(spark, d, "statements").select("doc_id", F.lit(1).alias("page"))
    caps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(20.0 + 100 * i).alias("x0"), F.lit(80.0 + 100 * i).alias("x1")) for i, n in enumerate(("invoice_number", "line_date", "line_amount"))])
    return P.column_spans(docs.select("doc_id", "page", F.explode(caps).alias("c")).select("doc_id", "page", "c.*"))


@query("op_S7c_column_spans", "SELECT doc_id, name, lo FROM statements, (VALUES ('invoice_number', '-inf'), ('line_date', '100.0'), ('line_amount', '200.0')) v(name, lo)", "statements")
def s7c(spark, d):
    return _spans(spark, d).select("doc_id", "name", F.when(F.col("lo") < -1e300, "-inf").otherwise(F.col("lo").cast("string")).alias("lo"))


@query("op_S7d_word_buckets", "SELECT doc_id, 'invoice_number' AS name, count(*) AS n FROM statement_lines GROUP BY 1 UNION ALL SELECT doc_id, 'line_date', count(*) FROM statement_lines GROUP BY 1 UNION ALL SELECT doc_id, 'line_amount', count(*) FROM statement_lines GROUP BY 1", "statement_lines")
def s7d(spark, d):
    return P.bucket(_words(spark, d), _spans(spark, d)).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("op_S7e_data_rows", "SELECT doc_id, (line_no - 1)::INT AS row_id FROM statement_lines", "statement_lines")
def s7e(spark, d):
    return P.data_rows(P.cells(P.bucket(P.cluster_rows(_words(spark, d)), _spans(spark, d)))).select("doc_id", "row_id")


@query("op_S7g_word_box", "SELECT doc_id, round(17.0::DOUBLE / 612, 9) AS x0, round((12.0::DOUBLE * min(line_no) - 3) / 792, 9) AS y0, round(283.0::DOUBLE / 612, 9) AS x1, round(least(1.0::DOUBLE, (12.0::DOUBLE * max(line_no) + 14) / 792), 9) AS y1 FROM statement_lines GROUP BY 1", "statement_lines")
def s7g(spark, d):
    box = P.union_box(_words(spark, d), ["doc_id"])
    return box.select("doc_id", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("op_R16_cell_text", "SELECT doc_id, (line_no - 1)::INT AS row_id, invoice_number AS text FROM statement_lines", "statement_lines")
def r16(spark, d):
    c = P.cells(P.bucket(P.cluster_rows(_words(spark, d)), _spans(spark, d)))
    return c.filter("name = 'invoice_number'").select("doc_id", "row_id", "text")


@query("op_Z1_stream_tumbling", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x1(spark, d):
    """Beyond the reference: hourly counts, with a watermark."""
    return T.collected(T.tumbling(T.log_stream(spark, d, "events")))


@query("op_Z2_stream_sliding", "SELECT (date_trunc('hour', ts) - to_hours(k))::TIMESTAMP AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def x2(spark, d):
    """Beyond the reference: two-hour windows each hour."""
    return T.collected(T.sliding(T.log_stream(spark, d, "events")))


@query("op_Z3_stream_sessions", "SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true))::INT AS fresh FROM events) e) f GROUP BY user_id, s")
def x3(spark, d):
    """Beyond the reference: a user's events with gaps under half an hour."""
    return T.collected(T.sessions(T.log_stream(spark, d, "events")))


@query("op_Z4_stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def x4(spark, d):
    """Beyond the reference: event ids once within the watermark."""
    return T.collected(T.deduplicated(T.log_stream(spark, d, "events")), "append").agg(F.count(F.lit(1)).alias("n"))


@query("op_T4_corrections_stream", "SELECT 'U' || user_id AS field_id, arg_max(event_type || '-' || (event_id % 9), event_id) AS new_value FROM events GROUP BY 1")
def t4(spark, d):
    """The corrections log as a stream; the state after the last batch."""
    state = f"{scratch_dir(spark)}/corrections-{uuid.uuid4().hex}"
    log = T.log_stream(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("field_id"), F.concat_ws("-", "event_type", (F.col("event_id") % 9).cast("string")).alias("new_value"), F.col("event_id").alias("seq"))
    T.apply_corrections(spark, log, state)
    return T.corrected(spark, state).select("field_id", "new_value")


@query("op_T1_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def t1(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return T.pending(docs, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "done").otherwise("failed").alias("state")))


@query("op_T3_reopen_stale", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 2 = 0 THEN 'pending' ELSE 'done' END AS state FROM documents")
def t3(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    states = docs.select("doc_id", F.lit("done").alias("state"), F.when(F.col("doc_id") % 2 == 0, "unrecognized").alias("error"))
    routes = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "csv").otherwise("unprocessable").alias("route"))
    return T.reopened(states, routes).select("doc_id", "state")


# Documents are reconciled one by one, so replacing some gives what a whole run over the corrected lines gives.
_CORRECTED = "FROM (SELECT * REPLACE (CASE WHEN doc_id LIKE 'D1-%' AND tag = 3 THEN amount_cents - 900 ELSE amount_cents END AS amount_cents) FROM statement_lines) t"


@query("op_T4_rereconcile", _CORE.replace("FROM statement_lines t", _CORRECTED) + "SELECT * FROM e", *_V)
def t4b(spark, d):
    """Lines of one dealer are corrected; only its documents' exceptions are replaced."""
    s, lines, ledger = load(spark, d, "statements"), load(spark, d, "statement_lines"), load(spark, d, "ledger")
    old = table(R.reconcile(s, lines, ledger)[1], "exceptions")
    touched = s.filter("dealer_id = 'D1'").select("doc_id")
    few = lambda x: x.join(touched, "doc_id", "left_semi")
    fixed = few(lines).withColumn("amount_cents", F.when(F.col("tag") == 3, F.col("amount_cents") - 900).otherwise(F.col("amount_cents")))
    fresh = table(R.reconcile(few(s), fixed, ledger.filter("dealer_id = 'D1'"))[1], "exceptions")
    return T.rereconcile(old, fresh, touched)


_STREAMED = "FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 10 = 1 AND tag = 3 THEN amount_cents - 900 ELSE amount_cents END AS amount_cents, CASE WHEN l_suppkey % 10 = 1 AND tag = 4 THEN line_date - 40 ELSE line_date END AS line_date) FROM statement_lines) t"


def _said(rows, name, value, n):
    """Corrections of one value, as one file of a log. Rows are found by all tasks, and only the corrections pass through the one that writes."""
    return rows.select("doc_id", "line_no", F.lit(name).alias("name"), value.alias("new_value"), F.lit(n).cast("bigint").alias("seq")).repartition(1)


@query("op_T4_stream_rereconcile", _CORE.replace("FROM statement_lines t", _STREAMED) + "SELECT * FROM e", *_V)
def t4c(spark, d):
    """A log of corrections in three files, streamed a file a batch: amounts first wrong and later right, dates in between. What the touched
    documents' reconciliations leave is what one over all corrected lines gives."""
    s, lines, ledger = load(spark, d, "statements"), load(spark, d, "statement_lines"), load(spark, d, "ledger")
    log = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    mine = lines.filter("l_suppkey % 10 = 1")
    wrong, right = (S.format_cents(F.col("amount_cents") - n) for n in (100, 900))
    _said(mine.filter("tag = 3"), "line_amount", wrong, 1).write.parquet(f"{log}/file=1")
    _said(mine.filter("tag = 4"), "line_date", F.date_sub("line_date", 40).cast("string"), 2).write.parquet(f"{log}/file=2")
    _said(mine.filter("tag = 3"), "line_amount", right, 3).write.parquet(f"{log}/file=3")
    kept = T.Reconciled(spark, f"{scratch_dir(spark)}/reconciled-{uuid.uuid4().hex}", s, lines, ledger)
    kept.first()
    kept.follow(spark.readStream.schema("doc_id string, line_no int, name string, new_value string, seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{log}/file=*"))
    return kept.current()


@query("op_T9_file_time_cache", "SELECT 1 AS step, count(*) AS entries, sum(amount_cents)::BIGINT AS cents FROM ledger UNION ALL SELECT 2, count(*), sum(amount_cents)::BIGINT FROM ledger WHERE l_orderkey % 3 = 0", "ledger")
def t9(spark, d):
    """A stored view of a table, and the same view after the table was rewritten in the same session."""
    own = f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}"
    rows, out = load(spark, d, "lineitem"), None
    for step, part in ((1, rows), (2, rows.filter("l_orderkey % 3 = 0"))):
        part.write.mode("overwrite").parquet(f"{own}/lineitem.parquet")
        seen = load(spark, own, "ledger").agg(F.count(F.lit(1)).alias("entries"), F.sum("amount_cents").alias("cents"))
        seen = table(seen.select(F.lit(step).alias("step"), "entries", "cents"), "seen")
        out = seen if out is None else out.unionByName(seen)
    return out


@query("op_T1_run_state", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 7 THEN 'FAILED' ELSE 'DONE' END AS state, (CASE WHEN doc_id % 10 = 7 THEN 3 WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 2 ELSE 1 END)::INT AS attempt FROM documents WHERE doc_id IS NOT NULL")
def t1b(spark, d):
    """A run whose first worker dies over every fourth document and fails over every fifth; others take over, and some documents fail for good."""
    run = T.RunState(spark, f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}")
    run.start(load(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id"))
    n = F.col("doc_id").cast("bigint")
    for i, (worker, now) in enumerate((("w1", "2024-01-01 00:00:00"), ("w2", "2024-01-01 01:00:00"), ("w3", "2024-01-01 02:00:00"))):
        mine = run.claim(worker, now, f"claim-{i}")
        if i == 0:
            mine = mine.filter(n % 4 != 0)
        bad = (n % 10 == 7) | ((n % 5 == 0) & F.lit(i == 0))
        run.finish(mine.withColumn("error", F.when(bad, "unreadable")), worker, now, f"finish-{i}")
    return run.folded().select("doc_id", "state", "attempt")
