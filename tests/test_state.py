from collections import Counter

from pyspark.sql import functions as F

from statera.operators import costs
from statera.operators import generate as N
from statera.operators import reconcile as R
from statera.plans import views
from statera.streaming import jobs as T


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stream_of_corrections_with_a_replayed_batch(spark, tmp_path):
    ledger = N.ledger(spark, 2, 1).cache()
    heads, lines = (x.cache() for x in N.compose(ledger))
    kept = T.Reconciled(spark, str(tmp_path / "store"), heads, lines, ledger)
    kept.first()
    docs = [r.doc_id for r in heads.select("doc_id").orderBy("doc_id").limit(3).collect()]
    schema = "doc_id string, line_no int, name string, new_value string, seq long"
    batches = [
        spark.createDataFrame([(docs[0], 1, "line_amount", "1.00", 1), (docs[1], 1, "line_date", "1/1/2020", 2)], schema),
        spark.createDataFrame([(docs[0], 1, "line_amount", "2.00", 3), (docs[2], 2, "invoice_number", "??", 4)], schema),
        spark.createDataFrame([(docs[0], 2, "line_amount", "no number", 5)], schema),
    ]
    for i in (0, 1, 1, 2, 0):  # one comes twice, and the first again after the last
        kept.batch(batches[i], i)
    hit = lambda d, n: (F.col("doc_id") == d) & (F.col("line_no") == n)
    fixed = lines.withColumn("amount_cents", F.when(hit(docs[0], 1), 200).otherwise(F.col("amount_cents")).cast("bigint"))
    fixed = fixed.withColumn("line_date", F.when(hit(docs[1], 1), F.lit("2020-01-01").cast("date")).otherwise(F.col("line_date")))
    fixed = fixed.withColumn("invoice_number", F.when(hit(docs[2], 2), "??").otherwise(F.col("invoice_number")))
    whole = R.reconcile(heads, fixed, ledger)[1]
    assert rows(kept.current()) == rows(whole.select(*kept.current().columns)) and whole.count() >= 1
    touched = spark.read.parquet(str(tmp_path / "store/touched/batch=1")).collect()
    assert {r.doc_id for r in touched} == {docs[0], docs[2]}


def test_run_is_resumed_after_a_kill(spark, tmp_path):
    run = T.RunState(spark, str(tmp_path / "log"), most=2, stale="30 minutes")
    run.start(spark.range(6).select(F.col("id").alias("doc_id")))
    run.start(spark.range(6).select(F.col("id").alias("doc_id")))
    first = run.claim("w1", "2024-01-01 00:00:00", "c1").cache()
    assert first.count() == 6 and run.claim("w1", "2024-01-01 00:00:01", "c1").count() == 6  # said twice, claimed once
    run.finish(first.filter("doc_id < 3").withColumn("error", F.when(F.col("doc_id") == 2, "bad")), "w1", "2024-01-01 00:01:00", "f1")
    # w1 is killed here. Soon after only the failed document is open; later those in progress are stale.
    assert [r.doc_id for r in run.claim("w2", "2024-01-01 00:10:00", "c2").collect()] == ["2"]
    second = run.claim("w3", "2024-01-01 00:40:00", "c3").cache()
    assert sorted(r.doc_id for r in second.collect()) == ["3", "4", "5"]
    run.finish(second.withColumn("error", F.when(F.col("doc_id") == 5, "bad")), "w3", "2024-01-01 00:41:00", "f3")
    run.finish(run.claim("w2", "2024-01-01 00:11:00", "c2").withColumn("error", F.lit(None).cast("string")), "w2", "2024-01-01 00:12:00", "f2")
    got = {r.doc_id: (r.state, r.attempt) for r in run.folded().collect()}
    assert got == {"0": ("DONE", 1), "1": ("DONE", 1), "2": ("DONE", 2), "3": ("DONE", 2), "4": ("DONE", 2), "5": ("FAILED", 2)}
    assert run.claim("w4", "2025-01-01 00:00:00", "c4").count() == 0


def test_an_attempt_is_recorded_once(spark, tmp_path):
    calls = spark.createDataFrame([("a", "r", "p", "qwen3-vl:8b", 10, 5, False, 200), ("b", "r", "p", "x", 7, 1, True, 500)], "call_id string, run_id string, provider string, model string, prompt_tokens long, completion_tokens long, cached boolean, http_status int")
    at = str(tmp_path / "ledger")
    assert costs.append(at, calls, "1") and not costs.append(at, calls, "1") and costs.append(at, calls, "2")
    got = costs.recorded_calls(spark, at)
    assert got.count() == 4 and got.agg(F.sum("prompt_tokens")).first()[0] == 20 and got.filter("failed").count() == 2


def test_views_follow_their_files(spark, tmp_path):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    at = str(tmp_path / "lineitem.parquet")
    lineitem.write.parquet(at)
    first = views.load(spark, str(tmp_path), "ledger")
    n = first.count()
    assert views.load(spark, str(tmp_path), "ledger") is first
    lineitem.filter("l_orderkey < 50").write.mode("overwrite").parquet(at)
    assert 0 < views.load(spark, str(tmp_path), "ledger").count() < n


def test_corrections_are_found_by_all_tasks(spark):
    """a file of the log is written by one task, but that one doesn't read all lines for it."""
    from statera.plans.source_queries import _said

    rows = spark.range(0, 40, 1, 4).selectExpr("concat('d', id) AS doc_id", "CAST(id AS INT) AS line_no", "id % 3 AS tag").filter("tag = 0")
    out = _said(rows, "line_amount", rows.line_no.cast("string"), 1)
    assert out.rdd.getNumPartitions() == 1 and "Exchange" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 14
