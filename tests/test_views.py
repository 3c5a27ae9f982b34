import re

import pytest
from pyspark.sql import functions as F

from statera.plans import views


def plain(spark, d, name):
    """A view by its own SQL alone, with nothing stored."""
    if name not in views.VIEWS:
        return spark.read.parquet(f"{d}/{name}.parquet")
    frames, text = {}, views.VIEWS[name]
    for source in views._sources(text):
        if source != name:
            frames[source] = plain(spark, d, source)
            text = re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
    return spark.sql(text, **frames)


@pytest.fixture
def sales(spark, tmp_path):
    """Lineitems with repeated keys, copies and places left NULL, two orders in five of them doubled or dropped by a statement."""
    i = F.col("id")
    lines = spark.range(600).select(
        F.when(i % 97 != 0, i % 260).alias("l_orderkey"), (i % 3 + 1).cast("int").alias("l_linenumber"), (i * 7 % 200).alias("l_partkey"), F.when(i % 41 != 0, i % 9).alias("l_suppkey"),
        F.when(i % 53 != 0, i * 1.37 + 900).alias("l_extendedprice"), (i % 50).cast("double").alias("l_quantity"),
        F.when(i % 59 != 0, F.date_add(F.lit("1996-01-28").cast("date"), (i % 70).cast("int"))).cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["ledger", "statement_lines", "statements", "fields", "manifest", "extracted"])
def test_views_are_what_their_sql_says(spark, sales, name):
    a, b = views.load(spark, sales, name), plain(spark, sales, name)
    assert a.dtypes == b.dtypes and a.count() > 30
    assert not a.exceptAll(b).count() and not b.exceptAll(a).count()


def test_texts_are_not_stored(spark, sales):
    for name in ("ledger", "statement_lines"):
        kept = spark.read.parquet(views.load(spark, sales, name)._statera_path)
        assert "string" not in dict(kept.dtypes).values()
    assert not hasattr(views.load(spark, sales, "fields"), "_statera_path")


def test_detail_of_asked_fields_is_made_without_a_join_of_fields(spark):
    """a line's fields meet in their document's part; what is shown is what joins show."""
    from statera.operators import reviewdb as W

    rows = [(f"f{i}", None if i == 7 else f"d{i % 2}", None if i % 6 == 5 else i % 3, "ab"[i // 6 % 2], "text", f"t{i % 5}", f"t{i % 5}", "csv", 0.5) for i in range(24)]
    fields = spark.createDataFrame(rows, "field_id string, doc_id string, line_no int, name string, family string, raw_text string, value string, route string, self_consistency double")
    documents = spark.createDataFrame([("d0", "csv", "csv"), ("d1", "xlsx", "xlsx")], "doc_id string, route string, tier string")
    want = W.review_detail(fields.filter("name = 'a'"), documents, fields, ("self_consistency",))
    got = W.asked_detail(fields, F.col("name") == "a", documents, ("self_consistency",))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 12
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_statements_are_made_of_dealers_and_months(spark, sales):
    """no text of an entry is moved for the statements, but numbers of dealers and months; the rows are those of the SQL."""
    a, b = views._plain(spark, sales, "statements"), plain(spark, sales, "statements")
    assert a.dtypes == b.dtypes and a.count() > 20
    assert not a.exceptAll(b).count() and not b.exceptAll(a).count()
    aggregates = [x for x in a._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(aggregates) == 2 and "Aggregate [l_suppkey" in aggregates[1]
