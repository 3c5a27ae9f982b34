import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera import sql as Q
from statera.constants import SCHEDULES
from statera.functions import scalar as S
from statera.operators import evaluate as V
from statera.operators import generate as N
from statera.operators import metrics as E
from statera.sources import files as X
from statera.sources import renderer as D


@pytest.fixture(scope="module")
def made(spark):
    mix = {(t, tier): 6 for t in SCHEDULES for tier in ("csv", "xlsx")}
    return {k: v.cache() for k, v in N.dataset(spark, mix, dealers=4, months=2, rate=80).items()}


def read(files, kind):
    rows = X.line_fields(X.cell_rows(files, kind), stacked=kind == "xlsx").filter("raw_text <> ''")
    return Counter(map(tuple, rows.select("doc_id", S.rendered_key("line_no", "name"), "raw_text").collect()))


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_what_is_rendered_is_read(spark, kind):
    rows = []
    for doc in range(30):
        for n in range(1, 4):
            rows.append((f"d{doc}", n, f"A{n}", None, "", dt.date(2024, 1, n), ("a, b", 'say "x"', "tab\tand|bar", "naïve € cafe")[(doc + n) % 4].replace("\t", " " if kind == "xlsx" else "\t"), (-1) ** n * 123456 * n))
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, invoice_number string, vin string, claim_number string, line_date date, description string, amount_cents long")
    render = D.to_csv if kind == "csv" else D.to_xlsx
    files = render(lines)
    assert read(files, kind) == Counter(map(tuple, D.printed(lines, kind == "xlsx").select("doc_id", "key", "text").collect()))
    assert {r.doc_id: bytes(r.content) for r in files.collect()} == {r.doc_id: bytes(r.content) for r in render(lines.repartition(3)).collect()}
    if kind == "csv":  # the draws do differ
        heads = {bytes(r.content).split(b"\n")[0] for r in files.collect()}
        assert len(heads) > 4 and any(bytes(r.content).startswith(b"\xef\xbb\xbf") for r in files.collect())


def test_run_from_files_to_scorecard(spark, made, tmp_path):
    tiers = made["lines"].join(made["manifest"].select("doc_id", "tier"), "doc_id")
    csv, sheets = tiers.filter("tier = 'csv'"), tiers.filter("tier = 'xlsx'")
    files = D.to_csv(csv).unionByName(D.to_xlsx(sheets)).unionByName(spark.createDataFrame([("scan", bytearray(b"%PDF-1.4 %%EOF"))], "doc_id string, content binary"))
    shown = D.printed(csv).unionByName(D.printed(sheets, True))
    ledger = made["ledger"]
    given = (files.cache(), made["manifest"], V.truth_values(made["lines"]), shown, made["statements"], made["lines"], ledger, made["injections"])
    card = V.run_eval(str(tmp_path), "r1", "2025-01-01", *given, "test").first()
    assert "Routed but not read: pdf (1)." in card.notes
    put = made["injections"].join(made["manifest"].filter("split = 'test'"), "doc_id").count()
    by_mode = {m: [c for c in card.recon if c.mode == m] for m in ("oracle", "end_to_end")}
    for cells in by_mode.values():
        assert sum(c.injected for c in cells) == put
    # Everything printed is read right, so both reconciliations see the same lines.
    strip = lambda cells: sorted(tuple(c)[1:] for c in cells)
    assert strip(by_mode["oracle"]) == strip(by_mode["end_to_end"])
    assert card.fields and all(c.expected == c.extracted == c.canonical == c.raw for c in card.fields)
    V.run_eval(str(tmp_path), "r1", "2025-01-02", *given, "test")
    assert E.latest_scorecard(V.scorecards(spark, str(tmp_path))).first().created_at == dt.datetime(2025, 1, 2)
    assert V.scorecards(spark, str(tmp_path)).count() == 1


def test_sql_functions_are_the_librarys(spark):
    Q.register(spark)
    texts = ["$1,234.50", "(5)", "x", "-3.1-", None, "[ (7.005) ]", "{1}", "", "1HGCM82633A004352", "1M8GDM9AXKP042788", "02/30/2024", "4-Jan-2024", "4-xxx-2024", "2024-1-2", "1/2/2024", "00-ab 1", "123456789012345678901"]
    spark.createDataFrame([(t,) for t in texts], "x string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT x, amount_cents(x) a, read_date(x) d, reference_key(x) r, vin_ok(x) v FROM texts")
    want = spark.table("texts").select("x", S.amount_cents("x").alias("a"), S.parse_date("x").alias("d"), S.reference("x").alias("r"), S.vin_ok("x").alias("v"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.filter("v").count() == 2
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Python" not in plan
    prices = spark.sql("SELECT effective_price(5, 'x', 1, 1) a, effective_price(0, 'Gemini-3.5-Pro', 1000, 10) b, effective_price(0, 'none', 9, 9) c").first()
    assert tuple(prices) == (5, 1350, 0)


def test_table_function(spark):
    Q.register(spark)
    files = spark.createDataFrame([("a", bytearray(b"Invoice #,Post Dt,AMT\nM1,2024-01-02,5.00\n")), ("b", bytearray(b""))], "doc_id string, content binary")
    files.createOrReplaceTempView("two_files")
    got = spark.sql("SELECT f.doc_id, r.* FROM two_files f, LATERAL statement_rows(f.content, 'csv') r")
    assert Counter(map(str, got.collect())) == Counter(map(str, X.cell_rows(files).select(*got.columns).collect()))
    Q.statement_fields(spark, "two_files", "two_fields")
    assert {r.value for r in spark.sql("SELECT value FROM two_fields").collect()} == {"M1", "2024-01-02", "5.00"}
