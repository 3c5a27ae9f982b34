import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from statera.sources import files as X
from statera.sources import words as P
from statera.sources.workbooks import workbook


def frame(spark, pairs, key="path"):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in pairs], f"{key} string, content binary")


def test_routes(spark):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "x")
    pdf = b"%PDF-1.4\n/Type /Page\nstream\n(" + b"x" * 300 + b")\nendstream\n%%EOF"
    files = {
        "empty": (b"", "unprocessable", "empty"),
        "a.csv": (pdf, "digital_pdf", None),
        "scan": (pdf.replace(b"x" * 300, b"x"), "scanned_pdf", None),
        "locked": (pdf + b"/Encrypt", "unprocessable", "encrypted"),
        "cut": (pdf[:20], "unprocessable", "truncated"),
        "book": (workbook([["a"]]), "xlsx", None),
        "zip": (other.getvalue(), "unprocessable", "unrecognized"),
        "badzip": (b"PK\x03\x04zzz", "unprocessable", "truncated"),
        "a.pdf": (b"a,b,c, and some more words in one line", "csv", None),
        "cp1252": ("é|ü|ß and more words".encode("cp1252"), "csv", None),
        "plain": (b"nothing here", "unprocessable", "unrecognized"),
        "binary": (bytes(range(32)) * 9 + b",,,", "unprocessable", "unrecognized"),
    }
    df = frame(spark, [(k, v[0]) for k, v in files.items()])
    layers = spark.createDataFrame([("a.csv", "digital_pdf")], "path string, route string")
    got = {r.path: (r.route, r.error) for r in X.route(df, layers).collect()}
    assert got == {k: v[1:] for k, v in files.items()}
    # Without a table of words no PDF is called scanned.
    bare = {r.path: r.route for r in X.route(df).collect()}
    assert bare["a.csv"] == bare["scan"] == "pdf" and bare["book"] == "xlsx"


def test_ceilings_of_cells(spark):
    sizes = {"fits": X.MOST_CELL, "over": X.MOST_CELL + 1, "far over": 200_000, "empty": 0}
    rows = X.cell_rows(frame(spark, [(k, b"x" * n) for k, n in sizes.items()], "doc_id")).collect()
    assert {r.doc_id: r.error for r in rows} == {"fits": None, "over": "too_large", "far over": "too_large", "empty": "empty"}


def test_first_sheet_is_the_workbooks_own(spark):
    book = workbook([["Invoice Number", "Date", "Amount"], ["M1", "2024-01-02", "5.00"]], [["Other"], ["x"]])
    assert zipfile.ZipFile(io.BytesIO(book)).namelist()[-2:] == ["xl/worksheets/sheet2.xml", "xl/worksheets/sheet1.xml"]
    rows = X.cell_rows(frame(spark, [("b", book)], "doc_id"), "xlsx").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["Invoice Number", "Date", "Amount"], ["M1", "2024-01-02", "5.00"]]


def test_csv_with_preamble_and_odd_amounts(spark):
    text = 'Dealer portal\nprinted today\nClaim Number,RO Number,VIN,Date,Description,Amount\n1,,V1,01/02/2024,"a, b","$1,234.56"\n2,,V2,2024-01-03,c,(123.45)\n,,,,,\n3,,V3,x,d,123.45-\nTotal,,,,,9\n4,,V4,4-Jan-2024,e,\n'
    rows = X.line_fields(X.cell_rows(frame(spark, [("d", text.encode("utf-8-sig"))], "doc_id")))
    cents = {r.line_no: r.value_cents for r in rows.filter("name = 'line_amount'").collect()}
    assert cents == {1: 123456, 2: -12345, 3: -12345, 4: None}
    days = {r.line_no: r.value_date for r in rows.filter("name = 'line_date'").collect()}
    assert days == {1: dt.date(2024, 1, 2), 2: dt.date(2024, 1, 3), 3: None, 4: dt.date(2024, 1, 4)}
    status = {r.field_id: r.status for r in rows.collect()}
    assert status["fld-d-0001-line_amount"] == "auto_accepted" and status["fld-d-0003-line_date"] == "needs_review"


def test_first_column_of_a_name_wins_and_quotes_may_span_lines(spark):
    text = 'Amount,Amt,Date,Note\n1.00,2.00,1/1/2024,"two\nlines"\n'
    rows = X.line_fields(X.cell_rows(frame(spark, [("d", text.encode())], "doc_id"))).collect()
    assert [(r.name, r.raw_text) for r in rows if r.name == "line_amount"] == [("line_amount", "1.00")]
    assert {r.line_no for r in rows} == {1}


def test_stacked_captions(spark):
    book = workbook([["Statement"], ["Invoice", "Post", ""], ["Number", "Date", "Amount"], ["M1", "2024-01-02", "5.00"], ["TOTAL", "", "5.00"]])
    rows = X.line_fields(X.cell_rows(frame(spark, [("b", book)], "doc_id"), "xlsx"), stacked=True).collect()
    assert {(r.name, r.value) for r in rows} == {("invoice_number", "M1"), ("line_date", "2024-01-02"), ("line_amount", "5.00")}


def test_paths(spark):
    want = {"a/b.csv": True, "": False, "/a": False, "..": False, "a/../b": False, "c:\\x": False, "\\\\h\\x": False, "a..b": True, "a\x00b": False}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.ok for r in df.select("p", X.safe_path("p").alias("ok")).collect()} == want


def test_words_to_rows(spark):
    words = [("d", 1, i, "w", x, x + 10, top, top + 10) for i, (x, top) in enumerate([(0, 0.0), (20, 6.0), (40, 13.0), (0, 40.0), (20, 41.0)])]
    df = spark.createDataFrame([(a, b, c, e, float(f), float(g), h, i) for a, b, c, e, f, g, h, i in words], "doc_id string, page int, word_pos int, text string, x0 double, x1 double, top double, bottom double")
    got = {r.word_pos: r.row_id for r in P.cluster_rows(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}  # the span grows, so the third word still overlaps
    caps = spark.createDataFrame([("d", 1, "a", 0.0, 10.0), ("d", 1, "b", 20.0, 30.0)], "doc_id string, page int, name string, x0 double, x1 double")
    spans = {r.name: (r.lo, r.hi) for r in P.column_spans(caps).collect()}
    assert spans == {"a": (float("-inf"), 15.0), "b": (15.0, float("inf"))}
    assert P.bucket(df, P.column_spans(caps)).filter(F.col("name") == "b").count() == 3


def test_rows_of_many_pages_in_small_batches(spark):
    """Pages are clustered in one pass over a task's words, not in a pandas group each, and may run over batches."""
    import random

    rnd = random.Random(2)
    words = [(f"d{i % 9}" if i % 9 else None, i % 2 + 1, i, "w", rnd.choice([0.0, 20.0, 40.0]), 50.0, t, t + rnd.choice([0.0, 4.0, 9.0])) for i in range(300) for t in [float(rnd.randrange(90))]]
    df = spark.createDataFrame(words, "doc_id string, page int, word_pos int, text string, x0 double, x1 double, top double, bottom double")
    want = {}
    for at in {w[:2] for w in words}:
        row, lo, hi = -1, 0.0, 0.0
        for _, _, i, _, _, _, top, bottom in sorted((w for w in words if w[:2] == at), key=lambda w: (w[6], w[4], w[2])):
            shared, least = min(hi, bottom) - max(lo, top), min(hi - lo, bottom - top)
            joins = row >= 0 and least > 0 and shared / least >= P.OVERLAP
            row, lo, hi = (row, min(lo, top), max(hi, bottom)) if joins else (row + 1, top, bottom)
            want[i] = row
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = P.cluster_rows(df)
        assert {r.word_pos: r.row_id for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.schema[:-1] == df.schema and "InPandas" not in plan and "MapInArrow" in plan


def test_label_starts_miss_no_label(spark):
    """What is passed over before labels are searched holds none: words that are empty or missing can begin one too."""
    from statera.sources import pdf as D

    texts = [["Net", "Amount"], ["--", "Total", "due"], [None, "VIN"], ["Trans", "Date", "x", "RO", "no."], ["17", "2024"], ["Statement"], ["un", "it", "vin", "memo"]]
    rows = [("d", 1, r, i, t, 10.0 * i, 10.0 * i + 9, 0.0, 9.0) for r, ts in enumerate(texts) for i, t in enumerate(ts)]
    df = D.page_rows(spark.createDataFrame(rows, "doc_id string, page int, row_id int, word_pos int, text string, x0 double, x1 double, top double, bottom double"))
    for labels, once in ((D.COLUMN_LABELS, True), (D.HEADER_LABELS, False)):
        got = df.select("row_id", D._starts(labels).alias("s"), F.filter(D._found(labels, once), lambda x: x["name"].isNotNull())["name"].alias("f")).orderBy("row_id").collect()
        assert all(r.s >= len(r.f) for r in got) and got[4].s == 0
        assert [r.f for r in got] == ([["line_amount"], [], ["vin"], ["line_date", "ro_number"], [], [], ["vin"]] if once else [[], ["total"], [], [], [], ["statement_number"], ["statement_number"]])
