import csv
import random

import pytest
from pyspark.sql import functions as F

from statera.sources import files as X
from statera.sources import pdf as D
from statera.sources import workbooks as B

WORDS = "doc_id string, page int, page_width double, page_height double, word_pos int, text string, x0 double, x1 double, top double, bottom double"


def words(spark, *rows):
    """(page, top, text, x0): words eight points high and five a character wide."""
    made = [("d", page, 600.0, 800.0, i, text, float(x0), float(x0 + 5 * len(text)), float(top), float(top + 8)) for i, (page, top, text, x0) in enumerate(rows)]
    return spark.createDataFrame(made, WORDS)


def test_labels_and_values(spark):
    df = words(spark,
        (1, 10, "Stmt", 10), (1, 10, "No", 35), (1, 10, "next", 60), (1, 11, "A-17", 90), (1, 10, "Issued", 150), (1, 10, "03/05/2024", 190),
        (1, 40, "Ending", 10), (1, 40, "Balance", 45), (1, 40, "Due", 85), (1, 52, "$1,000.00", 12), (1, 52, "7.00", 300),
        (1, 90, "Total", 10), (1, 90, "Due", 40), (1, 120, "5.00", 10),  # too far below
        (2, 10, "Issued", 10), (2, 10, "04/05/2024", 60), (2, 40, "Subtotal", 10), (2, 40, "1.00", 80), (2, 40, "2.00", 120), (2, 60, "Previous", 10), (2, 60, "Balance", 60), (2, 60, "none", 120),
    )
    got = {r.name: (r.page, r.text) for r in D.labelled_values(D.page_rows(df)).collect()}
    assert got == {"statement_number": (1, "A-17"), "statement_date": (1, "03/05/2024"), "total": (1, "$1,000.00"), "subtotal": (2, "2.00")}


def test_captions_and_lines(spark):
    df = words(spark,
        (1, 10, "Date", 10), (1, 10, "note", 100),  # too few captions
        (1, 30, "Line", 0), (1, 30, "Date", 40), (1, 30, "Date", 80), (1, 30, "Claim", 130), (1, 33, "No.", 160), (1, 30, "Amount", 250),
        (1, 50, "1", 2), (1, 50, "1/2/2024", 40), (1, 50, "x", 85), (1, 50, "C", 130), (1, 50, "12", 140), (1, 50, "(3.50)", 250),
        (1, 70, "Total", 40), (1, 70, "3.50", 250),
        (2, 10, "VIN", 10), (2, 10, "Date", 100), (2, 10, "Amt", 200), (2, 30, "V1", 10), (2, 30, "2024-02-03", 100), (2, 30, "4", 200),
    )
    names = D.caption_rows(D.page_rows(df)).orderBy("page", "x0").collect()
    assert [(r.page, r.name) for r in names] == [(1, None), (1, "line_date"), (1, None), (1, "claim_number"), (1, "line_amount"), (2, "vin"), (2, "line_date"), (2, "line_amount")]
    got = {r.field_id: (r.raw_text, r.value, r.line_no) for r in D.read(df).collect()}
    assert got == {
        "fld-d-0001-line_date": ("1/2/2024", "2024-01-02", 1), "fld-d-0001-claim_number": ("C 12", "C 12", 1), "fld-d-0001-line_amount": ("(3.50)", "-3.50", 1),
        "fld-d-0002-vin": ("V1", "V1", 2), "fld-d-0002-line_date": ("2024-02-03", "2024-02-03", 2), "fld-d-0002-line_amount": ("4", "4.00", 2),
    }
    assert D.read(df.limit(0)).count() == 0


def test_text_layer(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "doc_id string, page int")
    shown = spark.createDataFrame([("a", 1, "x" * 399), ("a", 3, "x" * 900), ("b", 1, "x" * 200)], "doc_id string, page int, text string")
    assert {r.doc_id: r.route for r in D.text_layer(pages, shown).collect()} == {"a": "scanned_pdf", "b": "digital_pdf", "c": "scanned_pdf"}


def test_cells_of_workbooks(spark):
    assert X.cell_text("45292.75", "dd/mm/yyyy") == "2024-01-01" and X.cell_text("-1234567.5", '"$"#,##0.00') == "-$1,234,567.50"
    assert X.cell_text("1E-3", "General") == "0.001" and X.cell_text("12.30", "[Red]0.00") == "12.30" and X.cell_text("3", '0 "days"') == "3"
    books = [("a", B.workbook([["t&<", (45292, 1)], [(7.5, 2), (True, 0)]])), ("b", B.bomb()), ("c", b"PK\x03\x04"), ("d", b""), ("e", None)]
    books += [(f"f{i}", B.workbook([[str(i)]] * 3)) for i in range(2000)]
    rows = X.cell_rows(spark.createDataFrame(books, "doc_id string, content binary"), "xlsx").cache()
    got = {(r.doc_id, r.row_no): (r.cells, r.error) for r in rows.filter("doc_id NOT LIKE 'f%'").collect()}
    assert got == {("a", 0): (["t&<", "2024-01-01"], None), ("a", 1): (["$7.50", "True"], None), ("b", 0): ([], "too_large"), ("c", 0): ([], "truncated"), ("d", 0): ([], "empty"), ("e", 0): ([], "empty")}
    assert rows.filter("doc_id LIKE 'f%'").groupBy("doc_id").count().filter("count = 3").count() == 2000


def slow_sniff(data):
    if not data:
        return False
    head = data[: X.HEAD]
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = "".join("�" if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in head)
    bad = sum((c < " " and c != "\t") or c == "�" for c in text)
    return bad <= len(text) * 0.1 and any(text.count(m) >= 2 for m in ",|\t")


def test_sniff_of_whole_texts(spark):
    rnd = random.Random(3)
    some = ["a,b,c d e f", "a,b", "a|b|c e f g h", "é" * 5000 + ",,", "é" * 4095 + ",,", "x" * 8190 + "é,,", "\n" * 30 + ",,", "w " * 5000 + ",,", ""]
    some += ["".join(rnd.choice(["a", ",", "|", "\t", "\n", "é", "\x07", " word"]) for _ in range(rnd.randrange(200))) for _ in range(200)]
    rows = [t.encode() for t in some] + [b"\x81,,abcdefghijk", b"caf\xe9,a,b", b"\x81\x8d,,"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, c binary").select("i", F.coalesce(X.looks_delimited("c"), F.lit(False)).alias("ok")).collect()
    assert {r.i: r.ok for r in got} == {i: slow_sniff(r) for i, r in enumerate(rows)}


@pytest.mark.parametrize("body,want", [(b"%PDF-1.4 x", ("unprocessable", "truncated")), (b"%PDF-1.4 /Encrypt %%EOF", ("unprocessable", "encrypted")), (b"%PDF-1.4 %%EOF", ("scanned_pdf", None)), (b"", ("unprocessable", "empty"))])
def test_route(spark, body, want):
    files, no_words = spark.createDataFrame([("p", body)], "path string, content binary"), spark.createDataFrame([], "path string, route string")
    r = X.route(files, no_words).first()
    assert (r.route, r.error) == want
    # Without a table of words a PDF stays undecided.
    bare = X.route(files).first()
    assert (bare.route, bare.error) == (("pdf", None) if want[0] == "scanned_pdf" else want)


def test_a_delimiter_is_the_sniffers(monkeypatch):
    def sniffed(head):
        try:
            return csv.Sniffer().sniff(head, ",|\t").delimiter
        except csv.Error:
            return max(",|\t", key=head.count)

    rng = random.Random(7)
    heads = ["".join(rng.choice('ab1 ;:"\'\n\n' + marks) for _ in range(rng.randrange(90))) for marks in (",", "|", "\t", ",|", ",|\t", "") for _ in range(400)]
    assert [X._mark(h) for h in heads] == [sniffed(h) for h in heads]
    monkeypatch.setattr(csv.Sniffer, "sniff", lambda *a: pytest.fail("a head with one kind of mark was sniffed"))
    assert [X._mark(h) for h in ("a,b\n1,2\n", "a|b", "a", "")] == [",", "|", ",", ","]


def test_small_parts_of_workbooks_are_parsed_once(monkeypatch):
    for f in (X._formats, X._sheet_ids, X._related):
        f.cache_clear()
    seen, parse = [], X.ElementTree.fromstring
    monkeypatch.setattr(X.ElementTree, "fromstring", lambda part: seen.append(part) or parse(part))
    books = [B.workbook([[f"a{i}\n\tb", (i, 1), (i, 2), (i % 2 == 0, 0), (i, 0)]], [["other"]]) for i in range(1, 9)]
    rows = [X.parsed(b, "xlsx") for b in books]
    assert rows[0] == X.parsed(books[0], "xlsx") and rows[1] == ([["a2\tb", "1900-01-01", "$2.00", "True", "2"]], None)
    assert len(seen) == 8 + 1 + 3  # a sheet each, and three parts for all


def test_keys_of_files_are_dealt(spark):
    assert X.dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_read_where_they_lie(spark):
    """each file is parsed once, its header is found in its own row, and nothing is moved between reading and typed fields."""
    text = lambda mark, top: "\n".join([*["Portal of statements"] * top, mark.join(("Invoice #", "Post Dt", "AMT")), mark.join(("M1", "01/02/2024", "5.00")), "", mark.join(("Total", "", "5.00"))])
    given = [("a", text(",", 0)), ("b", text("|", 2)), ("c", text("\t", 7)), ("d", text(",", 120)), ("e", "no,captions\n1,2"), (None, text(",", 0))]
    files = spark.createDataFrame([(d, bytearray(t.encode())) for d, t in given], "doc_id string, content binary")
    routed = X.routed(files)
    assert {r.doc_id: r.route for r in routed.collect()} == dict.fromkeys([*"abcde", None], "csv")
    fields = X.line_fields(X.sheets(routed))
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Window" not in plan
    want = {(d, 1, n, v) for d in "abc" for n, v in (("invoice_number", "M1"), ("line_date", "2024-01-02"), ("line_amount", "5.00"))}  # d's captions stand below the rows looked at
    assert {(r.doc_id, r.line_no, r.name, r.value) for r in fields.collect()} == want
    assert {tuple(r) for r in X.line_fields(X.cell_rows(files)).select("doc_id", "line_no", "name", "value").collect()} == want
    assert {r.doc_id: r.header_row for r in X.headers(X.sheets(files)).filter("doc_id IS NOT NULL").collect()} == {"a": 0, "b": 2, "c": 7}


def test_delimiters_are_the_sniffers():
    import csv
    import random

    def sniffed(head):
        try:
            return csv.Sniffer().sniff(head, ",|\t").delimiter
        except csv.Error:
            return max(",|\t", key=head.count)

    draw = random.Random(7)
    for _ in range(400):
        mark = draw.choice(",|\t")
        lines = [mark.join(draw.choice(["x", "1,234.56", "a|b", "", "q\tr"]) for _ in range(draw.choice([3, 3, 3, 4]))) for _ in range(draw.randint(1, 35))]
        head = "\n".join(lines)
        assert X._mark(head) == (sniffed(head) if sum(m in head for m in ",|\t") > 1 else next((m for m in ",|\t" if m in head), ","))
