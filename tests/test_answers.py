import json

from statera.sources import answers as A

KIND = "doc_id string, doc_type string, answer string, second string"


def v(raw, normalized=None):
    return {"raw": raw, "normalized": raw if normalized is None else normalized}


def doc(*lines, **head):
    return json.dumps({**head, "lines": list(lines)})


def test_fields_and_agreement(spark):
    first = doc(
        {"row_position": 1, "invoice_number": v("A-1"), "line_amount": v("$1,200.50", "1200.50"), "line_date": v("03/04/2025", "soon"), "bbox": [100, 100, 300, 120]},
        {"row_position": 2, "page": 1, "line_amount": v("(7.00)", "?"), "vin": v("X"), "line_date": v("never"), "bbox": [100, 100, 90, 120]},
        total=v("9.00"),
        subtotal=v("nine", "nein"),
    )
    second = doc({"row_position": 1, "invoice_number": v("A-1"), "line_amount": v("1200.5"), "line_date": v("x", "later")}, {"row_position": 2, "line_date": v("never ever")}, total=v("9.01"), subtotal=v("?"))
    rows = [("d", "parts_statement", first, second), ("e", "parts_statement", first, None), ("u", None, first, None), ("w", "parts_statement", first, "not json")]
    got = A.fields(spark.createDataFrame(rows, KIND))
    d = {(x.line_no, x.name): x for x in got.filter("doc_id = 'd'").collect()}
    assert set(d) == {(None, "total"), (None, "subtotal"), (1, "invoice_number"), (1, "line_amount"), (1, "line_date"), (2, "line_amount"), (2, "line_date")}
    assert d[1, "line_amount"].value_cents == 120050 and d[2, "line_amount"].value == "-7.00"  # the second from what was printed
    assert str(d[1, "line_date"].value_date) == "2025-03-04" and d[2, "line_date"].value is None
    assert d[None, "total"].field_id == "fld-d-header-total" and d[1, "line_date"].field_id == "fld-d-0001-line_date"
    assert d[1, "line_date"].bbox.x1 == 0.3 and d[2, "line_date"].bbox is None and d[2, "line_date"].page == 1
    sure = {k: x.self_consistency for k, x in d.items()}
    assert sure == {(None, "total"): 0.0, (None, "subtotal"): 1.0, (1, "invoice_number"): 1.0, (1, "line_amount"): 1.0, (1, "line_date"): 1.0, (2, "line_amount"): 0.0, (2, "line_date"): 1.0}
    others = got.filter("doc_id <> 'd'").collect()
    assert all(x.self_consistency is None for x in others)
    assert sorted({x.name for x in others if x.doc_id == "u"}) == ["subtotal", "total"]  # an unknown kind has no lines


def test_what_cannot_be_taken(spark):
    line = {"row_position": 1, "line_amount": v("1.00")}
    bad = {
        "none": None,
        "empty": "",
        "text": "I can not read this",
        "list": "[1]",
        "cut": doc(line)[:-3],
        "row": doc({**line, "row_position": 0}),
        "norow": doc({"line_amount": v("1.00")}),
        "half": doc({**line, "line_date": {"raw": "x"}}),
        "page": doc({**line, "page": 50}),
        "box": doc({**line, "bbox": [1, 2]}),
        "many": doc(*[{**line, "row_position": i % 5000 + 1} for i in range(5001)]),
    }
    good = {"nolines": json.dumps({"total": v("1.00")}), "twice": doc(line, {**line, "line_amount": v("2.00")}), "bare": "{}"}
    rows = [(k, "parts_statement", a, a) for k, a in {**bad, **good}.items()]
    df = spark.createDataFrame(rows, KIND)
    assert {x.doc_id for x in A.parsed(df).filter("error = 'malformed'").collect()} == set(bad)
    got = sorted((x.doc_id, x.name, x.value, x.self_consistency) for x in A.fields(df).collect())
    assert got == [("nolines", "total", "1.00", 1.0), ("twice", "line_amount", "1.00", 1.0), ("twice", "line_amount", "2.00", 1.0)]
    assert A.fields(df.limit(0)).count() == 0


def test_each_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("d", "parts_statement", doc(total=v("9.00")), None)], KIND)
    plan = A.fields(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # answer and second


def test_answers_of_a_table_named_alike(spark):
    """Answers may come of joins of subqueries of any name, x among them, whose keys stay hidden behind them."""
    a = spark.createDataFrame([("d", doc(total=v("9.00")))], "doc_id string, answer string").alias("x")
    b = spark.createDataFrame([("d", "parts_statement", doc(total=v("9")))], "doc_id string, doc_type string, second string").alias("m")
    got = A.fields(a.join(b, "doc_id").select("doc_id", "doc_type", "answer", "second")).collect()
    assert [(x.field_id, x.value, x.self_consistency) for x in got] == [("fld-d-header-total", "9.00", 1.0)]
