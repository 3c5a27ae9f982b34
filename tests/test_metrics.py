from statera.operators import metrics as M


def test_field_accuracy_by_hand(spark):
    """Printed and unprinted truth, a spurious field, a document of another split, one never extracted, and print without truth."""
    manifest = spark.createDataFrame([("a", "test", "csv"), ("b", "test", "csv"), ("c", "train", "csv")], "doc_id string, split string, tier string")
    truth = spark.createDataFrame(
        [(d, n, "line_amount", "amount", None, 100 * n, None) for d in "abc" for n in (1, 2, 3)] + [("a", 1, "description", "text", None, None, None), ("a", None, "statement_number", "reference", "S1", None, None)],
        "doc_id string, line_no int, name string, family string, truth string, truth_cents long, truth_day date",
    )
    fields = spark.createDataFrame(
        [("a", 1, "line_amount", "amount", "1.00", "1.00", 100), ("a", 2, "line_amount", "amount", "9.99", "9.99", 999), ("a", 9, "line_amount", "amount", "1.00", "1.00", 100), ("a", 1, "description", "text", "x", "x", None), ("c", 1, "line_amount", "amount", "1.00", "1.00", 100)],
        "doc_id string, line_no int, name string, family string, raw_text string, value string, value_cents long",
    ).selectExpr("*", "CAST(NULL AS DATE) AS value_date", "'kept' AS tag")
    printed = spark.createDataFrame([("a", "1:line_amount", "1.00"), ("a", "2:line_amount", "9.99"), ("a", "7:line_amount", "5.00"), ("b", "1:line_amount", "1.00"), ("c", "1:line_amount", "1.00")], "doc_id string, key string, text string")
    got = [tuple(x) for x in M.score_fields(fields, truth, printed, manifest, "test").collect()]
    # family, tier, in_truth, expected, extracted, spurious, canonical, raw; the reference was never printed
    assert got == [("amount", "csv", 6, 3, 2, 1, 1, 2)]
    judged = {(x.doc_id, x.line_no, x.name): x.correct for x in M.judged(fields, truth).collect()}
    assert judged == {("a", 1, "line_amount"): True, ("a", 2, "line_amount"): False, ("a", 9, "line_amount"): None, ("a", 1, "description"): None, ("c", 1, "line_amount"): True}
