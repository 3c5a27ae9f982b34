import datetime as dt

from pyspark.sql import functions as F

from statera.functions import scalar as S


def one(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in rows.select("i", f("t").alias("r")).orderBy("i").collect()]


def test_amounts(spark):
    good = {"$1,234.56": 123456, "(123.45)": -12345, "123.45-": -12345, "$-123.45": -12345, "1.005": 101, "123.4": 12340, "{1.50}": 150, "[2]": 200, ".5": 50, "-(3)": None, "(-4)": -400}
    assert one(spark, list(good), S.amount_cents) == list(good.values())
    assert one(spark, ["", "abc", "12.34.56", "$", "-", "()", "1e5", "NaN", "1" * 21, None], S.amount_cents) == [None] * 10


def test_dates(spark):
    texts = ["3/4/2024", "2024-03-04", "4-mar-2024", "04-MAR-2024", "2/30/2024", "2024-13-01", "x", None, "4-foo-2024"]
    assert one(spark, texts, S.parse_date) == [dt.date(2024, 3, 4)] * 4 + [None] * 5
    assert one(spark, ["1/1/1989", "1/1/1990", "1/1/2101"], S.plausible_date) == [None, dt.date(1990, 1, 1), None]


def test_references(spark):
    assert one(spark, ["00-12 ab", "000", None], S.reference) == ["12AB", "", None]
    assert one(spark, ["AB0012", "0AB012"], S.canonical_reference) == ["AB12", "AB12"]


def test_vin(spark):
    assert one(spark, ["1FTFW1ET9DFC10312", "1FTFW1ET0DFC10312", "short", None, "1FTFW1ETIDFC10312"], S.vin_ok) == [True, False, False, False, False]


def test_edits(spark):
    pairs = [("abcd", "abdc", True), ("abcd", "abcd", True), ("abcd", "abc", True), ("abcd", "badc", False), ("a", "b", True), ("ab", "cd", False), ("", "a", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(S.within_one_edit("a", "b") != F.col("want")).count() == 0


def test_formats(spark):
    rows = spark.createDataFrame([(-12345,), (5,), (123456789,)], "c long")
    got = [tuple(r) for r in rows.select(S.format_cents("c"), S.styled_amount("c", F.lit("dollar_comma")), S.styled_amount("c", F.lit("paren"))).collect()]
    assert got == [("-123.45", "-$123.45", "(123.45)"), ("0.05", "$0.05", "0.05"), ("1234567.89", "$1,234,567.89", "1234567.89")]


def test_list_price(spark):
    row = spark.range(1).select(S.list_price(F.lit(3), F.lit(5), F.lit(1_000_000), F.lit(2_000_000))).first()
    assert row[0] == 13
