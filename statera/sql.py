"""The library's functions for users of SQL: register(spark) once, then amount_cents(x), read_date(x), reference_key(x), vin_ok(x),
effective_price(stored, model, prompt, completion) and the table functions statement_rows(content, kind) and statement_sheet(content, kind).

The scalar functions are SQL functions, whose bodies Spark puts in place and optimizes with the query; no Python runs. The table functions
are Python: a file has to be parsed somewhere. They give what sources.files.cell_rows and sources.files.sheets give, the rows of cells or
all of a file's rows as one value, and statement_fields() makes a view of typed fields of a table of files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statera.constants import PRICES, VIN_VALUES, VIN_WEIGHTS
from statera.sources import files as X

_PRICED = sorted(PRICES.items(), key=lambda kv: -len(kv[0]))


def _price(i: int) -> str:
    """The price of the longest pattern in the model's name."""
    return "CASE " + " ".join(f"WHEN contains(lower(model), '{name}') THEN {price[i]}L" for name, price in _PRICED) + " END"


#: name and arguments, type, body; in order, as later ones call earlier ones.
FUNCTIONS = [
    ("trimmed(x STRING)", "STRING", r"regexp_replace(x, r'^\s+|\s+\z', '')"),
    ("without_braces(x STRING)", "STRING", r"trimmed(regexp_replace(trimmed(x), r'(?s)^\{(.*)\}\z|^\[(.*)\]\z', '$1$2'))"),
    ("without_parens(x STRING)", "STRING", r"regexp_replace(without_braces(x), r'(?s)^\((.*)\)\z', '$1')"),
    ("bare_amount(x STRING)", "STRING", r"translate(regexp_replace(without_parens(x), r'-\z', ''), '$, ', '')"),
    ("amount_cents(x STRING)", "BIGINT", r"""try_cast(round(try_cast(nullif(regexp_extract(bare_amount(x), r'^-?((?=.{1,20}\z)(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))\z', 1), '') AS DECIMAL(38, 19)), 2) * 100 AS BIGINT)
        * CASE WHEN without_braces(x) RLIKE r'(?s)^\(.*\)\z' OR endswith(without_parens(x), '-') OR startswith(bare_amount(x), '-') THEN -1 ELSE 1 END"""),
    ("day_of(y STRING, m STRING, d STRING)", "DATE", "try_to_date(concat_ws('-', y, lpad(m, 2, '0'), lpad(d, 2, '0')), 'yyyy-MM-dd')"),
    ("month_of(x STRING)", "STRING", "lpad(nullif(array_position(array('jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'), lower(x)), 0), 2, '0')"),
    ("read_date(x STRING)", "DATE", r"""CASE
        WHEN trimmed(x) RLIKE r'^\d{1,2}/\d{1,2}/\d{4}\z' THEN day_of(split_part(trimmed(x), '/', 3), split_part(trimmed(x), '/', 1), split_part(trimmed(x), '/', 2))
        WHEN trimmed(x) RLIKE r'^\d{4}-\d{1,2}-\d{1,2}\z' THEN day_of(split_part(trimmed(x), '-', 1), split_part(trimmed(x), '-', 2), split_part(trimmed(x), '-', 3))
        WHEN trimmed(x) RLIKE r'^\d{1,2}-[A-Za-z]{3}-\d{4}\z' AND month_of(split_part(trimmed(x), '-', 2)) IS NOT NULL
          THEN day_of(split_part(trimmed(x), '-', 3), month_of(split_part(trimmed(x), '-', 2)), split_part(trimmed(x), '-', 1)) END"""),
    ("reference_key(x STRING)", "STRING", "regexp_replace(upper(translate(x, '- ', '')), '^0+', '')"),
    ("vin_rest(x STRING)", "INT", "aggregate(sequence(1, 17), 0, (s, i) -> s + CASE WHEN i = 9 THEN 0 ELSE try_element_at(map("
        + ", ".join(f"'{c}', {v}" for c, v in VIN_VALUES.items()) + f"), substr(x, i, 1)) * element_at(array({', '.join(map(str, VIN_WEIGHTS))}), i) END) % 11"),
    ("vin_ok(x STRING)", "BOOLEAN", "coalesce(length(x) = 17 AND substr(x, 9, 1) = CASE vin_rest(x) WHEN 10 THEN 'X' ELSE CAST(vin_rest(x) AS STRING) END, false)"),
    ("list_price(model STRING, prompt BIGINT, completion BIGINT)", "BIGINT", f"coalesce((prompt * {_price(0)} + completion * {_price(1)} + 500000) DIV 1000000, 0)"),
    ("effective_price(stored BIGINT, model STRING, prompt BIGINT, completion BIGINT)", "BIGINT", "CASE WHEN stored <> 0 THEN stored ELSE list_price(model, prompt, completion) END"),
]


class StatementRows:
    """Rows of a file, as a table function: row_no, cells, error. A file that can't be read is one row with an error; kind is csv or xlsx."""

    def eval(self, content: bytes, kind: str):
        rows, error = X.parsed(bytes(content or b""), kind)
        for i, cells in enumerate(rows):
            yield i, cells, error


class StatementSheet:
    """A file as a table function: rows, all of them as one value, and error."""

    def eval(self, content: bytes, kind: str):
        yield X.parsed(bytes(content or b""), kind)


def register(spark: SparkSession) -> None:
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("statement_rows", F.udtf(StatementRows, returnType="row_no int, cells array<string>, error string"))
    spark.udtf.register("statement_sheet", F.udtf(StatementSheet, returnType="rows array<array<string>>, error string"))


def statement_fields(spark: SparkSession, files: str, view: str, kind: str = "csv") -> None:
    """A temporary view of the typed fields of every file of the table or view files (doc_id, content)."""
    rows = spark.sql(f"SELECT f.doc_id, r.* FROM {files} AS f, LATERAL statement_sheet(f.content, '{kind}') AS r")
    X.line_fields(rows, stacked=kind == "xlsx").createOrReplaceTempView(view)
