"""Fields of scanned statements from the JSON answers of a model that read their pages: a table (doc_id, doc_type, answer, second), where
answer is what is taken and second, if there is one, a repeated reading that only says how sure the first is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.constants import FIELD_FAMILIES
from statera.functions import scalar as S
from statera.operators.reviewdb import plausible_box

# The fields of a statement's head, those of a line by kind of document, the frame of boxes, and the most lines and pages.
HEADER_FIELDS = ("statement_number", "statement_date", "previous_balance", "subtotal", "total")
LINE_FIELDS = {
    "parts_statement": ("invoice_number", "line_date", "description", "line_amount"),
    "warranty_credit_memo": ("claim_number", "ro_number", "vin", "line_date", "description", "line_amount"),
    "floorplan_statement": ("vin", "line_date", "description", "line_amount"),
    "incentive_statement": ("program_code", "vin", "line_date", "description", "line_amount"),
}
FRAME, MOST_LINES, MOST_PAGES = 1000, 5000, 50

_VALUE = "struct<raw:string,normalized:string>"
_EVERY = tuple(dict.fromkeys(n for names in LINE_FIELDS.values() for n in names))
_LINE = f"row_position:bigint,page:bigint,bbox:array<bigint>,{','.join(f'{n}:{_VALUE}' for n in _EVERY)}"
#: What an answer is parsed as.
SCHEMA = f"struct<{','.join(f'{n}:{_VALUE}' for n in HEADER_FIELDS)},lines:array<struct<{_LINE}>>>"


def _wrong(parsed: Column) -> Column:
    """True for an answer that is no JSON object, or holds what no page can: too many lines, a row or page out of range, a value that lacks
    its raw or its normalized text, a box without four sides."""
    half = lambda v: v.isNotNull() & (v["raw"].isNull() | v["normalized"].isNull())

    def bad(line):
        place = ~F.coalesce(line["row_position"].between(1, MOST_LINES), F.lit(False)) | ~F.coalesce(line["page"], F.lit(0)).between(0, MOST_PAGES - 1)
        out = place | (line["bbox"].isNotNull() & (F.size(line["bbox"]) != 4))
        for n in _EVERY:
            out = out | half(line[n])
        return out

    heads = F.lit(False)
    for n in HEADER_FIELDS:
        heads = heads | half(parsed[n])
    lines = F.coalesce(parsed["lines"], F.array().cast(f"array<struct<{_LINE}>>"))
    return parsed.isNull() | heads | (F.size(lines) > MOST_LINES) | F.exists(lines, bad)


def _taken(text: Column) -> Column:
    """What a text is parsed as; NULL where it can't be taken. It is parsed once, however often it is looked at."""
    seen = F.when(S.stripped(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}))
    return F.get(F.transform(F.array(seen), lambda p: F.when(~_wrong(p), p)), F.lit(0))


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers with parsed (NULL where the answer can't be taken) and error: malformed, or NULL. A missing answer is malformed."""
    out = answers.withColumn("parsed", _taken(F.col(column)))
    return out.withColumn("error", F.when(F.col("parsed").isNull(), "malformed"))


def _items(p: Column, first: bool) -> Column:
    """Every value of a parsed answer, the head's and then the lines', in their order; none of NULL."""
    no = lambda kind: F.lit(None).cast(kind)
    item = lambda line_no, name, v, page, box: F.struct(F.lit(first).alias("first"), line_no.alias("line_no"), F.lit(name).alias("name"), v.alias("v"), page.alias("page"), box.alias("box"))
    heads = F.array(*[item(no("bigint"), n, p[n], no("bigint"), no("array<bigint>")) for n in HEADER_FIELDS])
    lines = F.flatten(F.transform(p["lines"], lambda x: F.array(*[item(x["row_position"], n, x[n], F.coalesce(x["page"], F.lit(0).cast("bigint")), x["bbox"]) for n in _EVERY])))
    return F.filter(F.concat(heads, F.coalesce(lines, F.slice(heads, 1, 0))), lambda x: x["v"].isNotNull())


def _values(answers: DataFrame) -> DataFrame:
    """doc_id, doc_type, asked, i, first, line_no (NULL in the head), name, raw, normalized, page, box and family of every value of the first answers that
    can be taken, and of their second ones (not first); asked: whether the second can be taken. Each text is parsed once."""
    both = F.struct(_taken(F.col("answer")).alias("a"), _taken(F.col("second")).alias("b"))
    # Generators, unlike projections, are never merged with what reads their columns, so nothing is parsed again.
    # Fields are taken of columns: x.a or x.* could as well mean a table or a subquery called x that answers come from.
    out = answers.select("doc_id", "doc_type", F.explode(F.array(both)).alias("_both"))
    out = out.select("doc_id", "doc_type", *[F.col("_both")[n].alias(n) for n in ("a", "b")]).filter(F.col("a").isNotNull())
    every = F.concat(_items(F.col("a"), True), _items(F.col("b"), False))
    out = out.select("doc_id", "doc_type", F.col("b").isNotNull().alias("asked"), F.posexplode_outer(every).alias("i", "_item")).filter(F.col("_item").isNotNull())
    item = [F.col("_item")[n].alias(n) for n in ("first", "line_no", "name", "page", "box")] + [F.col("_item")["v"][n].alias(n) for n in ("raw", "normalized")]
    return _families(out.select("doc_id", "doc_type", "asked", "i", *item))


def _canonical(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with name, name_cents and name_day: a text (name_t) as its family reads it; all NULL where it doesn't parse. Flat columns of their
    own: inside a condition or a lambda each step would be worked out anew at every mention."""
    t, cents, day = (f"{name}{x}" for x in ("_t", "_cents", "_day"))
    rows = rows.withColumn(t, text)
    rows = rows.withColumn(cents, S.amount_cents(F.when(F.col("family") == "amount", F.col(t)))).withColumn(day, S.parse_date(F.when(F.col("family") == "date", F.col(t))))
    return rows.withColumn(name, F.when(F.col("family") == "amount", S.format_cents(cents)).when(F.col("family") == "date", F.col(day).cast("string")).otherwise(F.nullif(F.col(t), F.lit(""))))


def _compared(rows: DataFrame) -> DataFrame:
    """The first answer's values with _said (their normalized text _said_t, as _canonical reads it), self_consistency, and last: whether no
    later value of the answer has their place."""
    rows = _canonical(rows, S.stripped(F.col("normalized")), "_said").withColumn("_place", F.concat_ws(":", F.coalesce(F.col("line_no").cast("string"), F.lit("head")), "name"))
    place, said = Window.partitionBy("doc_id", "_place"), F.struct(F.col("_said").alias("value"))
    mine, other = F.when(F.col("first"), F.col("i")), F.when(~F.col("first"), F.col("i"))
    rows = rows.withColumns({"_a": F.max_by(said, mine).over(place), "_b": F.max_by(said, other).over(place), "last": F.max(mine).over(place) == F.col("i")}).filter("first")
    same = F.col("_b").isNotNull() & F.col("_a.value").eqNullSafe(F.col("_b.value"))
    return rows.withColumn("self_consistency", F.when(F.col("asked"), F.when(same, 1.0).otherwise(0.0))).drop("_a", "_b", "_place")


def _families(rows: DataFrame) -> DataFrame:
    return rows.withColumn("family", F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_FAMILIES.items() for x in kv]), F.col("name")))


def agreement(answers: DataFrame) -> DataFrame:
    """doc_id, line_no, name, self_consistency of each value of the first answer where the second one can be taken: 1 where both read the
    same, compared in canonical form (two values that don't parse are the same), else 0, as where the second lacks it. Of a row read
    twice in one answer the last reading counts. Documents without a second answer have no rows."""
    rows = _compared(_values(answers.filter(F.col("second").isNotNull())))
    return rows.filter("asked AND last").select("doc_id", "line_no", "name", "self_consistency")


def fields(answers: DataFrame) -> DataFrame:
    """Typed fields of the answers: field_id, doc_id, line_no, name, family, raw_text, value, value_cents, value_date, page, bbox, source,
    self_consistency.

    The normalized text is read first, and the raw one where that doesn't parse. Lines give the fields of their kind of document only, none
    where the kind is unknown. A box that can't be a printed value's is dropped. Answers that can't be taken give no fields (parsed
    names them). doc_id is the key of answers; a row read twice by one answer stays twice.
    """
    allowed = F.create_map(*[x for kind, names in LINE_FIELDS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    held = F.col("line_no").isNull() | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("doc_type")), F.col("name")), F.lit(False))
    rows = _compared(_values(answers).filter(held)).withColumn("raw_text", S.strip_control(F.col("raw"))).withColumn("_clean_t", S.stripped(S.strip_control(F.col("normalized"))))
    # Most texts hold no control character, and most parse: the other two readings are of NULL then.
    rows = _canonical(rows, F.when(F.col("_clean_t") != F.col("_said_t"), F.col("_clean_t")), "_other")
    alike, c = F.col("_clean_t") == F.col("_said_t"), ("", "_cents", "_day")
    rows = rows.withColumns({f"_c{x}": F.when(alike, F.col(f"_said{x}")).otherwise(F.col(f"_other{x}")) for x in c})
    rows = _canonical(rows, F.when(F.col("_c").isNull(), S.stripped(F.col("raw_text"))), "_printed")
    rows = rows.withColumns({f"_d{x}": F.when(F.col("_c").isNull(), F.col(f"_printed{x}")).otherwise(F.col(f"_c{x}")) for x in c})
    x0, y0, x1, y1 = (F.get(F.col("box"), F.lit(i)) / FRAME for i in range(4))
    box = F.when(plausible_box(x0, y0, x1, y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    where = F.when(F.col("line_no").isNull(), "header").otherwise(F.lpad(F.col("line_no").cast("string"), 4, "0"))
    return rows.select(
        F.concat_ws("-", F.lit("fld"), "doc_id", where, "name").alias("field_id"), "doc_id", F.col("line_no").cast("int").alias("line_no"), "name", "family", "raw_text",
        F.col("_d").alias("value"), F.col("_d_cents").alias("value_cents"), F.col("_d_day").alias("value_date"), F.col("page").cast("int").alias("page"), box.alias("bbox"),
        F.lit("llm_vision").alias("source"), "self_consistency",
    )
