"""Evidence signals of extracted fields, as document-level aggregates joined back to the fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.constants import GRAMMARS, OEMS
from statera.functions import scalar as S


def footing_delta(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, delta: total less previous balance and lines; NULL without a total."""
    sums = lines.groupBy("doc_id").agg(F.sum("amount_cents").alias("lines"))
    out = totals.join(sums, "doc_id", "left")
    return out.select("doc_id", (F.col("total") - F.coalesce("previous", F.lit(0)) - F.coalesce("lines", F.lit(0))).alias("delta"))


def truth_delta(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, delta: previous balance, lines and adjustments less the total; 0 for a statement that foots."""
    sums = lines.groupBy("doc_id").agg(F.sum("amount_cents").alias("lines"))
    out = heads.join(sums, "doc_id", "left")
    return out.select("doc_id", (F.coalesce("previous", F.lit(0)) + F.coalesce("lines", F.lit(0)) + F.coalesce("adjustments", F.lit(0)) - F.col("total")).cast("bigint").alias("delta"))


def footing_ok(delta) -> F.Column:
    return F.when(S._col(delta).isNotNull(), F.when(F.abs(S._col(delta)) <= 1, 1.0).otherwise(0.0))


def residual_suspects(lines: DataFrame, deltas: DataFrame) -> DataFrame:
    """doc_id, line_no of the only line that alone explains a document's delta."""
    rows = lines.join(deltas.filter("abs(delta) > 1"), "doc_id").filter(S.plausible_residual("delta", "amount_cents"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return rows.withColumn("n", n).filter("n = 1").select("doc_id", "line_no")


def marque_vote(references: DataFrame) -> DataFrame:
    """doc_id, oem: the marque whose patterns match most references of the document; a tie for the first place elects none."""
    counted = references.groupBy("doc_id").agg(*[F.sum(hit).alias(o) for o, hit in _oem_hits("name", "value").items()])
    return counted.select("doc_id", _winner(F.col).alias("oem"))


def _oem_hits(name: str, value: str) -> dict[str, F.Column]:
    """A reference's match with each marque's pattern: 1 or 0."""
    hits = {}
    for oem in OEMS:
        hits[oem] = F.lit(0)
        for n, patterns in GRAMMARS.items():
            hits[oem] = hits[oem] + F.when((F.col(name) == n) & F.col(value).rlike(f"^(?:{patterns[oem]})\\z"), 1).otherwise(0)
    return hits


def _winner(votes) -> F.Column:
    """The marque of most votes (a column for each); NULL at a tie and without any."""
    best = F.greatest(*[votes(o) for o in OEMS])
    winners = F.filter(F.array(*[F.when(votes(o) == best, F.lit(o)) for o in OEMS]), lambda x: x.isNotNull())
    return F.when((best > 0) & (F.size(winners) == 1), F.get(winners, F.lit(0)))


def other_median_date(dates: DataFrame, row: str = "line_no") -> DataFrame:
    """doc_id, row, middle: the upper median of the document's other dates. Of all dates in order it is the one at place
    m = (n - 1) div 2, or the next where the row's own date stands at m or before."""
    order = Window.partitionBy("doc_id").orderBy("line_date", row)
    n = dates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = dates.withColumn("at", F.row_number().over(order) - 1).join(n, "doc_id").withColumn("m", F.expr("(n - 1) DIV 2"))
    two = rows.filter("at = m OR at = m + 1").groupBy("doc_id").agg(F.max(F.when(F.col("at") == F.col("m"), F.col("line_date"))).alias("a"), F.max(F.when(F.col("at") > F.col("m"), F.col("line_date"))).alias("b"))
    return rows.join(two, "doc_id").select("doc_id", row, F.when(F.col("at") <= F.col("m"), F.col("b")).otherwise(F.col("a")).alias("middle"))


def date_centres(fields: DataFrame) -> DataFrame:
    """field_id, centre of the window a date is judged in: the document's statement date, or, for that date itself and in documents
    without one, the upper median of the other dates. No date is judged by itself; one alone in its document has no centre."""
    dated = fields.filter("value_date IS NOT NULL")
    first = F.min_by(F.struct("field_id", "value_date"), "reading_pos").alias("a")
    anchors = dated.filter("name = 'statement_date' AND line_no IS NULL").groupBy("doc_id").agg(first).select("doc_id", "a.*").withColumnsRenamed({"field_id": "anchor_id", "value_date": "anchor"})
    others = other_median_date(dated.select("doc_id", "field_id", F.col("value_date").alias("line_date")), "field_id").select("field_id", "middle")
    out = dated.select("doc_id", "field_id").join(anchors, "doc_id", "left").join(others, "field_id")
    own = F.col("anchor").isNull() | (F.col("anchor_id") == F.col("field_id"))
    return out.select("field_id", F.when(own, F.col("middle")).otherwise(F.col("anchor")).alias("centre"))


def validator_pass(name, value, cents, day, anchor) -> F.Column:
    """VIN: check digit. Date: NULL without an anchor, 0 unparsed, else within the grace. Amount: parsed. Others NULL."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    vin = F.when(S._col(value).isNull(), 0.0).otherwise(flag(S.vin_ok(value)))
    date = F.when(S._col(day).isNull(), 0.0).when(S._col(anchor).isNull(), None).otherwise(flag(S.in_period(day, anchor, anchor)))
    return F.when(S._col(name) == "vin", vin).when(S._col(name).isin("line_date", "statement_date"), date).when(S._col(name).isin("line_amount", "total", "subtotal", "previous_balance"), flag(S._col(cents).isNotNull()))


def grammar_match(name, value, oem) -> F.Column:
    out = None
    for field in GRAMMARS:
        hit = F.when(S._col(value).isNull(), 0.0).when(S.grammar(field, value, oem), 1.0).otherwise(0.0)
        out = F.when(S._col(name) == field, hit) if out is None else out.when(S._col(name) == field, hit)
    return out


def footing_totals(fields: DataFrame) -> DataFrame:
    """doc_id, total, previous: the first read amount of each header; documents without a total have no row."""
    heads = fields.filter("line_no IS NULL AND name IN ('total', 'previous_balance') AND value_cents IS NOT NULL")
    pick = lambda n: F.min_by(F.when(F.col("name") == n, F.col("value_cents")), F.when(F.col("name") == n, F.col("reading_pos")))
    return heads.groupBy("doc_id").agg(pick("total").alias("total"), pick("previous_balance").alias("previous")).filter("total IS NOT NULL")


def typed(fields: DataFrame) -> DataFrame:
    """fields (family, raw_text) with value, value_cents, value_date."""
    out = fields.withColumn("value_cents", F.when(F.col("family") == "amount", S.amount_cents("raw_text"))).withColumn("value_date", F.when(F.col("family") == "date", S.parse_date("raw_text")))
    plain = F.nullif(S.stripped("raw_text"), F.lit(""))
    return out.withColumn("value", F.when(F.col("family") == "amount", S.format_cents("value_cents")).when(F.col("family") == "date", F.col("value_date").cast("string")).otherwise(plain))


def attach(fields: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """fields with the eight signals: self_consistency, det_llm_agreement, validator_pass, grammar_match, footing_ok, suspect,
    char_ambiguity and the route they have.

    All but the first two are read off the extraction itself. Those come from context (field_id and either) where it names the field, else
    stay as the row carries them. fields: field_id, doc_id, line_no, name, family, raw_text, value, value_cents, value_date, reading_pos, route.
    """
    carried = ["self_consistency", "det_llm_agreement"]
    out = fields.withColumns({c: F.lit(None).cast("double") for c in carried if c not in fields.columns})
    if context is not None:
        given = [c for c in carried if c in context.columns]
        out = out.join(context.select("field_id", *[F.col(c).alias(f"_{c}") for c in given]), "field_id", "left")
        out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in given}).drop(*[f"_{c}" for c in given])
    out = _of_document(out)
    new = {
        "validator_pass": validator_pass("name", "value", "value_cents", "value_date", "centre"),
        "grammar_match": grammar_match("name", "value", "oem"),
        "footing_ok": F.when(F.col("family") == "amount", footing_ok("delta")),
        "suspect": (F.col("name") == "line_amount") & F.coalesce("_suspect", F.lit(False)),
        "char_ambiguity": S.ambiguity(F.coalesce("raw_text", F.lit(""))),
    }
    return out.withColumns(new).drop("delta", "oem", "centre", "_suspect")


def _of_document(fields: DataFrame) -> DataFrame:
    """fields with delta, _suspect, oem and centre, as footing_delta, residual_suspects, marque_vote and date_centres have them, but as windows
    over a document's fields: rows dealt by document are not moved, others once, and a document's fields are sorted twice."""
    doc, name, head = Window.partitionBy("doc_id"), F.col("name"), F.col("line_no").isNull()
    cents = F.when(head, F.col("value_cents"))
    first = lambda n: F.min_by(F.when(name == n, cents), F.when((name == n) & cents.isNotNull(), F.col("reading_pos"))).over(doc)
    amount = F.when((name == "line_amount") & ~head, F.col("value_cents"))
    spoken = name.isin(*GRAMMARS) & F.col("value").isNotNull()
    dated = F.col("value_date").isNotNull()
    anchor = dated & (name == "statement_date") & head
    out = fields.withColumns({
        **{f"_{o}": F.sum(F.when(spoken, hit)).over(doc) for o, hit in _oem_hits("name", "value").items()},
        "_total": first("total"), "_previous": first("previous_balance"), "_lines": F.sum(amount).over(doc), "_n": F.count_if(dated).over(doc),
        "_anchor": F.min_by(F.when(anchor, F.struct("field_id", "value_date")), F.when(anchor, F.col("reading_pos"))).over(doc),
    })
    out = out.withColumn("delta", F.col("_total") - F.coalesce("_previous", F.lit(0)) - F.coalesce("_lines", F.lit(0)))
    out = out.withColumn("oem", _winner(lambda o: F.col(f"_{o}"))).drop(*[f"_{o}" for o in OEMS], "_total", "_previous", "_lines")
    explains = F.coalesce(amount.isNotNull() & (F.abs("delta") > 1) & S.plausible_residual("delta", amount), F.lit(False))
    out = out.withColumns({"_explain": F.count_if(explains).over(doc), "_line": F.max(F.when(explains, F.col("line_no"))).over(doc)})
    out = out.withColumn("_suspect", (F.col("_explain") == 1) & (F.col("_line") == F.col("line_no"))).drop("_explain", "_line")
    # As in other_median_date, among the dated fields of the document.
    out = out.withColumn("_at", F.when(dated, F.row_number().over(Window.partitionBy("doc_id", dated).orderBy("value_date", "field_id")) - 1)).withColumn("_m", F.expr("(_n - 1) DIV 2"))
    at = lambda i: F.max(F.when(F.col("_at") == F.col("_m") + i, F.col("value_date"))).over(doc)
    out = out.withColumns({"_here": at(0), "_next": at(1)})
    middle = F.when(F.col("_at") <= F.col("_m"), F.col("_next")).otherwise(F.col("_here"))
    own = F.col("_anchor").isNull() | (F.col("_anchor.field_id") == F.col("field_id"))
    out = out.withColumn("centre", F.when(dated, F.when(own, middle).otherwise(F.col("_anchor.value_date"))))
    known = F.col("doc_id").isNotNull()  # fields of no document have no neighbours
    out = out.withColumns({c: F.when(known, F.col(c)) for c in ("delta", "oem", "centre", "_suspect")})
    return out.drop("_n", "_anchor", "_at", "_m", "_here", "_next")
