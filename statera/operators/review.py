"""Review tables: corrections as an append-only log, queues, decisions, and table maintenance without a transactional store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.functions import scalar as S
from statera.operators.ranks import ranked

#: A page whose offset is no larger is sorted for straight away.
SHALLOW = 10_000


def latest(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key, value of the newest entry of each key. max_by needs one pass and one shuffle of partial results."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def with_latest(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """fields with current: the newest correction, else the extracted value."""
    new = latest(corrections, "field_id", "new_value", "seq")
    return fields.join(new, "field_id", "left").withColumn("current", F.coalesce("new_value", "value"))


def effective_typed(rows: DataFrame) -> DataFrame:
    """cents and day re-read from a correction where there is one, else as stored."""
    c = F.col("new_value")
    return rows.withColumn("cents", F.when(c.isNull(), F.col("value_cents")).when(F.col("family") == "amount", S.amount_cents(c))).withColumn("day", F.when(c.isNull(), F.col("value_date")).when(F.col("family") == "date", S.parse_date(c)))


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0, steps: Sequence[Column] = ()) -> DataFrame:
    """A page in a total order: the k best of each part are merged, the rest never moves.

    A page further down than SHALLOW rows is looked for by steps, if there are any: columns that never fall along the order, coarse before
    fine, each a step among rows alike in the ones before (a cell of the first key, the key itself, a prefix of the second). Rows are
    counted by step, those that hold the page stay, and the next step parts them, until few are left to sort. What is before the page
    is counted and never sorted or moved.
    """
    if not 1 <= limit <= 500 or not 0 <= offset <= 10**9:
        raise ValueError("limit is 1 to 500, offset 0 to 1e9")
    for i in range(len(steps) if offset > SHALLOW else 0):
        at = F.struct(*steps[: i + 1])
        counts = rows.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        end = F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as there are steps
        ends = counts.withColumn("_end", end).filter((F.col("_end") > offset) & (F.col("_end") - F.col("_n") < offset + limit))
        held = ends.orderBy("_end").collect()  # each holds a row of the page: at most `limit` of them
        if not held:
            return rows.limit(0)
        few = F.broadcast(rows.sparkSession.createDataFrame(held, ends.schema).select("_at"))
        rows, offset = rows.withColumn("_at", at).join(few, "_at", "left_semi").drop("_at"), offset - (held[0]["_end"] - held[0]["_n"])
        if sum(h["_n"] for h in held) <= SHALLOW:
            break
    return rows.orderBy(*order).offset(offset).limit(limit)


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal what is wanted; None wants nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of new take the place of rows of old with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_documents(old: DataFrame, new: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """All rows of the given documents go, the new ones come."""
    return old.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def carry_decisions(fresh: DataFrame, old: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human decisions outlive a rebuild: status and confidence stay; a corrected field ends human_corrected."""
    kept = old.filter(F.col("status").startswith("human_")).select("field_id", F.col("status").alias("old_status"), F.col("confidence").alias("old_confidence"))
    touched = corrections.select("field_id").distinct().withColumn("touched", F.lit(True))
    out = fresh.join(kept, "field_id", "left").join(touched, "field_id", "left")
    status = F.when(F.col("touched"), "human_corrected").otherwise(F.coalesce("old_status", "status"))
    return out.withColumn("status", status).withColumn("confidence", F.coalesce("old_confidence", "confidence")).drop("old_status", "old_confidence", "touched")


def reattach_resolutions(findings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A finding keeps its resolution if id and all three amounts are the same, NULL being equal to NULL."""
    money = ["dollar_impact_cents", "statement_amount_cents", "ledger_amount_cents"]
    r = resolutions.select("exception_id", "resolution", *[F.col(m).alias(f"r_{m}") for m in money])
    out = findings.join(r, "exception_id", "left")
    same = F.col("resolution").isNotNull()
    for m in money:
        same = same & F.col(m).eqNullSafe(F.col(f"r_{m}"))
    return out.withColumn("status", F.when(same, "resolved").otherwise("open")).withColumn("resolution", F.when(same, F.col("resolution"))).drop(*[f"r_{m}" for m in money])


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, cleared, added, risk_change between two sets of open exceptions."""
    a = before.select("doc_id", "exception_id", F.abs("dollar_impact_cents").alias("was"))
    b = after.select("doc_id", "exception_id", F.abs("dollar_impact_cents").alias("now"))
    both = a.join(b, ["doc_id", "exception_id"], "full")
    return both.groupBy("doc_id").agg(F.count_if(F.col("now").isNull()).alias("cleared"), F.count_if(F.col("was").isNull()).alias("added"), (F.coalesce(F.sum("now"), F.lit(0)) - F.coalesce(F.sum("was"), F.lit(0))).alias("risk_change"))


def assemble(fields: DataFrame) -> DataFrame:
    """Lines from fields: a line needs an amount and a date; of a name's readings the last wins; the sign makes the type."""
    wanted = ["line_amount", "line_date", "invoice_number"]
    last = fields.groupBy("doc_id", "line_no", "name").agg(F.max_by("raw_text", "reading_pos").alias("text"))
    wide = last.groupBy("doc_id", "line_no").pivot("name", wanted).agg(F.first("text"))
    out = wide.select("doc_id", "line_no", S.amount_cents("line_amount").alias("amount_cents"), S.parse_date("line_date").alias("line_date"), "invoice_number")
    return out.filter("amount_cents IS NOT NULL AND line_date IS NOT NULL").withColumn("line_type", F.when(F.col("amount_cents") >= 0, "charge").otherwise("credit"))


def round_robin(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with turn: the rank inside the group in order of the key's digest. Taking turn by turn interleaves the groups."""
    return ranked(rows, [group], F.col(key)).withColumnRenamed("rn", "turn").drop("n")
