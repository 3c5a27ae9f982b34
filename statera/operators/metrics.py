"""Evaluation against truth: field accuracy, detection of exceptions, summary tiles, run notes and the choice of scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.constants import FAMILIES, TIERS
from statera.functions import scalar as S
from statera.operators import costs
from statera.operators.signals import typed
from statera.scratch import table


_TRUTH = ("truth", "truth_cents", "truth_day")


def _compared(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """fields, with the other columns of answers (doc_id, key, _TRUTH and more), and correct."""
    return _with_verdict(fields.withColumn("key", S.rendered_key("line_no", "name")).join(answers, ["doc_id", "key"], "left"))


def _with_verdict(fields: DataFrame) -> DataFrame:
    """fields with correct, without the truth they carry."""
    right = S.field_correct("family", "value", "value_cents", "value_date", *_TRUTH)
    # Unread text is wrong; an unread value of another family compares as unequal by itself.
    unread = F.col("value").isNull() & F.col("family").isin("reference", "text")
    return fields.withColumn("correct", F.when(right.isNotNull(), right & ~unread)).drop(*_TRUTH)


def judged(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """fields with correct: NULL where truth has no value at the field's place. truth: doc_id, line_no, name, truth, truth_cents, truth_day."""
    return _compared(fields, truth.select("doc_id", S.rendered_key("line_no", "name").alias("key"), *_TRUTH))


def judged_in_place(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """judged(), dealt by document: fields and truth, which has at most one value a place, are moved once, and stay for what else is done with a
    document's fields. fields needn't be typed yet: doc_id, line_no, name, family and raw_text are enough. Truth of names that no field has is
    not moved."""
    known = F.broadcast(fields.select("name").distinct())  # one row a name
    rows = fields.select("doc_id", "line_no", "name", F.struct(*[c for c in fields.columns if c not in ("doc_id", "line_no", "name")]).alias("_field"))
    values = truth.join(known, "name", "left_semi").select("doc_id", "line_no", "name", F.struct(*_TRUTH).alias("_truth"))
    both = rows.unionByName(values, allowMissingColumns=True).repartition("doc_id")
    there = F.first("_truth", ignorenulls=True).over(Window.partitionBy("doc_id", "name", "line_no"))
    both = both.withColumn("_truth", F.when(F.col("doc_id").isNotNull(), there)).filter("_field IS NOT NULL")
    found = typed(both.select("doc_id", "line_no", "name", "_field.*", "_truth.*"))
    return _with_verdict(found).select(*fields.columns, "value", "value_cents", "value_date", "correct")


def score_fields(fields: DataFrame, truth: DataFrame, rendered: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """family, tier, in_truth, expected, extracted, spurious, canonical, raw of one split, in the order of families and tiers.

    A value of the truth is expected where the document printed it (rendered: doc_id, key, text); documents that were never extracted
    count too. A field is spurious where truth has no value. Cells that expect nothing are left out. manifest: doc_id, split, tier.
    """
    docs = manifest.filter(F.col("split") == split).select("doc_id", "tier")
    held = lambda rows: rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    places = truth.select("doc_id", S.rendered_key("line_no", "name").alias("key"), F.col("family").alias("_family"), *_TRUTH)
    # Truth and print meet once, in the documents of the split alone, and are read from there for both sides.
    answers = table(held(places).withColumn("_true", F.lit(True)).join(held(rendered.select("doc_id", "key", "text")), ["doc_id", "key"], "full"), "answers")
    has = F.coalesce("truth", F.col("truth_cents").cast("string"), F.col("truth_day").cast("string")).isNotNull()
    asked = answers.filter(F.col("_true") & has).join(docs, "doc_id").groupBy(F.col("_family").alias("family"), "tier").agg(F.count(F.lit(1)).alias("in_truth"), F.count("text").alias("expected"))
    seen = _compared(fields.join(docs, "doc_id"), answers.drop("_family", "_true"))
    known, verbatim = F.col("correct").isNotNull(), F.coalesce(F.col("raw_text") == F.col("text"), F.lit(False))
    seen = seen.groupBy("family", "tier").agg(
        F.count_if(known).alias("extracted"), F.count_if(~known).alias("spurious"), F.count_if(F.coalesce("correct", F.lit(False))).alias("canonical"), F.count_if(known & verbatim).alias("raw")
    )
    place = lambda c, order: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    out = asked.filter("expected > 0").join(seen, ["family", "tier"], "left").na.fill(0)
    return out.orderBy(place("family", FAMILIES), place("tier", TIERS))  # at most a cell per family and tier


def detections(exceptions: DataFrame, injections: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(discrepancy_id, exception_id): type and document agree, and the line or the entry does. The line is the injection's line_no; where
    injections have none, lines (doc_id, line_no, source_entry_id) name the entry's line."""
    truth = injections.withColumnRenamed("line_no", "at_line")
    if "at_line" not in truth.columns:
        of_line = lines.select("doc_id", F.col("line_no").alias("at_line"), F.col("source_entry_id").alias("entry_id"))
        truth = truth.join(of_line, ["doc_id", "entry_id"], "left")
    truth = truth.select("discrepancy_id", "doc_id", "at_line", F.col("entry_id").alias("at_entry"), F.col("expected_exception").alias("exception_type"), F.col("dollar_impact_cents").alias("injected_cents"))
    both = exceptions.join(truth, ["doc_id", "exception_type"])
    hit = F.coalesce(F.col("line_no") == F.col("at_line"), F.lit(False)) | F.coalesce(F.col("entry_id") == F.col("at_entry"), F.lit(False))
    return both.filter(hit).select("discrepancy_id", "exception_id", "exception_type", "injected_cents").distinct()


def score_recon(exceptions: DataFrame, injections: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per type: injected and caught counts and cents; exceptions that match no injection are false."""
    hits = table(detections(exceptions, injections, lines), "hits")
    i = injections.groupBy(F.col("expected_exception").alias("exception_type")).agg(F.count(F.lit(1)).alias("injected"), F.sum(F.abs("dollar_impact_cents")).alias("injected_cents"))
    true = exceptions.join(hits.select("exception_id").distinct().withColumn("hit", F.lit(True)), "exception_id", "left")
    x = true.groupBy("exception_type").agg(F.count_if(F.col("hit").isNotNull()).alias("detected_true"), F.count_if(F.col("hit").isNull()).alias("detected_false"))
    c = hits.select("discrepancy_id", "exception_type", "injected_cents").distinct().groupBy("exception_type").agg(F.sum(F.abs("injected_cents")).alias("caught_cents"))
    return i.join(x, "exception_type", "full").join(c, "exception_type", "left").na.fill(0)


def dollars_at_risk() -> Column:
    """Aggregate over exceptions (status, dollar_impact_cents): what the open ones stand for, whatever their sign; 0 over none."""
    return F.coalesce(F.sum(F.when(F.col("status") == "open", F.abs("dollar_impact_cents"))), F.lit(0)).cast("bigint")


def summary(documents: DataFrame, fields: DataFrame, exceptions: DataFrame, calls: DataFrame) -> DataFrame:
    """The seven numbers of the summary tile in one row: one pass over each table, and the one-row results side by side.

    documents: route. fields: status. exceptions: status, dollar_impact_cents. calls as costs.priced takes them; a stored
    price of zero is priced by today's table.
    """
    d = documents.agg(F.count_if(F.col("route") != "unprocessable").alias("documents_processed"))
    f = fields.agg(F.count(F.lit(1)).alias("fields_extracted"), F.count_if(F.col("status") == "auto_accepted").alias("auto_accepted"), F.count_if(F.col("status") == "needs_review").alias("review_queue_depth"))
    e = exceptions.agg(F.count_if(F.col("status") == "open").alias("open_exception_count"), dollars_at_risk().alias("gross_dollars_at_risk_cents"))
    p = costs.effective(calls).agg(F.coalesce(F.sum("effective"), F.lit(0)).cast("bigint").alias("list_price_microusd"))
    one = [x.withColumn("_one", F.lit(1)) for x in (d, f, e, p)]  # each is a single row
    return one[0].join(one[1], "_one").join(one[2], "_one").join(one[3], "_one").drop("_one")


def summary_ratios(tile: DataFrame) -> DataFrame:
    """cost_per_document (floored) and auto_accept_rate; both 0 over nothing."""
    cost = F.when(F.col("documents_processed") == 0, F.lit(0)).otherwise(F.expr("list_price_microusd DIV documents_processed"))
    rate = F.when(F.col("fields_extracted") == 0, F.lit(0.0)).otherwise(F.col("auto_accepted") / F.col("fields_extracted"))
    return tile.select(cost.cast("bigint").alias("cost_per_document"), rate.alias("auto_accept_rate"))


def run_counts(documents: DataFrame, served: tuple[str, ...] = ("csv", "xlsx", "digital_pdf")) -> DataFrame:
    """route, outcome, n of a run: unprocessable, served, or unserved where no reader of the run takes the route."""
    outcome = F.when(F.col("route") == "unprocessable", "unprocessable").when(F.col("route").isin(*served), "served").otherwise("unserved")
    return documents.groupBy("route", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def run_notes(counts: DataFrame, served: tuple[str, ...] = ("csv", "xlsx", "digital_pdf")) -> DataFrame:
    """One sentence on what was read and, if anything was left, which routes with how many documents, by name. One row a route."""
    left = F.sort_array(F.collect_list(F.when(F.col("outcome") == "unserved", F.format_string("%s (%d)", "route", "n"))))
    head = f"Routed by file signature. Routes read: {', '.join(sorted(served))}."
    more = F.when(F.size("left") > 0, F.concat(F.lit(" Routed but not read: "), F.array_join("left", ", "), F.lit("."))).otherwise("")
    return counts.agg(left.alias("left")).select(F.concat(F.lit(head), more).alias("notes"))


def latest_scorecard(cards: DataFrame) -> DataFrame:
    """The newest card that carries an evaluation, by (created_at, run_id); the newest of all if none does. cards: created_at, run_id, evaluated."""
    return cards.orderBy(F.desc("evaluated"), F.desc("created_at"), F.desc("run_id")).limit(1)


def counterparts(cards: DataFrame) -> DataFrame:
    """run_id, mode, other_run_id: for each card the first other run, by name, of the same config and split, for every mode it lacks.
    cards: run_id, config_hash, split, modes (array). Cards of a config are joined on it: a config has few runs."""
    own = cards.select("run_id", "config_hash", "split", F.col("modes").alias("own"))
    each = cards.select(F.col("run_id").alias("other_run_id"), "config_hash", "split", F.explode("modes").alias("mode"))
    # Only the two first runs of a mode can be the first other one.
    first = Window.partitionBy("config_hash", "split", "mode").orderBy("other_run_id")
    each = each.withColumn("i", F.row_number().over(first)).filter("i <= 2").drop("i")
    found = own.join(each, ["config_hash", "split"]).filter((F.col("run_id") != F.col("other_run_id")) & ~F.array_contains("own", F.col("mode")))
    return found.groupBy("run_id", "mode").agg(F.min("other_run_id").alias("other_run_id"))


