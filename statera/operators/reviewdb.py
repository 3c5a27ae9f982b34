"""The review store: documents, fields, exceptions and thresholds as tables, built from extractions, truth labels and a reconciliation.

A store is a folder of Parquet tables. A build writes a new folder and carries human decisions over from the one before, so readers see
the old store whole until the new one is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statera.constants import OEMS, SCHEDULES
from statera.functions import scalar as S
from statera.operators import review as V
from statera.sources import files as X

IDENTITY = ("dealer_id", "oem", "doc_type", "period_start", "period_end")


def reconcilable(documents: DataFrame) -> DataFrame:
    """Documents whose five identity columns (as text) are there and can be read; the others can't be reconciled, which is no error."""
    ok = F.lit(True)
    for c in IDENTITY:
        ok = ok & F.col(c).isNotNull()
    iso = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull()
    ok = ok & F.col("oem").isin(*OEMS) & F.col("doc_type").isin(*SCHEDULES) & iso("period_start") & iso("period_end")
    return documents.filter(F.coalesce(ok, F.lit(False)))


def routed(manifest: DataFrame, extraction: DataFrame, files: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """manifest with route and error: what the extraction recorded, or, for documents it doesn't have, what their bytes say now."""
    known = extraction.select("doc_id", "route", "error", F.lit(True).alias("_known"))
    rest = manifest.join(known, "doc_id", "left_anti").select("doc_id")
    fresh = X.route(files.join(rest, files.path == rest.doc_id, "left_semi"), layers).select(F.col("path").alias("doc_id"), "route", "error")
    return manifest.join(known.drop("_known").unionByName(fresh), "doc_id", "left")


def document_rows(manifest: DataFrame, extraction: DataFrame, files: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """A row per manifest record: its identity from truth (NULL without), the read type or else truth's, route and error."""
    out = routed(manifest, extraction, files, layers)
    read = extraction.select("doc_id", F.col("doc_type").alias("_read"))
    out = out.join(read, "doc_id", "left").withColumn("doc_type", F.coalesce("_read", "doc_type"))
    return out.select("doc_id", "doc_type", "tier", "route", "split", "error", "dealer_id", "period_start", "period_end")


def exception_rows(findings: DataFrame, decisions: DataFrame, existing: DataFrame, fallback: str = "review") -> DataFrame:
    """findings as they are stored: status and resolution by the standing decision, whose three amounts must still hold, and the run id of
    the document's earlier rows, or the fallback. existing: doc_id, run_id of what is stored."""
    runs = existing.groupBy("doc_id").agg(F.min("run_id").alias("run_id"))
    out = V.reattach_resolutions(findings.drop("status", "resolution"), decisions).join(runs, "doc_id", "left")
    return out.withColumn("run_id", F.coalesce("run_id", F.lit(fallback)))


def with_truth_numbers(assembled: DataFrame, truth: DataFrame) -> DataFrame:
    """Statements (doc_id, statement_number, statement_date, read from fields) with truth's number and date where nothing was read."""
    t = truth.select("doc_id", F.col("statement_number").alias("_n"), F.col("statement_date").alias("_d"))
    out = t.join(assembled, "doc_id", "left")
    return out.select("doc_id", F.coalesce("statement_number", "_n").alias("statement_number"), F.coalesce("statement_date", "_d").alias("statement_date"))


def crop_sources(fields: DataFrame) -> DataFrame:
    """field_id, page, bbox (only of exact boxes with all corners), row_position, expected_rows and hint (only of lines that a vision model
    read, expected_rows where its numbering runs from 1 without a gap). fields: source, line_no, crop_kind, page, x0, y0, x1, y1."""
    vision = F.coalesce((F.col("source") == "llm_vision") & F.col("line_no").isNotNull(), F.lit(False))
    corners = ("page", "x0", "y0", "x1", "y1")
    whole = F.lit(True)
    for c in corners:
        whole = whole & F.col(c).isNotNull()
    box = F.when(whole, F.struct(*corners))
    counts = fields.filter(vision).groupBy("doc_id").agg(F.count_distinct("line_no").alias("_n"), F.max("line_no").alias("_last"))
    out = fields.join(counts, "doc_id", "left")
    rows = F.when(vision & (F.col("_n") == F.col("_last")), F.col("_last"))
    return out.select("field_id", F.coalesce("page", F.lit(0)).alias("page"), F.when(F.col("crop_kind") == "exact_bbox", box).alias("bbox"), F.when(vision, F.col("line_no")).alias("row_position"), rows.alias("expected_rows"), F.when(vision, box).alias("hint"))


def plausible_box(x0, y0, x1, y1, least: float = 1.5, most: float = 200.0) -> Column:
    """Whether a box that a model gave lies on the page (shares of it) and has a line's shape: wider than high, but not a hair."""
    a, b, c, d = (S._col(x) for x in (x0, y0, x1, y1))
    inside = a.between(0, 1) & b.between(0, 1) & c.between(0, 1) & d.between(0, 1) & (a < c) & (b < d)
    return F.coalesce(inside & ((c - a) / F.nullif(d - b, F.lit(0.0))).between(least, most), F.lit(False))


def review_detail(items: DataFrame, documents: DataFrame, fields: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """One nested row per item (field_id): the field, its document, its signals, and the other fields of its line by name."""
    here = items.select("field_id").join(fields, "field_id")
    line = fields.select("doc_id", "line_no", F.col("field_id").alias("other"), F.struct("name", "raw_text", "field_id").alias("n"))
    beside = here.select("field_id", "doc_id", "line_no").join(line, ["doc_id", "line_no"]).filter("other <> field_id")
    beside = beside.groupBy("field_id").agg(F.sort_array(F.collect_list("n")).alias("neighbours"))  # the fields of one line
    out = here.join(documents.select("doc_id", F.struct("doc_id", "route", "tier").alias("document")), "doc_id").join(beside, "field_id", "left")
    empty = F.array().cast("array<struct<name:string,raw_text:string,field_id:string>>")
    return out.select("field_id", F.struct("name", "family", "raw_text", "value").alias("item"), "document", F.struct(*signals).alias("signals"), F.coalesce("neighbours", empty).alias("neighbours"))


def asked_detail(fields: DataFrame, asked, documents: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """review_detail of the fields for which asked is true: fields are dealt by document once, and those of a line meet where they lie."""
    rows = fields.withColumn("_asked", F.coalesce(asked, F.lit(False))).repartition("doc_id")
    line = F.collect_list(F.struct("name", "raw_text", "field_id")).over(Window.partitionBy("doc_id", "line_no"))  # the fields of one line
    rows = rows.withColumn("_line", line).filter("_asked AND field_id IS NOT NULL")
    others = F.sort_array(F.filter("_line", lambda n: n["field_id"] != F.col("field_id")))
    empty = F.array().cast("array<struct<name:string,raw_text:string,field_id:string>>")
    out = rows.withColumn("neighbours", F.when(F.col("line_no").isNotNull(), others).otherwise(empty)).drop("_line")
    out = out.join(documents.select("doc_id", F.struct("doc_id", "route", "tier").alias("document")), "doc_id")
    return out.select("field_id", F.struct("name", "family", "raw_text", "value").alias("item"), "document", F.struct(*signals).alias("signals"), "neighbours")


def migrated(old: DataFrame, schema: StructType) -> DataFrame:
    """old with the columns of schema that it lacks, as NULLs, in schema's order, and its own others behind; doing it twice changes nothing."""
    have = {f.name for f in old.schema}
    wanted = [F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return old.select(*wanted, *[F.col(f"`{c}`") for c in old.columns if c not in schema.names])


def replace_thresholds(store: str, thresholds: DataFrame, run_id: str) -> None:
    """The applied thresholds are those of one run: all rows of the table go, the run's come. A family without a threshold has no row."""
    rows = thresholds.filter("threshold IS NOT NULL").select("family", "threshold", "n", "accepted", "right", F.lit(run_id).alias("run_id"), F.lit("train").alias("fit_split"), F.lit("calibration").alias("threshold_split"))
    rows.write.mode("overwrite").parquet(f"{store}/thresholds")


def provider_pool(calls: DataFrame, capabilities: dict[str, tuple[str, ...]], needed: str) -> DataFrame:
    """The providers of calls that can do what is needed; capabilities is a table of the configuration."""
    able = [p for p, can in capabilities.items() if needed in can]
    return calls.select("provider").distinct().filter(F.col("provider").isin(able) if able else F.lit(False))


def batch(files: DataFrame, kind: str = "csv", parallel: int = 8) -> DataFrame:
    """The files read by at most `parallel` tasks at a time, rows in order of document and row whatever task was first."""
    return X.cell_rows(files.repartition(parallel, "doc_id"), kind).orderBy("doc_id", "row_no")


def build(spark: SparkSession, store: str, documents: DataFrame, fields: DataFrame, exceptions: DataFrame, thresholds: DataFrame, run_id: str, old: str | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """Writes a store and returns its counts in one row: documents, fields, exceptions, auto_accepted. Human decisions of the store
    `old` on fields outlive the build, and a corrected field ends human_corrected."""
    if old is not None:
        log = corrections if corrections is not None else fields.limit(0).select("field_id")
        fields = V.carry_decisions(fields, spark.read.parquet(f"{old}/fields"), log)
    for name, rows in (("documents", documents), ("fields", fields), ("exceptions", exceptions)):
        rows.write.parquet(f"{store}/{name}")
    replace_thresholds(store, thresholds, run_id)
    count = lambda name, *more: spark.read.parquet(f"{store}/{name}").agg(F.count(F.lit(1)).alias(name), *more).withColumn("_one", F.lit(1))
    auto = F.count_if(F.col("status") == "auto_accepted").alias("auto_accepted")
    return count("documents").join(count("fields", auto), "_one").join(count("exceptions"), "_one").drop("_one")  # single rows
