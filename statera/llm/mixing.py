"""Mixing sources to target weights by systematic sampling.

A source with target t and size s expects t / s copies of each document. The expected copies are summed along the source,
one random offset u is added, and a document is emitted once for each integer boundary its sum crosses. Along the source
the documents stand in order of size, then of a seeded digest: neighbours are alike in size, so the words taken stay within
about one document of the target. Ranks are counted in cells (source, size, digest prefix) and shifted by prefix sums over
sizes and over prefixes, so that no source and no size is ranked in one task.

The targets are filled over a table of one row a source in one task, which is meant for the sources of a mixture, some thousands
at most, and not for a source per host.

Defined results: null text has size 0; null sources form one source, last in order; null ids and repeated rows are rows of
their own; a source without words has target 0 and gives nothing; no rows give no rows; other columns are ignored (or kept, in
mix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import packed, row_hash, source_key, table, unit, unpacked

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """k, source_size, target. Targets are weight * level, but at most `most` times the source's size; what is cut off is shared
    again by weight. With the sources in order of cap / weight, level = (total - caps before) / (weights from here on) at the first
    source whose cap isn't reached. One row a source: the table has the size of the mixture's configuration.
    """
    order = Window.orderBy("k")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("full", F.col("cap") / F.col("w") <= F.col("left") / F.col("open"))
    w = w.withColumn("first", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("q"), F.col("k"), "left", "open"))).over(every))
    share = (F.col("w") * F.col("first.left")) / F.col("first.open")
    target = F.when(F.col("full") | F.col("first").isNull(), F.col("cap").cast("double")).otherwise(share)
    return w.select("k", "source_size", target.alias("target"))


def copies(docs: DataFrame, seed: int = 29, weights=WEIGHTS, most: int = MOST_COPIES, key: Column | None = None) -> DataFrame:
    """The plan: doc_id, crc, h, k, size, source_size, target, copies of every row. h is key, or a hash of the text; it parts rows that
    are alike in id and CRC, so that reruns agree."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if key is None else key
    rows = docs.select("doc_id", source_key().alias("k"), size.alias("size"), crc.alias("crc"), h.alias("h"))
    rows = rows.withColumn("d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("crc").cast("string")).cast("binary")))
    rows = table(rows.withColumn("cell", F.substring("d", 1, 3)), "mix-rows")

    cells = rows.groupBy("k", "size", "cell").agg(F.count(F.lit(1)).alias("c"))
    sizes = cells.groupBy("k", "size").agg(F.sum("c").alias("c"))
    to_here = lambda w: F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    sizes = sizes.select("k", "size", to_here(Window.partitionBy("k").orderBy("size")).alias("smaller"))
    cells = cells.select("k", "size", "cell", to_here(Window.partitionBy("k", "size").orderBy("cell")).alias("before"))
    cells = cells.join(sizes, ["k", "size"])
    goal = table(targets(rows.groupBy("k").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    cells = table(cells.join(goal, "k"), "mix-cells")

    in_cell = Window.partitionBy("k", "size", "cell").orderBy("d", "doc_id", "crc", "h")
    out = rows.withColumn("r", F.row_number().over(in_cell)).join(cells, ["k", "size", "cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("smaller") + F.col("before") + F.col("r")
    u = unit(F.md5(F.concat(F.lit(f"{seed}/"), F.col("k")).cast("binary")))
    crossed = F.floor(at * F.col("rate") + u) - F.floor((at - 1) * F.col("rate") + u)
    out = out.withColumn("rate", rate).withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return out.select("doc_id", "crc", "h", "k", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 29, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as it was drawn, with the columns of docs."""
    h = row_hash(docs)
    # Rows alike in every column share one line of the plan; it doesn't matter which of them is copied.
    plan = table(copies(docs, seed, weights, most, h).groupBy("h", "crc").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows")), "mix-plan")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    hit = packed(docs, h=h, crc=crc).join(plan.filter("total > 0").select("h", "crc", "total"), ["h", "crc"])
    if plan.filter("rows > 1").limit(1).count():
        hit = hit.groupBy("h", "crc").agg(F.first("doc").alias("doc"), F.first("total").alias("total"))
    return unpacked(hit.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("total").cast("int")))), docs)


def op5(spark, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
