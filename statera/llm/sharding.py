"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded digest and ranked; a row's place is its fractional rank
(rank - 1 + u) / n with one offset u per source, so every source is spread evenly over [0, 1). The rows in order of place
are cut into shards of equal counts, hence every shard holds each source in its share of the mixture.

No source and no shard is ever ranked in one task: ranks are counted inside small cells of the digest (or of the place)
and shifted by the number of rows in the cells before, which is a prefix sum over at most CELLS rows a source.

Defined results: null text has size 16 and CRC 0; null sources form a source of their own; null ids and repeated rows are
rows like any other, ties fall to (digest, id, size, CRC); no rows give no rows; other columns are ignored. Equal texts are
not kept together: with counts at most one apart a group larger than a shard could not be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import source_key, table, unit

#: Cells of the digest, three hex digits. A source of 3 billion rows has under a million rows a cell.
CELLS = 4096


def interleave(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot of every row; shard sizes differ by one row at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        source_key().alias("k"),
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    rows = rows.withColumn("d", digest).withColumn("cell", F.conv(F.substring("d", 1, 3), 16, 10).cast("int"))
    rows = table(rows, "shard-rows")

    by_source = Window.partitionBy("k")
    cells = rows.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select(
        "k",
        "cell",
        (F.sum("c").over(by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(by_source).alias("n"),
    )
    in_cell = Window.partitionBy("k", "cell").orderBy("d", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(in_cell)).join(cells, ["k", "cell"])
    offset = unit(F.md5(F.concat(F.lit(f"{seed}/"), F.col("k")).cast("binary")))
    place = (F.col("before") + F.col("r") - 1 + offset) / F.col("n")
    placed = ranked.withColumn("place", place).withColumn("g", F.floor(F.col("place") * CELLS).cast("int")).drop("cell", "before", "r", "n")
    placed = table(placed, "shard-places")

    # At most CELLS rows, so one task sums them and every task may hold them.
    cuts = placed.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    cuts = cuts.select("g", (F.sum("c").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    in_g = Window.partitionBy("g").orderBy("place", "k", "d", "doc_id", "size", "text_crc32")
    out = placed.withColumn("r", F.row_number().over(in_g)).join(F.broadcast(cuts), "g").withColumn("at", F.expr("before + r - 1"))
    out = out.withColumn("shard", F.expr(f"CAST(at * {shards} DIV n AS INT)"))
    out = out.withColumn("slot", F.expr(f"at - (shard * n + {shards - 1}) DIV {shards}"))
    return out.select("doc_id", "size", "text_crc32", "source", "shard", "slot")


def op1(spark, sf_dir: str) -> DataFrame:
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
