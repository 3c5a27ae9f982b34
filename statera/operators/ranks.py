"""Ranks of rows inside groups that may hold most of a table, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.functions import scalar as S

#: Cells of a digest: three hex digits.
CELLS = 4096


def digest(key: Column) -> Column:
    return F.md5(key.cast("string").cast("binary"))


def ranked(rows: DataFrame, by: list[str], key: Column, values: list[Column] = (), bucket: Column | None = None) -> DataFrame:
    """rows with rn (from 1) and n (rows of the group): in each group of by in order of values, then of the digest of key, then key.

    Rows are counted by bucket (a step that rises with the first value, or none), values and a cell of the digest; running sums of the counts
    give each cell its first rank, and rows are ranked inside their cell. Rows alike in values are spread over cells. Keys are structs, in
    which NULL equals NULL, so rows with NULLs in by or values keep their ranks.
    """
    keyed = rows.withColumn("_key", key.cast("string")).withColumn("_d", digest(key))
    keyed = keyed.withColumn("_of", F.struct(*by)).withColumn("_at", F.struct(F.lit(0) if bucket is None else bucket, *values, F.substring("_d", 1, 3)))
    cells = keyed.groupBy("_of", "_at").agg(F.count(F.lit(1)).alias("_c"))
    sums = running(cells, ["_of"], [F.col("_at")], F.col("_at.col1"), {"_c": "_end"}, "n")
    starts = sums.select("_of", "_at", (F.col("_end") - F.col("_c")).alias("_start"), "n")
    inner = F.row_number().over(Window.partitionBy("_of", "_at").orderBy("_d", "_key"))
    out = keyed.withColumn("_r", inner).join(starts, ["_of", "_at"]).withColumn("rn", (F.col("_start") + F.col("_r")).cast("bigint"))
    return out.drop("_of", "_at", "_key", "_d", "_r", "_start")


def running(counts: DataFrame, by: list[str], order: list[Column], bucket: Column, sums: dict[str, str], total: str, down: bool = False) -> DataFrame:
    """counts with running sums in each group of by in the given order, the row included: sums maps a column to the name of its sum; total
    names the whole sum of the first of them.

    bucket is a step of the order: from row to row it never falls, or with down never rises, and a group has a bounded number of steps.
    Sums run inside a bucket and over the buckets of a group, so no task orders a whole group. NULLs are a group or a bucket of their own.
    """
    keyed = counts.withColumn("_group", F.struct(*by)).withColumn("_bucket", F.struct(bucket))
    steps = keyed.groupBy("_group", "_bucket").agg(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(sums)])
    before = Window.partitionBy("_group").orderBy(F.desc("_bucket") if down else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_sum0").over(Window.partitionBy("_group")).alias(total)
    steps = steps.select("_group", "_bucket", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(sums))], whole)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumns({name: F.sum(c).over(inside) for c, name in sums.items()}).join(steps, ["_group", "_bucket"])
    out = out.withColumns({name: F.col(name) + F.col(f"_before{i}") for i, name in enumerate(sums.values())})
    return out.drop("_group", "_bucket", *[f"_before{i}" for i in range(len(sums))])


def share_step(p: Column) -> Column:
    """A step that rises with a share from 0 to 1: even in the middle, even in the logit at both ends, where scores crowd. 3,600 steps.
    NULL is NULL."""
    return F.when(p.isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 1024) + F.floor(S.logit(p) * 32))
