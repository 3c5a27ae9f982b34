"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.scratch import folder, release, release_all, scratch_dir, table

__all__ = ["folder", "packed", "release", "release_all", "row_hash", "scratch_dir", "source_key", "table", "unit", "unpacked"]


def source_key(col: str = "source") -> Column:
    """A source as a key that is never null: null and the empty string stay apart, and null sorts last."""
    return F.when(F.col(col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), F.col(col)))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """doc (all columns of docs in one struct) and the columns given: whatever docs are called by, no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n) for n, c in more.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of packed rows; those named in new take their value from there."""
    return rows.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns of a row: rows alike in everything are alike in it, so it orders rows the same way in every run."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain)


def unit(hex_text: Column) -> Column:
    """The first 7 hex digits of a digest as a double strictly between 0 and 1."""
    return (F.conv(F.substring(hex_text, 1, 7), 16, 10).cast("long") + F.lit(0.5)) / F.lit(268435456.0)
