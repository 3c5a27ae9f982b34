"""Repeated passages by suffixes at minimisers, grouped by hash, with the occurrence that stays.

Suffixes are retained only where the content selects them: of each window of LENGTH words, at the place of its smallest
GRAM-word hash (the leftmost, of equal ones). Equal passages of LENGTH words or more therefore retain suffixes at the same
places. Each suffix stands with its stretch, the words of all windows that selected it.

Suffixes are grouped by a hash of their leading GRAM words, and those alone in their group go; nothing is sorted. The rest are
compared by the hashes of their stretches: where the whole stretch has an equal, all of it is repeated; where suffixes agree but
stretches differ (the edge of a passage), every window of the stretch is compared, for one suffix of each group of equal stretches. So
the result is exact: a word is reported if and only if it lies in a window of LENGTH words that stands at two places or more.
The first place of a window owns it. When spans that aren't owned are removed, every repeated window is left where it is owned.

Sorted neighbours would not be exact here. The neighbour of a sparse suffix shares the longest run of words to the right, but a
repeat of LENGTH words needs the longest sum of right and left: a suffix with a partner of 30 words on each side may have
neighbours with 40 to the right and none to the left, on either side of it. Comparing groups finds all.

Groups are counts, partial counts first, in place of a sorted order with extension of neighbours: a passage found in a third of
all documents is then a number, not a run of suffixes in one task. Stretches and windows are compared by 128 bits of two
polynomial hashes over 64-bit word hashes.

Defined results: null and empty texts, and texts under LENGTH words, have no spans; repeated rows repeat each other; null ids
are reported as null; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import release, table

LENGTH, GRAM = 50, 8
#: Different stretches around a gram from which it counts as hot, and the most hot grams that are broadcast.
HOT, MOST_HOT = 500, 100_000
_U = np.uint64
#: Odd multipliers of the rolling sums: over bytes, over the words of a gram, and two over the words of a stretch.
_BYTES, _GRAM, _A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class _Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64; the tables grow as far as the longest text."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(4096, 1 << (n - 1).bit_length())
            self.up, self.down = (np.concatenate(([_U(1)], np.cumprod(np.full(self.n, b, _U)))) for b in (self.base, self.inverse))
        return self.up[: n + 1], self.down[: n + 1]


_POWERS = {b: _Powers(b) for b in (_BYTES, _GRAM, _A, _B)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sums:
    """Prefix sums of values * base ** place; between(s, e) hashes values[s:e] whatever the place."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _POWERS[base](len(values))
        self.sums = np.concatenate(([_U(0)], np.cumsum(values * up[: len(values)])))

    def between(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(_U))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, _U)
    return Sums(raw.astype(_U) + _U(1), _BYTES).between(starts, ends)


def suffixes(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each retained suffix: its gram's hash, the first window that selected it, and how many did."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(len(words) - gram + 1)
    h = Sums(words, _GRAM).between(at, at + gram)
    best, span, width = at, 1, length - gram + 1

    def smaller(left, right):
        return np.where(h[right] < h[left], right, left)

    while 2 * span <= width:
        best, span = smaller(best[:-span], best[span:]), 2 * span
    best = best[:n] if span == width else smaller(best[:n], best[width - span :][:n])
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    return h[best[first]], first, np.diff(np.concatenate((first, [n])))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _retained(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                for rid, text in zip(some.column(0), some.column(1), strict=True):
                    words = word_hashes((text.as_py() or "").encode())
                    g, s, n = suffixes(words, length, gram)
                    if len(g):
                        e = s + n + length - 1
                        a, b = Sums(words, _A).between(s, e), Sums(words, _B).between(s, e)
                        for c, x in zip(cols, (np.full(len(g), rid.as_py(), np.int64), s, n, g, a, b), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) if c else pa.array([], pa.int64()) for c in cols], ["rid", "s", "n", "g", "a", "b"])

    return run


def _windows(length: int):
    """Rows (rid, text, picks [(s, n, c)]) to the hashes of all windows picked: wa, wb, rid, s, c."""

    def run(batches):
        for batch in batches:
            for rid, text, picks in zip(*batch.columns, strict=True):
                words = word_hashes((text.as_py() or "").encode())
                picks = picks.as_py()
                s = np.concatenate([np.arange(p["s"], p["s"] + p["n"]) for p in picks])
                c = np.concatenate([np.full(p["n"], p["c"], np.int64) for p in picks])
                a, b = Sums(words, _A).between(s, s + length), Sums(words, _B).between(s, s + length)
                yield pa.RecordBatch.from_arrays([_long(a), _long(b), _long(np.full(len(s), rid.as_py(), np.int64)), _long(s), _long(c)], ["wa", "wb", "rid", "s", "c"])

    return run


def _with_mixed(stretch: DataFrame) -> DataFrame:
    """stretch with mixed, true where other stretches share the gram and else NULL. Grams with over HOT stretches are met by a broadcast
    (16 bytes each, a HOT-th of the stretches at most, and MOST_HOT), so that the rows of such a gram needn't meet in one task."""
    grams = table(stretch.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "mixed")
    mixed, hot = grams.select("g", F.lit(True).alias("mixed")), grams.filter(F.col("k") > HOT).select("g", F.lit(True).alias("hot"))
    if not 0 < hot.count() <= MOST_HOT:
        return stretch.join(mixed, "g", "left")
    marked = stretch.join(F.broadcast(hot), "g", "left")
    rest = marked.filter("hot IS NULL").drop("hot").join(mixed, "g", "left")
    return marked.filter("hot").withColumnRenamed("hot", "mixed").unionByName(rest)


def _islands(found: DataFrame) -> DataFrame:
    """rid, s, e, owned, other: the union of rows (rid, s, e, own, orid, e0), cut where some owned one begins or ends. One sweep over a
    text's ends of spans; other is the orid of the row that reaches furthest among those begun."""
    begin, end = F.struct(F.col("s").alias("x"), F.lit(1).alias("d")), F.struct(F.col("e").alias("x"), F.lit(-1).alias("d"))
    ends = found.select("rid", F.explode(F.array(begin, end)).alias("p"), "own", F.struct("e", "orid").alias("far"))
    far = F.max(F.when(F.col("p.d") == 1, F.col("far"))).alias("far")
    ends = ends.groupBy("rid", F.col("p.x").alias("x")).agg(F.sum("p.d").alias("d"), F.sum(F.when(F.col("own"), F.col("p.d")).otherwise(0)).alias("o"), far)
    order = Window.partitionBy("rid").orderBy("x")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = ends.select("rid", "x", F.lead("x").over(order).alias("to"), F.sum("d").over(so_far).alias("d"), (F.sum("o").over(so_far) > 0).alias("owned"), F.max("far").over(so_far).alias("far")).filter("d > 0")
    turn = ~(F.lag("to").over(order).eqNullSafe(F.col("x")) & F.lag("owned").over(order).eqNullSafe(F.col("owned")))
    parts = parts.withColumn("part", F.sum(turn.cast("int")).over(so_far))
    return parts.groupBy("rid", "part").agg(F.min("x").alias("s"), F.max("to").alias("e"), F.first("owned").alias("owned"), F.min_by("far.orid", "x").alias("other")).drop("part")


def owned_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, doc_id, start_word, end_word, owned, first_doc_id: the words in windows of `length` words that stand at two places or more,
    as maximal spans cut where ownership changes. A window's first place, by (row id, word), owns it; a span is owned if its words lie
    in windows owned here. first_doc_id is a document that holds the span's beginning too, or this one if the span is owned."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = table(rows, "suffix-rows")
    kept = table(rows.select("rid", "text").mapInArrow(_retained(length, gram), "rid long, s long, n long, g long, a long, b long"), "suffixes")
    again = table(kept.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g"), "grams")
    near = table(kept.join(again, "g", "left_semi"), "neighbours")
    release(kept, again)

    # Equal stretches become one row, with the first place and the number of places.
    stretch = near.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "s", "n")).alias("one"))
    stretch = table(stretch, "stretches")
    every, stretch = stretch, table(_with_mixed(stretch), "stretches")
    release(every)
    whole = near.join(stretch.filter("c > 1").select("g", "a", "b", "one", "mixed"), ["g", "a", "b"])
    first = F.col("mixed").isNull() & (F.col("one.rid") == F.col("rid")) & (F.col("one.s") == F.col("s"))
    whole = whole.select("rid", "s", (F.col("s") + F.col("n") + (length - 1)).alias("e"), first.alias("own"), F.col("one.rid").alias("orid"))

    # Where stretches around one gram differ, the windows of one of each are compared.
    edge = stretch.filter("mixed").select("one.*", "c")
    edge = table(edge.groupBy("rid").agg(F.collect_list(F.struct("s", "n", "c")).alias("picks")), "edges")
    open_ = edge.join(rows.select("rid", "text"), "rid").select("rid", "text", "picks")
    windows = table(open_.mapInArrow(_windows(length), "wa long, wb long, rid long, s long, c long"), "windows")
    place = F.struct("rid", "s")
    release(edge)
    twice = windows.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("f")).filter("k > 1").select("wa", "wb", "f")
    single = windows.join(table(twice, "repeated-windows"), ["wa", "wb"], "left").filter("c > 1 OR f IS NOT NULL")
    own = F.col("f").isNull() | ((F.col("f.rid") == F.col("rid")) & (F.col("f.s") == F.col("s")))
    single = single.select("rid", "s", (F.col("s") + length).alias("e"), own.alias("own"), F.coalesce("f.rid", "rid").alias("orid"))

    spans = table(_islands(whole.unionByName(single)), "spans")
    release(near, stretch, windows)
    names = rows.select("rid", "doc_id")
    out = spans.join(names, "rid").withColumn("other", F.when(F.col("owned"), F.col("rid")).otherwise(F.col("other")))
    out = out.join(names.select(F.col("rid").alias("other"), F.col("doc_id").alias("first_doc_id")), "other")
    return out.select("rid", "doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), "owned", "first_doc_id")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word of each maximal span of words in windows of `length` words that stand at two places or more."""
    parts = owned_spans(docs, length, gram)
    order = Window.partitionBy("rid").orderBy("start_word")
    fresh = ~F.lag("end_word").over(order).eqNullSafe(F.col("start_word"))
    runs = parts.withColumn("run", F.sum(fresh.cast("int")).over(order))
    return runs.groupBy("rid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("rid", "run")


def op4(spark, sf_dir: str) -> DataFrame:
    return owned_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
