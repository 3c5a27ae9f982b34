"""Best-fit packing of token sequences by the linear grouping scheme.

Pieces of documents are counted by length: a histogram of at most as many rows as a sequence has tokens, whatever the size of the
corpus. On it alone the plan is made: large lengths are dealt into GROUPS groups of equal cardinality and rounded up to the largest
length of their group; how often each configuration of these few lengths is used is optimised by column generation; actual lengths
take the places of the rounded ones; what is left of the large ones, then the small ones, go by best fit in falling length into the
sequence with the least room that takes them. Which lengths are large, and how finely they are grouped, are the scheme's two parameters:
rounding costs room that only many small pieces fill, so each of TRIALS is planned, which takes seconds at any size, and the plan with
the fewest sequences stays. (The last trial, where only lengths over half a sequence are large, has configurations of one piece: there
the scheme is best fit in falling length.) The plan is a table of intervals: the pieces from one rank to another among those of
a length go to the sequences from one number on, so many in each. Its size follows from the number of lengths, so it is broadcast
(PLAN_ROWS says what it may have at most). Spark ranks the pieces of a length and looks up each one's interval; documents are not seen
by the driver.

A length may be that of a third of all pieces: ranks are counted where pieces are made, by (task, length), and shifted by prefix sums,
so no length is sorted or gathered anywhere.

Ids are those of the public tokenizer in its JSON file; they are made by tiktoken from the same merges, at four times the speed. Its
special tokens' strings are ordinary text.

Defined results: null text is empty and gives one piece, the end mark; repeated rows and null ids are packed as they are; a document
longer than a sequence is cut from its end, so only its first piece may be shorter; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import table

#: (part of the capacity above which a length is large, groups of large lengths).
TRIALS = ((1 / 8, 100), (1 / 4, 200), (2 / 5, 400), (1 / 2, 1024))
#: Rounds of column generation at most; every round keeps a valid plan.
ROUNDS = 2000
#: Intervals of one length at most, beyond which something is wrong with the plan.
PLAN_ROWS = 200_000
Interval = tuple[int, int, int, int, int]  # length, first rank, pieces, first sequence, pieces in each sequence


def _patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (copies of each size) and how often to use each: the optimum of the linear relaxation, rounded down."""
    k = len(sizes)
    size, want = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    reach = np.arange(capacity + 1)[:, None] - size[None, :]
    fits = reach >= 0
    reach = np.where(fits, reach, 0)
    for _ in range(ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(k))
        # The best configuration at these prices, one copy more a step, as long as a copy more pays.
        best, took = np.zeros(capacity + 1), []
        while True:
            gain = np.where(fits, best[reach] + worth[None, :], -1.0)
            pick = gain.argmax(1)
            new = gain[np.arange(capacity + 1), pick]
            better = new > best + 1e-12
            if not better.any():
                break
            took.append(np.where(better, pick, -1))
            best = np.where(better, new, best)
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        for step in reversed(took):
            if step[room] >= 0:
                column[step[room]] += 1
                room -= size[step[room]]
        used, enter = np.linalg.solve(basis, want), np.linalg.solve(basis, column)
        ratio = np.where(enter > 1e-9, np.maximum(used, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    left, out = list(demand), []
    for column, n in sorted(zip(basis.T.astype(int).tolist(), np.linalg.solve(basis, want)), key=lambda x: -x[1]):
        n = min([max(0, int(n + 1e-6)), *[have // c for have, c in zip(left, column) if c]])
        if n:
            out.append((column, n))
            left = [have - c * n for have, c in zip(left, column)]
    return out


class _Room:
    """Sequences by the room they have left: ranges of numbers for each room."""

    def __init__(self, capacity: int):
        self.capacity, self.of, self.rooms, self.n = capacity, {}, [], 0

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.of:
                bisect.insort(self.rooms, room)
                self.of[room] = []
            self.of[room].append((first, n))

    def place(self, length: int, rank: int, n: int) -> Iterator[Interval]:
        """Best fit of n pieces of one length, which have the ranks from rank on."""
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, there = self.of[room].pop()
                if not self.of[room]:
                    del self.of[room], self.rooms[at]
            else:
                room, first, there = self.capacity, self.n, -(-n // (self.capacity // length))
                self.n += there
            each = room // length
            full = min(there, n // each)
            if full:
                yield length, rank, full * each, first, each
                self.add(room - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if full < there and n:  # fewer are left than one sequence takes
                yield length, rank, n, first + full, n
                self.add(room - n * length, first + full, 1)
                full, n = full + 1, 0
            self.add(room, first + full, there - full)


def plan(histogram: dict[int, int], capacity: int, trials=TRIALS) -> tuple[list[Interval], int]:
    """Intervals of ranks by length, and the number of sequences: the best of the trials."""
    return min((_grouped(histogram, capacity, *t) for t in trials), key=lambda p: p[1])


def _grouped(histogram: dict[int, int], capacity: int, small: float, groups: int) -> tuple[list[Interval], int]:
    out, room, rank = [], _Room(capacity), dict.fromkeys(histogram, 0)
    large = [s for s in sorted(histogram, reverse=True) if s > capacity * small]
    whole = sum(histogram[s] for s in large)
    if whole:
        # Groups of equal cardinality in falling length: each a list of [length, pieces].
        bounds, parts, seen = [whole * i // groups for i in range(1, groups + 1)], [[]], 0
        for s in large:
            n = histogram[s]
            while n:
                take = min(n, bounds[len(parts) - 1] - seen)
                if take:
                    parts[-1].append([s, take])
                    seen, n = seen + take, n - take
                if seen == bounds[len(parts) - 1] and seen < whole:
                    parts.append([])
        # Groups of one rounded length are one.
        merged: dict[int, list] = {}
        for p in parts:
            if p:
                merged.setdefault(p[0][0], []).extend(p)
        sizes = list(merged)
        for column, n in _patterns(sizes, [sum(x[1] for x in merged[s]) for s in sizes], capacity):
            first, room.n = room.n, room.n + n
            # Actual lengths take the places, the longest first: what fills the n sequences changes where a length ends.
            cuts, slots = {0, n}, []
            for s, copies in zip(sizes, column):
                for _ in range(copies):
                    slot, at = [], 0
                    while at < n:
                        length, have = merged[s][0]
                        take = min(have, n - at)
                        out.append((length, rank[length], take, first + at, 1))
                        rank[length] += take
                        slot.append((at, length))
                        at += take
                        cuts.add(at)
                        if take == have:
                            merged[s].pop(0)
                        else:
                            merged[s][0][1] -= take
                    slots.append(slot)
            cuts = sorted(cuts)
            for a, b in zip(cuts, cuts[1:]):
                held = sum(slot[bisect.bisect_right(slot, (a, capacity)) - 1][1] for slot in slots)
                room.add(capacity - held, first + a, b - a)
    for s in sorted(histogram, reverse=True):
        out += room.place(s, rank[s], histogram[s] - rank[s])
    return out, room.n


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a byte-level BPE file in JSON: an id is a rank, since entries are numbered in the order of merges."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    # Bytes that print stand for themselves in the file, the others for characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {x["id"] for x in json.load(open(path, encoding="utf-8")).get("added_tokens", [])}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i not in special}


_ENCODINGS: dict = {}


def _encoding(shared):
    import tiktoken

    ranks, pattern, key = shared.value
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, with task and k: the k-th piece of its length in that task."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern, (vocabulary, pattern)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, k bigint" + ", ids array<int>" * with_ids

    def run(batches):
        encode, task, seen = _encoding(shared).encode_ordinary, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            at, rows, kept = [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                cut, piece = 0, 0
                while cut < len(ids):
                    till = cut + ((len(ids) - cut - 1) % capacity + 1)
                    part = ids[cut:till]
                    at.append(i)
                    rows.append((piece, cut, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
                    if with_ids:
                        kept.append(part.astype(np.int32).tolist())
                    cut, piece = till, piece + 1
            if rows:
                numbers = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 5)]
                columns = [batch.column(0).take(pa.array(at)), *numbers, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return table(docs.select("doc_id", "text").mapInArrow(run, schema), "packing-pieces")


def pack(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, capacity: int = 1024, trials=TRIALS, with_ids: bool = False) -> DataFrame:
    """Every piece with sequence_id and offset, its first token's place there."""
    spark = docs.sparkSession
    rows = pieces(docs, vocabulary, pattern, end_id, capacity, with_ids)
    counts = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    intervals, _ = plan(histogram, capacity, trials)
    if len(intervals) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(intervals)} intervals; {PLAN_ROWS} are expected at most: use trials of fewer groups")
    by_length: dict[int, list] = {}
    for length, *rest in intervals:
        by_length.setdefault(length, []).append(tuple(rest))
    plans = spark.createDataFrame(list(by_length.items()), "length bigint, plan array<struct<low:bigint,n:bigint,first:bigint,each:bigint>>")
    before = F.sum("c").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    shifts = counts.select("task", "length", before.alias("shift"))
    placed = rows.join(shifts, ["task", "length"]).join(F.broadcast(plans), "length").withColumn("rank", F.col("k") + F.col("shift"))
    found = F.filter("plan", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["low"] + p["n"]))[0]
    placed = placed.withColumn("p", found).withColumn("sequence_id", F.expr("p.first + (rank - p.low) div p.each"))
    # A sequence holds at most `capacity` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
