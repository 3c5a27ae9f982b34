"""Substring dedup by content-defined chunks of a gear rolling hash.

A gear hash over the last 32 bytes is taken at every byte; a chunk ends where its masked bits are zero, so borders depend on
content alone and an insertion shifts only the chunks it touches. Distances between borders are kept within LEAST and MOST
bytes. Chunks are named by a 128-bit BLAKE2b digest and counted by digest with partial sums. A run is a stretch of
neighbouring repeated chunks that holds at least SPAN bytes, or a whole text whatever its length: shorter ones are chance or
stock phrases, and are left alone or reported with a flag. Of the places of a digest inside runs the first, by (row id, offset), owns it, and a run is cut into spans where that
changes: every digest in a run stands in one owned span, so what is left when the others are removed holds each of them
once. A repeated passage is seen by the chunks that lie in it whole: one of some
300 bytes holds SPAN bytes of them almost always, a shorter one less often.

Rows get an integer of their own in a table written first, since ids may be null or repeat. Digests of copies are counted
before they are shuffled, and the join that follows may be split by Spark where a digest is hot.

Defined results: null and empty texts have no chunks; texts of one chunk count like others; repeated rows are copies of each
other; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import release, table

LEAST, MOST, BITS, SPAN = 16, 256, 5, 80


def _gear() -> np.ndarray:
    """256 numbers of 32 bits by the rule: the first four bytes of SHA-256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()


def borders(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data, the last being its length."""
    n = len(data)
    if not n:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted values
        h[span:] += h[:-span] << np.uint32(span)
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, at = [], 0
    for c in cuts.tolist():
        while c - at > most:
            at += most
            out.append(at)
        if c - at >= least:
            at = c
            out.append(at)
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """rid, doc_id, at, size, last, a, b: each chunk's place, whether the text ends with it, and its digest as two longs."""
    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, size int, last boolean, a long, b long"

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            for part in range(0, batch.num_rows, 256):
                rid, row, at, size, last, digests = [], [], [], [], [], []
                for i in range(part, min(part + 256, batch.num_rows)):
                    data = (batch.column(2)[i].as_py() or "").encode()
                    start, r = 0, batch.column(0)[i].as_py()
                    for end in borders(data):
                        rid.append(r)
                        row.append(i)
                        at.append(start)
                        size.append(end - start)
                        last.append(end == len(data))
                        digests.append(hashlib.blake2b(data[start:end], digest_size=16).digest())
                        start = end
                two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                cols = [pa.array(rid, pa.int64()), ids.take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(last, pa.bool_())]
                cols += [pa.array(np.ascontiguousarray(two[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "at", "size", "last", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(run, schema)


def owned_spans(docs: DataFrame, span: int = SPAN, short: bool = False) -> DataFrame:
    """rid, run, doc_id, start, end, n_chunks, owned, first_doc_id: runs of at least span bytes or a whole text, cut where owned changes.

    With short, runs of fewer bytes are there too, and a column short tells them; they own and are owned like the others.

    owned is true where the chunks stand here first: such a span is the one to keep, the others can be removed. A run is
    measured whole, so a span of it may be shorter. first_doc_id is the row that owns the span's first chunk.
    """
    cut = table(chunks(docs), "chunks")
    seen = table(cut.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"), "chunk-digests")
    # Windows are over one row: a text's chunks fit in a task as its text does.
    order, run = Window.partitionBy("rid").orderBy("at"), Window.partitionBy("rid", "run")
    hits = cut.join(seen, ["a", "b"]).withColumn("to", F.col("at") + F.col("size"))
    hits = hits.withColumn("gap", (~F.lag("to").over(order).eqNullSafe(F.col("at"))).cast("int")).withColumn("run", F.sum("gap").over(order))
    bytes_, whole = F.max("to").over(run) - F.min("at").over(run), (F.min("at").over(run) == 0) & F.max("last").over(run)
    hits = hits.withColumn("short", (bytes_ < span) & ~whole)
    hits = table((hits if short else hits.filter("NOT short")).select("rid", "doc_id", "at", "to", "a", "b", "run", "short"), "chunk-hits")
    release(cut, seen)
    first = hits.groupBy("a", "b").agg(F.min(F.struct("rid", "at", "doc_id")).alias("f"))
    first = table(first.select("a", "b", F.col("f.rid").alias("frid"), F.col("f.at").alias("fat"), F.col("f.doc_id").alias("fdoc")), "chunk-owners")
    own = (F.col("rid") == F.col("frid")) & (F.col("at") == F.col("fat"))
    rows = hits.join(first, ["a", "b"]).select("rid", "doc_id", "run", "at", "to", "short", own.alias("own"), "fdoc")
    turn = ~F.lag(F.struct("run", "own")).over(order).eqNullSafe(F.struct("run", "own"))
    rows = rows.withColumn("turn", turn.cast("int")).withColumn("part", F.sum("turn").over(order))
    ends = [F.min("run").alias("run"), F.min("doc_id").alias("doc_id"), F.min("at").alias("start"), F.max("to").alias("end"), F.count(F.lit(1)).cast("int").alias("n_chunks")]
    if short:
        ends.append(F.max("short").alias("short"))
    return rows.groupBy("rid", "part").agg(*ends, F.bool_and("own").alias("owned"), F.min_by("fdoc", "at").alias("first_doc_id")).drop("part")


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, start, end, n_chunks, owned, first_doc_id: maximal runs of repeated chunks of at least span bytes, by byte offset.

    owned is true where every chunk of the run stands here first; see owned_spans for the parts to keep.
    """
    parts = [F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").cast("int").alias("n_chunks")]
    out = owned_spans(docs, span).groupBy("rid", "run").agg(*parts, F.bool_and("owned").alias("owned"), F.min_by("first_doc_id", "start").alias("first_doc_id"))
    return out.drop("rid", "run")


def op7(spark, sf_dir: str) -> DataFrame:
    return owned_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "run")
