"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. The Manhattan
distance of two vectors never exceeds the Hamming distance of the fingerprints, so a range join of the vectors within
radius 4 loses no link. The 32 coordinates form SUBGRIDS subgrids. Vectors at distance 4 or less differ in at most four of them,
so they lie in the same cell of the grid spanned by some three of seven: 35 cells per distinct fingerprint hold every pair.
More subgrids mean more but finer cells; advised_subgrids names the cheapest number for a corpus, and any gives the same links.
Inside a cell the Manhattan bound is tested first (on counts in unary code, where it is a bit count), then the exact distance.

Distinct fingerprints are joined, not documents. A cell reports a spanning forest of its links, not all pairs, so thousands
of near copies cost thousands of edges. Cells are counted first; those above CELL members are cut into chunks, and each pair
of chunks is searched by a task of its own: no link is lost, no group is held whole.

Defined results: null and wordless texts have fingerprint zero, linked like any other; null ids are members but never name
a component (a component of null ids alone has a null id); repeated rows share a fingerprint; no rows give no rows; other
columns are ignored (or kept, in keep_one).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import packed, release, row_hash, table, unpacked
from statera.llm.graph import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Segments, and the subgrids they form.
SEGMENTS, SUBGRIDS = 32, 7
#: Hot cells that are broadcast at most (16 bytes each); more are joined by a shuffle.
HOT = 100_000
#: Members of a cell that one task searches.
CELL = 20_000
EVEN = 0x5555555555555555


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned: a bit is set if it is in over half of the shingles' XXH64 values, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    view, digest = memoryview(whole), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounded memory for texts of any length
        h = np.array([digest(view[a:b], seed) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, crc (of the text), fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "crc", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), _crc().alias("crc"), "text").mapInArrow(run, f"doc_id {kind}, crc long, fp long")


def _crc():
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def advised_subgrids(n: int, test: float = 0.01) -> int:
    """The number of subgrids that makes rows and pair tests of n fingerprints fewest, a test costing `test` rows. A segment's bit
    count holds 1.5 bits, so a cell's key parts fingerprints by 48 * (g - 4) / g bits, and there are as many keys as choices of four."""
    return min(range(RADIUS + 1, 17), key=lambda g: comb(g, RADIUS) * (1 + test * n / 2 ** (1.5 * SEGMENTS * (g - RADIUS) / g)))


def _cells(fps: DataFrame, subgrids: int) -> DataFrame:
    """cell, fp: each fingerprint in the cells of its bit-count vector. A cell's key is a digest of its grid and counts: two
    cells under one key only cost a few more tests."""
    cuts = [SEGMENTS * i // subgrids for i in range(subgrids + 1)]
    masks = [sum(3 << 2 * i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    grids = [_signed(sum(some)) for some in combinations(masks, subgrids - RADIUS)]
    # Each segment's bit count in unary code (00, 01, 11), as in _unary.
    counts = F.expr(f"((fp | shiftrightunsigned(fp, 1)) & {EVEN}L) | shiftleft(fp & shiftrightunsigned(fp, 1) & {EVEN}L, 1)")
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(g))) for i, g in enumerate(grids)])
    return fps.select("fp", counts.alias("counts")).select(F.explode(keys).alias("cell"), "fp")


def _unary(x: np.ndarray) -> np.ndarray:
    """The bit count of each two-bit segment in unary code: 0, 1, 2 become 00, 01, 11."""
    hi, lo, even = x >> np.uint64(1), x, np.uint64(EVEN)
    return ((hi | lo) & even) | (((hi & lo) & even) << np.uint64(1))


def _near(x: np.ndarray, y) -> np.ndarray:
    near = np.bitwise_count(_unary(x) ^ _unary(y)) <= RADIUS
    near[near] = np.bitwise_count((x ^ y)[near]) <= RADIUS
    return near


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, found breadth first; memory follows their number."""
    out, rest = [], np.sort(fps)
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = _near(rest, x)
            if near.any():
                out += [(int(y), int(x)) for y in rest[near]]
                todo += list(rest[near])
                rest = rest[~near]
    return out


def _links(cells: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links inside the cells, which stand together. Small cells: all of them, tested lag by lag; others: a spanning forest."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    small, found = np.repeat(sizes <= 16, sizes), []
    place = np.arange(len(cells)) - np.repeat(starts, sizes)
    for lag in range(1, int(sizes[sizes <= 16].max(initial=1))):
        i = np.flatnonzero(small & (place >= lag))
        i = i[_near(fps[i], fps[i - lag])]
        found.append(np.stack((fps[i], fps[i - lag]), 1))
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        found.append(np.array(_forest(np.unique(fps[s : s + n])), np.uint64).reshape(-1, 2))
    found = np.concatenate(found or [np.empty((0, 2), np.uint64)])
    return np.unique(found, axis=0)  # the same pair meets in many cells


def _search(batches):
    """Rows (cell, fp) in order of cell to edges (u, v)."""

    def out(links):
        u, v = (np.ascontiguousarray(x).view(np.int64) for x in links.T)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    cells, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        c, f = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        cells, fps = np.concatenate((cells, c)), np.concatenate((fps, f.view(np.uint64)))
        others = np.flatnonzero(cells != cells[-1]) if len(cells) else []
        if len(others):  # the last cell may go on in the next batch
            cut = int(others[-1]) + 1
            yield out(_links(cells[:cut], fps[:cut]))
            cells, fps = cells[cut:], fps[cut:]
    if len(cells):
        yield out(_links(cells, fps))


def near_edges(fps: DataFrame, cell: int = CELL, subgrids: int = SUBGRIDS) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the distinct fingerprints fps (fp)."""
    cells = _cells(fps, subgrids)
    hot = table(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell), "hot-cells")
    found = hot.count()
    if found:
        # A cell above the limit becomes m chunks; each pair of chunks meets in a cell of its own. Any link lies in one of them, so
        # their forests together join whatever the links of the cell join.
        m = F.ceil(F.col("n") / F.lit(cell / 2)).cast("int")
        split = cells.join(F.broadcast(hot) if found <= HOT else hot, "cell", "left").withColumn("m", m)
        split = split.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")).cast("int"))
        others = F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))
        split = split.withColumn("other", F.explode(others))
        pair = F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other"))
        cells = split.select(F.when(F.col("m").isNull(), F.col("cell")).otherwise(pair).alias("cell"), "fp")
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search, "u long, v long")
    return table(found.distinct(), "links")


def clusters(docs: DataFrame, id_col: str = "doc_id", cell: int = CELL) -> DataFrame:
    """doc_id, crc, fp, component_id, keep_crc of every row. component_id is the smallest id reachable over links of RADIUS bits at
    most; (component_id, keep_crc) names the row that stands for the component."""
    rows = table(fingerprints(docs, id_col), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("crc"))
    fps = table(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    edges = near_edges(fps.select("fp"), cell)
    roots = components(edges)
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = table(named, "roots")
    ids = table(named.groupBy("root").agg(F.min("first").alias("first")), "component-ids")
    by_fp = named.drop("first").join(ids, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.crc").alias("keep_crc"))
    by_fp = table(by_fp, "components")
    release(fps, named, ids)
    return rows.join(by_fp, "fp").select("doc_id", "crc", "fp", "component_id", "keep_crc")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (then CRC, then row_hash), with all columns of docs."""
    spread = clusters(docs)
    chosen = spread.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("crc") == F.col("keep_crc")))
    chosen = table(chosen.groupBy("doc_id", "crc").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("doc_id", "id"), "chosen")
    rows = packed(docs, id=F.col("doc_id"), crc=_crc(), h=row_hash(docs))
    out = rows.alias("r").join(chosen.alias("c"), F.expr("r.id <=> c.id AND r.crc = c.crc"), "left_semi")
    if chosen.filter("rows > 1").limit(1).count():  # rows that repeat, id and text
        out = out.groupBy("id", "crc").agg(F.min_by("doc", "h").alias("doc"))
    return unpacked(out, docs)


def op8(spark, sf_dir: str) -> DataFrame:
    out = clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
