"""Merkle manifest of a dataset: one root over sorted rows, a proof for every row, and replicas checked against the root.

Leaves are digests of whole rows. Sorted runs of leaves (by source, then doc_id) are written as level 0 of a node store in
the shared folder; level l + 1 is made from level l alone, every three consecutive nodes of a source giving their digest, and
is written beside it as partition `level=l+1`, until one node of a source is left. The roots of the sources are the leaves of
a second tree of the same kind. Proofs are read from the store by coordinate: from the top down, the rows of a level are
joined to the proofs of their parents by (source, run), both dealt by these coordinates, so a proof is extended once for each
node and not once for each leaf. No level is held in memory or sent to the driver; the driver sees one number, the size of
the largest source, which says how many levels there are.

A source may hold most of the rows: leaves are dealt by ranges of (source, doc_id, leaf), counted in each range, and numbered
by prefix sums over these counts; all later steps are keyed by (source, run).

Defined results: null columns are `-` in a leaf; a null doc_id stands before others and is never tampered with; ties of doc_id
are ordered by their leaf, so rows alike in all five columns stand side by side and each has its own place and proof. A null
source is a source, the first one; an empty string another. No rows give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import folder, release, table

#: Children of a node.
ARITY = 3
_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<l:string,r:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**columns: Column) -> Column:
    """Digest of a row: each column as its UTF-8 byte count, a colon and its value, or `-` if null."""
    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return sha(*[part(columns[c]) for c in _COLUMNS])


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows as a stored table with idx (from 0 in each group of by, in order) and n (rows of the group). No group is sorted in one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)
    # A table written once: a task that runs again reads the same places.
    runs = table(runs.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), f"{name}-runs")
    cells = runs.groupBy(by, "_p").agg(F.min("_i").alias("_low"), F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(by)
    before = F.sum("_c").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    cells = cells.select(by, "_p", (before - F.col("_low")).alias("_shift"), F.sum("_c").over(group).alias("n"))
    out = table(runs.join(cells, [by, "_p"]).withColumn("idx", F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift"), name)
    release(runs)
    return out


@dataclass
class Tree:
    """Node store of one tree a group: `levels[l]` holds the runs of level l as (grp, run, kids), kids being (payload, h) in order."""

    levels: list[DataFrame]
    tops: DataFrame  # grp, n, h


def build(leaves: DataFrame, payload: list[str], name: str) -> Tree:
    """leaves: grp, idx, n, h and payload columns, which the lowest level keeps beside the digests."""
    store = folder(leaves.sparkSession, name)
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, levels, tops, span = leaves, [], leaves.filter("n = 1").select("grp", "n", "h"), 1
    while span < most:
        kid = F.struct((F.col("idx") % ARITY).alias("at"), "h", *(payload if span == 1 else []))
        runs = level.filter(F.col("n") > span).groupBy("grp", F.floor(F.col("idx") / ARITY).alias("run")).agg(
            F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        runs = table(runs.withColumn("h", F.sha2(F.array_join("kids.h", ""), 256)), name, f"{store}/level={len(levels)}")
        levels.append(runs)
        level, span = runs.select("grp", F.col("run").alias("idx"), "n", "h"), span * ARITY
        tops = tops.unionByName(level.filter((F.col("n") <= span)).select("grp", "n", "h"))
    return Tree(levels, table(tops, name, f"{store}/tops"))


def _opened(runs: DataFrame, payload: list[str]) -> DataFrame:
    """Nodes of a level out of their runs: grp, idx, run, step (digests to the left and to the right in the run) and payload."""
    hs = F.col("kids.h")
    at = F.col("at")
    left = F.array_join(F.slice(hs, F.lit(1), at), "")
    right = F.array_join(F.slice(hs, at + 2, F.lit(ARITY)), "")
    rows = runs.select("grp", "run", "kids", F.posexplode("kids").alias("at", "kid"))
    return rows.select("grp", (F.col("run") * ARITY + at).alias("idx"), "run", F.struct(left.alias("l"), right.alias("r")).alias("step"),
                       *[F.col("kid").getField(c).alias(c) for c in ("h", *payload)])


def proofs(tree: Tree, above: DataFrame, payload: list[str], leaves: DataFrame, carry: list[str]) -> DataFrame:
    """grp, h, payload, carry and path (steps from a leaf to the root) of every leaf; above holds grp, n, carry and path of the tops."""
    paths = None
    for l in range(len(tree.levels), 0, -1):
        tops = above.filter((F.col("n") > ARITY ** (l - 1)) & (F.col("n") <= ARITY**l)).select("grp", F.lit(0).cast("bigint").alias("run"), *carry, "path")
        paths = tops if paths is None else tops.unionByName(paths)
        nodes = _opened(tree.levels[l - 1], payload if l == 1 else [])
        paths = nodes.join(paths, ["grp", "run"]).withColumn("path", F.concat(F.array("step"), "path"))
        if l > 1:
            paths = table(paths.select("grp", F.col("idx").alias("run"), *carry, "path"), "manifest-paths")
    lone = leaves.filter("n = 1").select("grp", "h", *payload).join(above.filter("n = 1").select("grp", *carry, "path"), "grp")
    return lone if paths is None else paths.select(*lone.columns).unionByName(lone)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, replica_leaf: Column | None = None) -> DataFrame:
    """doc_id, leaf, replica (leaf of the row's replica), subroot, root and path of every row.

    replica_leaf is a digest over the columns of docs that stands for the same row elsewhere; without one the rows are their own replica.
    """
    own = leaf(**{c: F.col(f"`{c}`") for c in _COLUMNS})
    # "" comes before every key of a source that is there, so null stands first; after it UTF-8 bytes decide.
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = table(docs.select(grp.alias("grp"), F.col("doc_id"), own.alias("h"), (own if replica_leaf is None else replica_leaf).alias("replica")), "manifest-leaves")
    payload = ["doc_id", "replica"]
    leaves = numbered(rows, "grp", ["doc_id", "h"], "manifest-0")
    release(rows)
    tree = build(leaves, payload, "manifest-nodes")
    roots = numbered(tree.tops.select(F.lit(0).alias("all"), "grp", F.col("n").alias("size"), "h"), "all", ["grp"], "manifest-roots")
    roots = roots.select(F.col("all").alias("grp"), F.col("grp").alias("source_key"), "size", "idx", "n", "h")
    upper = build(roots, ["source_key", "size"], "manifest-upper")
    root = upper.tops.first()
    above = proofs(upper, upper.tops.select("grp", "n", F.array().cast(_STEPS).alias("path")), ["source_key", "size"], roots, [])
    above = table(above.select(F.col("source_key").alias("grp"), F.col("size").alias("n"), F.col("h").alias("subroot"), "path"), "manifest-above")
    out = proofs(tree, above, payload, leaves, ["subroot"])
    return out.select("doc_id", F.col("h").alias("leaf"), "replica", "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "path")


def op11(spark, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has an even CRC-32 lose the line ends of their text in the replica."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = {c: F.col(c) for c in _COLUMNS}
    hurt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    replica = leaf(**{**columns, "text": F.when(hurt, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    return audited(manifest(docs, replica))


def audited(rows: DataFrame) -> DataFrame:
    """A manifest's rows with proof_sha256 over the siblings, the root that the replica's leaf gives, and whether it is the manifest's."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("path"), F.col("replica")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
