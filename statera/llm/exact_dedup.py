"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into blocks of fixed size. The distinct blocks are sorted and numbered, so equal blocks share
one integer name. Then adjacent names are paired, the distinct pairs sorted and numbered, and so on until each text has
one name. A name is an integer of its run: which one depends on how the sorted keys are dealt, while identities (which texts share
a name) don't. Texts of equal length take equally many rounds, and every numbering is one to one, so (length, name) is equal
exactly for equal texts, whatever any digest does.

Texts are shuffled once, to be sorted. The rows find their block's name by a 64-bit key of the block; the sorted blocks show
whether that key is one to one on this corpus. If not, the names are joined by the blocks themselves.

Defined results: null text counts as empty; null ids lose to any id, and repeated rows are separate rows of which one stays;
no rows give no rows; other columns are ignored (or kept, in drop_duplicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import packed, release, row_hash, table, unpacked

BLOCK = 4096


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of keys, sorted in each part, with an integer that no other row has."""
    return keys.distinct().sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _blocks(body: Column, size: int) -> Column:
    last = F.greatest(F.octet_length(body) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), (last / size).cast("int")), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def identities(docs: DataFrame, normal: Column | None = None, block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """rid, doc_id, n_bytes, text_sha256, name of every row: (n_bytes, name) is equal exactly for equal (normalised) texts."""
    text = F.coalesce(F.col("text") if normal is None else normal, F.lit(""))
    body = text.cast("binary")
    key = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - key_bits)
    cut = docs.select("doc_id", body.alias("body"))

    apart = cut.select(F.explode(_blocks(F.col("body"), block)).alias("block")).select(key(F.col("block")).alias("h"), "block")
    names = table(_numbered(apart, ["block", "h"]).select("h", "name"), "block-names")
    by = ["h"]
    if names.groupBy("h").count().filter("count > 1").limit(1).count():
        release(names)
        names, by = table(_numbered(apart, ["block", "h"]), "block-names"), ["h", "block"]

    held = lambda b: F.struct(key(b).alias("h"), *([b.alias("block")] if "block" in by else []))
    rows = cut.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.octet_length("body").cast("long").alias("n_bytes"),
        F.sha2("body", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("body"), block), held).alias("blocks"),
    )
    rows = table(rows, "block-rows")

    cells = rows.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "b")).select("rid", "n", "at", "b.*")
    cells = cells.join(names, by).select("rid", "n", "at", "name")
    done, used = [], []
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 1
    level = 0
    while True:
        cells = table(cells, f"names-{level}")
        used.append(cells)
        done.append(cells.filter("n = 1").select("rid", "name"))
        if most <= 1:
            break
        two = F.expr("at % 2")
        pairs = cells.filter("n > 1").groupBy("rid", "n", F.expr("at DIV 2").alias("p"))
        pairs = pairs.agg(F.max(F.when(two == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(two == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = table(pairs, f"pairs-{level}")
        pair_names = table(_numbered(pairs.select("a", "b"), ["a", "b"]), f"pair-names-{level}")
        used += [pairs, pair_names]
        cells = pairs.join(pair_names, ["a", "b"]).select("rid", F.expr("CAST((n + 1) DIV 2 AS INT)").alias("n"), F.col("p").alias("at"), "name")
        most, level = (most + 1) // 2, level + 1
    one = done[0]
    for more in done[1:]:
        one = one.unionByName(more)
    out = table(rows.drop("blocks").join(one, "rid"), "identities")
    release(names, rows, *used)
    return out


def classes(docs: DataFrame, normal: Column | None = None, block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest doc_id stays."""
    ids = identities(docs, normal, block, key_bits)
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"), (-F.col("rid")).alias("first"))).alias("best")
    groups = table(ids.groupBy("n_bytes", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    groups = groups.select("n_bytes", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.first")).alias("keep_rid"))
    out = ids.join(groups, ["n_bytes", "name"])
    return out.select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows alike in id and text the one with the smallest row_hash."""
    found = table(classes(docs).select("doc_id", "text_sha256", "kept"), "classes")
    kept = table(found.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")), "kept")
    rows = packed(docs, id=F.col("doc_id"), sha=F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), h=row_hash(docs))
    out = rows.alias("r").join(kept.alias("k"), F.expr("r.id <=> k.id AND r.sha = k.sha"), "left_semi")
    if found.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count():
        out = out.groupBy("id", "sha").agg(F.min_by("doc", "h").alias("doc"))
    return unpacked(out, docs)


def op3(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
