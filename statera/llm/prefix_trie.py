"""Trie of conversations by their turns: every distinct beginning is a node.

Distributed most-significant-digit radix partitioning. A turn (role, text) is a digit, encoded by a dictionary of the distinct
turns. Equal conversations are one sequence with a weight. A round deals the sequences of every open bucket (a node and all
that goes through it) by their next digit, which makes the bucket's children. A child whose sequences have few turns left is
local: all local buckets are dealt out by (bucket, digit), and a multikey quicksort in the task that holds a bucket finishes it,
its recursion emitting the nodes. The others stay open for another round. Subtree sums go up level by level from the local
buckets through the rounds' children.

How much is local grows with the corpus only so far that at most MOST_OPEN buckets can be open at a time, which is the proven bound
of what is broadcast. A bucket of one sequence that is longer than that is a chain, and is emitted by prefix sums. A round is
needed for each level down to which more than a local bucket's turns have one beginning; a level deeper than that costs nothing.

No group is taken to be small: turns are placed by (conversation, step of turn numbers) and prefix sums over steps; the dictionary
is joined to frequent turns by broadcast (at most MOST_FREQUENT, by a threshold on the counts) and to others by shuffle;
conversations are joined to their rows by (conversation, cell of places); equal conversations are counted by partial aggregation
and their ids hashed from sorted pieces of at most 4,096 ids in one pass over each group, since SHA-256 is sequential.

Defined results: null role or text counts as empty; turns with equal numbers (or null ones) stand in order of their digest, which
is of role and text; rows without a conv_id belong to no conversation and give nothing; repeated rows are turns of their own; no
rows give no nodes, not even a root. Other columns are ignored. Equal conversations are told by 128 bits of hash and the length;
turns by SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import release, table

#: Turns of a local bucket at least; open buckets at most; turns that are joined by broadcast at most.
LOCAL, MOST_OPEN, MOST_FREQUENT = 20_000, 100_000, 10_000
#: Places of one cell, conv_ids of one hashed piece and turn numbers of one step, as a power of two.
CELL = 12
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def _before(size: str, by: str, at: str) -> Column:
    """Sum of size over earlier values of at in the group."""
    return F.sum(size).over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)


def _placed(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest and bytes of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.col("turn").cast("bigint")
    # The step of a null turn is null, too, and sorts first.
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), turn.alias("turn"), F.coalesce(F.shiftright(turn, CELL), F.lit(-(1 << 62))).alias("step"),
        digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    steps = rows.groupBy("conv", "step").agg(F.count(F.lit(1)).alias("c")).withColumn("first", _before("c", "conv", "step"))
    inside = F.row_number().over(Window.partitionBy("conv", "step").orderBy("turn", "digest"))
    rows = rows.withColumn("r", inside).join(steps, ["conv", "step"])
    return rows.select("conv", (F.col("first") + F.col("r") - 1).alias("pos"), "digest", "bytes")


def _encoded(placed: DataFrame) -> DataFrame:
    """conv, pos, tid and bytes: digests are replaced by their number in the dictionary."""
    counts = placed.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    words = table(counts.withColumn("tid", F.monotonically_increasing_id()), "trie-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    often = max(1000, total // MOST_FREQUENT)  # so that at most MOST_FREQUENT turns are above
    frequent = F.broadcast(words.filter(F.col("c") > often).select("digest", F.col("tid").alias("known")))
    rows = placed.join(frequent, "digest", "left")
    known = rows.filter("known IS NOT NULL").select("conv", "pos", F.col("known").alias("tid"), "bytes")
    rest = rows.filter("known IS NULL").join(words.filter(F.col("c") <= often), "digest").select("conv", "pos", "tid", "bytes")
    return known.unionByName(rest)


def _by_cell(rows: DataFrame, conversations: DataFrame, length: str) -> DataFrame:
    """rows joined to one row a conversation by conv and cell, so that a long conversation is no task of its own."""
    cells = conversations.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col(length), CELL))))
    return rows.withColumn("cell", F.shiftright("pos", CELL)).join(cells, ["conv", "cell"]).drop("cell")


def rebuilt(conversations: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations whose first head turns are those of conversation base; both are columns over conv.

    turns: conv, pos, tid, bytes; lengths: conv, len, also of conversations without a turn. head must have a small bound.
    """
    placed = table(_placed(conversations), "trie-placed")
    own = table(_encoded(placed), "trie-encoded")
    release(placed)
    n_own = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    plan = n_own.select("conv", "n", base.alias("base"), head.cast("bigint").alias("h"))
    plan = plan.join(n_own.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = plan.select("conv", "n", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    plan = table(plan.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-plan")
    most = plan.agg(F.max("taken")).first()[0] or 0
    heads = own.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    heads = heads.join(plan.filter("taken > 0").select("base", "conv", "taken"), "base").filter("pos < taken").select("conv", "pos", "tid", "bytes")
    tails = _by_cell(own, plan.filter("n > h").select("conv", "n", "h", "taken"), "n").filter("pos >= h")
    tails = tails.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "bytes")
    return table(heads.unionByName(tails), "trie-turns"), plan.select("conv", "len")


def _hashed_ends(batches):
    """Pieces of ids, sorted by group and place, to one row a group: smallest id, ids, digest."""
    group, sha, first, n = None, None, 0, 0
    for batch in batches:
        out = []
        for k1, k2, length, ids, c in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (k1, k2, length) != group:
                if group is not None:
                    out.append((first, group[2], n, sha.hexdigest()))
                group, sha, n, first = (k1, k2, length), hashlib.sha256(ids.encode()), 0, int(ids.split(",", 1)[0])
            else:
                sha.update(b"," + ids.encode())
            n += c
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv", "len", "weight", "ends"])
    if group is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, group[2], n, sha.hexdigest())], ["conv", "len", "weight", "ends"])


def sequences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns: conv (smallest with it), len, weight (conversations) and ends (digest of their ids)."""
    marks = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("pos", "tid")).alias("k1"), F.bit_xor(F.xxhash64("tid", F.lit("turn"), "pos")).alias("k2"))
    marks = lengths.join(marks, "conv", "left").fillna(0, ["k1", "k2"])
    ids = F.sort_array(F.collect_list("conv"))
    pieces = marks.groupBy("k1", "k2", "len", F.shiftright("conv", CELL).alias("cell")).agg(
        F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("c"))
    dealt = pieces.repartition("k1", "k2", "len").sortWithinPartitions("k1", "k2", "len", "cell").select("k1", "k2", "len", "ids", "c")
    return table(dealt.mapInArrow(_hashed_ends, "conv bigint, len bigint, weight bigint, ends string"), "trie-sequences")


def quicksorted(seqs: list[np.ndarray]) -> list[tuple[int, list[int]]]:
    """Multikey quicksort of sequences that begin alike in their first digit: (parent, members) of every node, parents first.

    A step parts the members of a node by their next digit, below, at and above a pivot; the middle part is a child, whose members go on
    with the digit after.
    """
    nodes, todo = [], [(-1, 0, list(range(len(seqs))), False)]
    while todo:
        parent, depth, members, parted = todo.pop()
        if not parted:
            nodes.append((parent, members))
            parent, depth = len(nodes) - 1, depth + 1
            members = [m for m in members if len(seqs[m]) > depth]
            if not members:
                continue
        pivot = seqs[members[len(members) // 2]][depth]
        low, mid, high = [], [], []
        for m in members:
            d = seqs[m][depth]
            (mid if d == pivot else low if d < pivot else high).append(m)
        if low:
            todo.append((parent, depth, low, True))
        if high:
            todo.append((parent, depth, high, True))
        todo.append((parent, depth, mid, False))
    return nodes


def _finish(parent: int, start: int, rows: dict[str, np.ndarray]) -> list[tuple]:
    """Nodes of one local bucket; rows are its turns by (conv, pos), those of a sequence in a row."""
    cuts = np.flatnonzero(np.diff(rows["conv"])) + 1
    first = np.concatenate(([0], cuts))
    tids, sizes = (np.split(rows[c], cuts) for c in ("tid", "bytes"))
    seqs = [t.tolist() for t in tids]
    conv, weight, ends = (rows[c][first].tolist() for c in ("conv", "weight", "ends"))
    found = quicksorted(seqs)
    n = len(found)
    depth, below, children, leaves, saved, out = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [None] * n
    for i, (up, members) in enumerate(found):
        if up >= 0:
            depth[i] = depth[up] + 1
            children[up] += 1
    for i in range(n - 1, -1, -1):
        up, members = found[i]
        convs = sum(weight[m] for m in members)
        leaves[i] += not children[i]
        saved[i] += (convs - 1) * int(sizes[members[0]][depth[i]])
        end = next((ends[m] for m in members if len(seqs[m]) == depth[i] + 1), _NONE)
        out[i] = (min(conv[m] for m in members), start + depth[i] + 1, parent, convs, children[i], leaves[i], saved[i], end)
        if up >= 0:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    return [row if up < 0 else (*row[:2], out[up][0], *row[3:]) for (up, _), row in zip(found, out)]


def _local(batches):
    """Turns sorted by (bucket, digit, conv, pos) to the nodes of each (bucket, digit). A bucket is held whole; it has a bounded number of turns."""
    names = ["bucket", "digit", "start", "conv", "tid", "bytes", "weight", "ends"]
    key, parts = None, []

    def nodes():
        whole = {c: np.concatenate([p[c] for p in parts]) for c in names}
        return _finish(key[0], key[2], whole)

    for batch in batches:
        now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        n, out = batch.num_rows, []
        cuts = np.flatnonzero(np.diff(now["bucket"]) | np.diff(now["digit"]) | np.diff(now["start"])) + 1
        bounds = [0, *cuts.tolist(), n] if n else []
        for a, b in zip(bounds, bounds[1:]):
            here = tuple(int(now[c][a]) for c in names[:3])
            if here != key and parts:
                out += nodes()
                parts = []
            key = here
            parts.append({c: v[a:b] for c, v in now.items()})
        if out:
            yield _batch(out)
    if parts:
        yield _batch(nodes())


def _batch(rows: list[tuple]):
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [f.split()[0] for f in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def _chains(turns: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes of buckets that are one long sequence: chains holds conv, len, weight, ends, bucket and start (depth of the bucket's parent)."""
    rows = _by_cell(turns, chains, "len").filter("pos >= start").withColumn("cell", -F.shiftright("pos", CELL)).withColumn("back", -F.col("pos"))
    cells = rows.groupBy("conv", "cell").agg(F.sum("bytes").alias("c")).withColumn("after", _before("c", "conv", "cell")).drop("c")
    rest = F.sum("bytes").over(Window.partitionBy("conv", "cell").orderBy("back").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("rest", rest).join(cells, ["conv", "cell"])
    last = F.col("pos") == F.col("len") - 1
    return rows.select(
        F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("start"), F.col("bucket")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("rest") + F.col("after"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"))


def trie(turns: DataFrame, seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row a node, as the query op12 returns them."""
    spark = turns.sparkSession
    total, least, convs = seqs.agg(F.sum("len"), F.min("conv"), F.sum("weight")).first()
    if least is None:
        return spark.createDataFrame([], _NODE)
    local = max(local, total // MOST_OPEN)  # every open bucket has more turns than that
    # Rows of sequences only: the other conversations are copies.
    turns = table(_by_cell(turns, seqs, "len").select("conv", "pos", "tid", "bytes", "len", "weight", "ends"), "trie-digits")
    there, depth, rounds, buckets, chains = seqs.filter("len > 0").select("conv", F.lit(least).alias("bucket")), 0, [], [], []
    while True:
        rows = turns.filter(F.col("pos") == depth).join(there, "conv")
        ended = F.col("len") == depth + 1
        kids = table(rows.groupBy("bucket", F.col("tid").alias("digit")).agg(
            F.min("conv").alias("kid"), F.sum("weight").alias("n_convs"), F.first("bytes").alias("bytes"), F.max(F.when(ended, F.col("ends"))).alias("ends"),
            F.sum(F.col("len") - depth).alias("left"), F.count(F.lit(1)).alias("n")), "trie-kids")
        large = kids.filter(F.col("left") > local)
        n_open = large.agg(F.count(F.when(F.col("n") > 1, 1)), F.count(F.lit(1))).first()
        dealt = rows.select("conv", "bucket", F.col("tid").alias("digit"), "len", "weight", "ends")
        dealt = dealt.join(F.broadcast(large.select("bucket", "digit", "kid", "n")), ["bucket", "digit"], "left")
        dealt = table(dealt.withColumn("start", F.lit(depth).cast("bigint")), "trie-dealt")
        buckets.append(dealt.filter("kid IS NULL").select("conv", "len", "bucket", "digit", "start"))
        if n_open[1] > n_open[0]:
            chains.append(dealt.filter("n = 1").select("conv", "len", "weight", "ends", "bucket", "start"))
        rounds.append(large.filter("n > 1"))
        if not n_open[0]:
            break
        there, depth = dealt.filter("n > 1").select("conv", F.col("kid").alias("bucket")), depth + 1
    places = buckets[0]
    for more in buckets[1:]:
        places = places.unionByName(more)
    digits = _by_cell(turns.drop("len"), places, "len").filter("pos >= start").select(
        "bucket", "digit", "start", "conv", "tid", "bytes", "weight", F.when(F.col("pos") == F.col("start"), F.col("ends")).alias("ends"), "pos")
    digits = digits.repartition("bucket", "digit").sortWithinPartitions("bucket", "start", "digit", "conv", "pos").drop("pos")
    nodes = table(digits.mapInArrow(_local, _NODE), "trie-local")
    for chain in chains:
        nodes = nodes.unionByName(_chains(turns.drop("len", "weight", "ends"), chain))
    top, below = [], None
    for level in range(len(rounds) - 1, -1, -1):  # upwards: children of an open bucket are local nodes, chains and open buckets of the next round
        kids = nodes.filter(F.col("depth") == level + 2).select("parent_conv_id", "n_leaves", "saved_tokens")
        kids = kids if below is None else kids.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent_conv_id").alias("kid")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        if level == len(rounds) - 1:
            continue  # the last round left nothing open
        below = table(rounds[level].join(sums, "kid").select(
            F.col("kid").alias("conv_id"), F.lit(level + 1).cast("bigint").alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            ((F.col("n_convs") - 1) * F.col("bytes") + F.col("below")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256")), "trie-open")
        top.append(below)
    kids = nodes.filter("depth = 1") if below is None else nodes.filter("depth = 1").unionByName(below)
    n_children, n_leaves, saved = kids.agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    silent = seqs.filter("len = 0").select("ends").first()
    root = (least, 0, None, convs, n_children, n_leaves or 1, saved or 0, silent[0] if silent else _NONE)
    for more in [*top, spark.createDataFrame([root], _NODE)]:
        nodes = nodes.unionByName(more)
    return nodes


def op12(spark, sf_dir: str) -> DataFrame:
    """Conversation c begins with up to crc32(c) % 9 turns of conversation c - c % 5."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    turns, lengths = rebuilt(rows, F.col("conv") - F.col("conv") % 5, head)
    return trie(turns, sequences(turns, lengths))
