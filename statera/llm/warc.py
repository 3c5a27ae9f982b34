"""WARC volumes and a Merkle fixity audit of their replicas.

Records are put into volumes by a digest of their key, so volumes are alike in size whatever the hosts, and in digest order
inside a volume. A leaf of the tree is an equal range of that digest, so it is a stretch of the volume, but which records are
in it depends on their keys alone: a record that is lost, added, cut or lengthened changes its own leaf and no other. A leaf's
digest is the number of its records and the sums of eight words of each record's hash (against rot, not against somebody who
forges sums), so that a key repeated any number of times is added up in parts; a node is the hash of its fanout children in
order. Replicas are compared root by root, and only below a node that differs are its children looked at: a sound volume
costs one comparison, a damaged record one path. In leaves that differ records are compared by key and hash; byte ranges are
reported, not compared. Record bytes are hashed where they are read; only digests and lengths move.

Defined results: a null url or html counts as empty; null ids and repeated rows are records of their own (ties fall to the
record's hash, and rows equal in all are interchangeable; of several records of one key those left over are paired in order); a
record whose id or url changed is missing under its old key and extra under its new one; no rows give no volumes and no
findings; other columns are ignored. A volume that is read may be cut, badly headed, undecodable or gzipped: see records.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statera.llm.common import table

FANOUT, VOLUME_BYTES, MOST_INFLATED = 16, 64 << 20, 1 << 30


def record(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC response record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def hashed(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """page_id, url, key, size, sha of every record; the payload is html, or the column html of pages."""
    rec = record(F.col("url"), F.col("page_id"), F.col("html") if html is None else html)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))).cast("binary"))
    return pages.select("page_id", "url", key.alias("key"), rec.alias("rec")).select("page_id", "url", "key", F.octet_length("rec").cast("long").alias("size"), F.sha2("rec", 256).alias("sha"))


def volumes_for(rows: DataFrame, volume_bytes: int = VOLUME_BYTES) -> int:
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // volume_bytes))


def leaves(rows: DataFrame, volumes: int) -> DataFrame:
    """volume, node, page_id, start, end, digest, key, sha: the records in order, with their place and byte range in the volume.

    digest is the hash of the record's hash and its byte range; it names the record in this replica and isn't compared.
    """
    volume = (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % volumes).cast("int")
    w = Window.partitionBy("volume").orderBy("key", "size", "sha")
    out = rows.withColumn("volume", volume).withColumn("node", F.row_number().over(w).cast("long") - 1)
    out = out.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    digest = F.sha2(F.concat_ws("|", "sha", F.col("start").cast("string"), F.col("end").cast("string")), 256)
    return out.select("volume", "node", "page_id", "start", "end", digest.alias("digest"), "key", "sha")


def height(records: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves, for about fanout records a leaf."""
    h = 0
    while fanout ** (h + 1) < records and fanout ** (h + 1) <= 1 << 40:
        h += 1
    return h


def leaf_of(levels: int, fanout: int = FANOUT) -> Column:
    """The leaf of a key among fanout ** levels equal ranges of its first 52 bits."""
    width = -(-(1 << 52) // fanout**levels)
    return F.expr(f"CAST(conv(substring(key, 1, 13), 16, 10) AS BIGINT) DIV {width}")


def tree(leaf_rows: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves (0) to the roots: volume, node, digest. A node has at most fanout children."""
    h = F.sha2(F.concat_ws("|", "key", "sha"), 256)
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string").alias(f"w{i}") for i in range(8)]
    sums = leaf_rows.select("volume", leaf_of(levels, fanout).alias("node"), h.alias("h")).groupBy("volume", "node").agg(F.count(F.lit(1)).cast("string").alias("n"), *words)
    out = [table(sums.select("volume", "node", F.sha2(F.concat_ws("|", "n", *(f"w{i}" for i in range(8))), 256).alias("digest")), "merkle-leaves")]
    for k in range(levels):
        kids = F.sort_array(F.collect_list(F.struct("node", "digest")))
        up = out[-1].groupBy("volume", F.expr(f"node DIV {fanout}").alias("up")).agg(kids.alias("kids"))
        named = F.transform("kids", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"]))
        out.append(table(up.select("volume", F.col("up").alias("node"), F.sha2(F.array_join(named, "|"), 256).alias("digest")), f"merkle-{k + 1}"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """volume, node of the leaves that differ or that one replica lacks; both trees have the same height."""
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if bad is not None:
            under = bad.select("volume", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.expr(f"node DIV {fanout}")).join(under, ["volume", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y.withColumnRenamed("digest", "other"), ["volume", "node"], "full")
        bad = table(both.filter(~F.col("digest").eqNullSafe(F.col("other"))).select("volume", "node"), "merkle-bad")
    return bad


def audit(rows_a: DataFrame, rows_b: DataFrame, volumes: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """volume, node, page_id, start, end, digest_a, digest_b, state of each record that differs between the replicas.

    state is damaged, missing (in b) or extra (in b); node, start and end are the place in a, or in b for an extra record.
    """
    n = volumes or volumes_for(rows_a)
    a, b = (table(leaves(r, n), "merkle-0") for r in (rows_a, rows_b))
    levels = height(1 + max(t.agg(F.max("node")).first()[0] or 0 for t in (a, b)), fanout)
    bad = differing(tree(a, levels, fanout), tree(b, levels, fanout), fanout).withColumnRenamed("node", "leaf")
    a, b = (table(t.withColumn("leaf", leaf_of(levels, fanout)).join(bad, ["volume", "leaf"], "left_semi").drop("leaf"), "merkle-suspects") for t in (a, b))
    # Records of one key and hash stand side by side in a volume, so node - first is their rank; as many as the other side has are sound.
    same = ["volume", "key", "sha"]
    na, nb = (t.groupBy(*same).agg(F.min("node").alias(f"first_{x}"), F.count(F.lit(1)).alias(f"n_{x}")) for t, x in ((a, "a"), (b, "b")))
    uneven = table(na.join(nb, same, "full").filter(~F.col("n_a").eqNullSafe(F.col("n_b"))), "merkle-uneven")
    by_key = Window.partitionBy("volume", "key").orderBy("node")
    left = []
    for t, x, y in ((a, "a", "b"), (b, "b", "a")):
        t = t.join(uneven, same).filter(F.col("node") - F.col(f"first_{x}") >= F.coalesce(f"n_{y}", F.lit(0)))
        place = [F.col(c).alias(f"{c}_{x}") for c in ("node", "page_id", "start", "end", "digest")]
        left.append(t.select("volume", "key", F.row_number().over(by_key).alias("nth"), *place))
    found = left[0].join(left[1], ["volume", "key", "nth"], "full")
    state = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("damaged")
    pick = [F.when(F.col("digest_a").isNull(), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c) for c in ("node", "page_id", "start", "end")]
    return found.select("volume", *pick, "digest_a", "digest_b", state.alias("state"))


def write_warc(pages: DataFrame, path: str, volumes: int) -> None:
    """One folder of uncompressed WARC text per volume, records in key order."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))).cast("binary"))
    rec = record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select(key.alias("key"), "page_id", F.substring(rec, F.lit(1), F.length(rec) - 2).alias("value"))
    rows = rows.withColumn("volume", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % volumes).cast("int"))
    rows.repartition(volumes, "volume").sortWithinPartitions("volume", "key", "page_id").select("volume", "value").write.partitionBy("volume").option("lineSep", "\r\n").text(path)


def inflated(data: bytes, most: int = MOST_INFLATED) -> tuple[bytes, bool]:
    """A volume's bytes, gzip member by member, and whether anything of it is cut, damaged or over the bound; what came out before is kept."""
    out, size = [], 0
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data, most - size + 1))
            size += len(out[-1])
        except zlib.error:
            # The member's own bytes are lost from the fault on; the next one may be sound.
            at = data.find(b"\x1f\x8b\x08", 2)
            more, _ = inflated(data[at:], most - size) if at > 0 else (b"", True)
            return b"".join([*out, more]), True
        if size > most:
            return b"".join(out)[:most], True
        if not member.eof:
            return b"".join(out), True
        data = member.unused_data
    return (b"".join(out), bool(data.strip(b"\r\n\0"))) if out else (data, False)


def records(data: bytes):
    """(page_id, url, html, error) of the response records of a volume, which may be gzipped; other kinds of records are passed over.

    A record that can't be read is a row with an error, which keeps what can be shown: header (no length, or one of over 18 digits),
    damaged (its length is wrong: behind it no record starts and the volume doesn't end), truncated (the volume ends inside it, or
    its gzip member does) or undecodable. Reading goes on at the first record that starts behind the bad one's own header, so a wrong length
    hides no other record. An id that isn't a page's number is NULL.
    """
    cut = False
    if data.startswith(b"\x1f\x8b"):
        data, cut = inflated(data)
        if cut and not data:
            yield None, None, None, "truncated"
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines) if sep}
        size = head.get("content-length", "")
        after = data.find(b"\r\n\r\nWARC/", at)
        after = after + 4 if after >= 0 else -1
        if stop < 0 or not re.fullmatch("[0-9]{1,18}", size):
            yield None, head.get("warc-target-uri"), None, "header" if stop >= 0 else "truncated"
            at = after
            continue
        start, end = stop + 4, stop + 4 + int(size)
        rest, error = data[end : end + 9], None
        if end > len(data):
            end, error = (after - 4, "damaged") if after > 0 else (len(data), "truncated")
        elif rest == b"\r\n\r\nWARC/":
            after = end + 4
        elif data[end:].strip(b"\r\n"):
            end, error = (after - 4 if after > 0 else len(data)), "damaged"
        else:
            after, error = -1, "truncated" if cut and not rest else None
        body = data[start : max(start, end)]
        if head.get("warc-type") == "response":
            page = re.fullmatch(r"<urn:page:(\d{1,18})>", head.get("warc-record-id", ""))
            try:
                text = body.decode()
            except UnicodeDecodeError:
                text, error = body.decode("utf-8", "replace"), error or "undecodable"
            yield int(page[1]) if page else None, head.get("warc-target-uri"), text, error
        at = after


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, error of every response record; a volume is read whole by one task, so keep volumes near VOLUME_BYTES."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                cols = list(zip(*records(content.as_py()), strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "url", "html", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "page_id long, url string, html string, error string")


def rotted(html: Column, page_id: Column) -> Column:
    """A replica's payload with bit rot: of four pages in 256, by digest of the id, one character is replaced by as many bytes."""
    d = F.md5(F.concat(F.lit("rot:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    body = F.coalesce(html, F.lit(""))
    at = (F.conv(F.substring(d, 3, 6), 16, 10).cast("long") % F.greatest(F.length(body), F.lit(1))).cast("int")
    tilde = F.repeat(F.lit("~"), F.octet_length(F.substring(body, at + 1, F.lit(1))))
    hit = (F.substring(d, 1, 2) < "04") & (F.length(body) > 0)
    return F.when(hit, F.concat(F.substring(body, F.lit(1), at), tilde, F.substring(body, at + 2, F.length(body)))).otherwise(body)


def op9(spark, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages that has bit rot in it (rotted) against the pages themselves."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(hashed(pages), hashed(pages, rotted(F.col("html"), F.col("page_id"))))


def hurt(pages: DataFrame) -> DataFrame:
    """A replica with every kind of damage, anywhere in a volume: bit rot (rotted), and by another digest of the id, of 256 pages two
    cut to two thirds, two lengthened, two lost and two with an extra record under a url of its own."""
    h = F.substring(F.md5(F.concat(F.lit("hurt:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary")), 1, 2)
    body = rotted(F.col("html"), F.col("page_id"))
    cut = F.substring(body, F.lit(1), (F.length(body) * 2 / 3).cast("int"))
    rows = pages.select("page_id", "url", h.alias("h"), F.when(h < "02", cut).when(h < "04", F.concat(body, F.lit("~"))).otherwise(body).alias("html"))
    url = F.explode(F.when(F.col("h").between("06", "07"), F.array(F.col("url"), F.concat(F.coalesce("url", F.lit("")), F.lit("#extra")))).otherwise(F.array("url")))
    return rows.filter(~F.col("h").between("04", "05")).select("page_id", url.alias("url"), "html")


def op9_hurt(spark, sf_dir: str) -> DataFrame:
    """Audits a replica with rotted, cut, lengthened, lost and extra records (hurt) against the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(hashed(pages), hashed(hurt(pages)))
