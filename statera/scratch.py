"""Tables in the folder that driver and executors share, to end a lineage that would be recomputed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}
_NAMES: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A temporary folder stands in only where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or tempfile.mkdtemp(prefix="statera-")
        _OWN[app] = found
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which release_all deletes with all it holds."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no earlier stage.

    With path it is written there, inside a folder that folder() has made; with codec compressed by it.
    """
    spark = df.sparkSession
    path = path or folder(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._statera_path = path
    return out


def dealt_table(df: DataFrame, name: str, by: str, parts: int) -> DataFrame:
    """As table(), of rows that repartition(parts, by) has dealt: a bucketed table, so that what is read back is still dealt by `by`, and groups
    and joins by it move nothing. A task holds one part and writes one file."""
    spark = df.sparkSession
    path = folder(spark, name)
    _NAMES[path] = f"spark_catalog.default.statera_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, by).saveAsTable(_NAMES[path])
    out = spark.table(_NAMES[path])
    out._statera_path = path
    return out


def exists(t: DataFrame) -> bool:
    """Whether a table that table() wrote is still there."""
    return finished(t.sparkSession, t._statera_path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to path was committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stamp(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, modification time) of every file at path, on any store that Spark reads: it changes when a table is rewritten."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ()
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing lazy reads any more."""
    for t in tables:
        path = getattr(t, "_statera_path", None)
        if path:
            _delete(t.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Call when all results have been written."""
    for path in list(_TABLES.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)
