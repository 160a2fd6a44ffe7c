"""Written tables in the shared folder, where a plan is cut so that readers share its result.

A table lives as long as a DataFrame that reads it: every write first deletes the tables whose
file index the JVM has collected, and the rest goes when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Path of each written table, with a weak reference of the JVM to the file index that reads it.
_alive: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; where none is set, a temporary folder of a local session. A cluster without one is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="pagequarry-"))
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _watch(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    if not _alive:
        atexit.register(_delete_all, spark)
    for old in [p for p, index in _alive.items() if index.get() is None]:
        del _alive[old]
        delete(spark, old)
    leaf = df._jdf.queryExecution().analyzed().collectLeaves().head()
    _alive[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(leaf.relation().location())
    return df


def _delete_all(spark: SparkSession) -> None:
    while _alive:
        path, _ = _alive.popitem()
        try:
            delete(spark, path)
        except (Py4JError, AttributeError, OSError):  # the session or its JVM has ended before
            return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return _watch(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, name: str, keys: list[str], files: int, shuffle: bool = True) -> DataFrame:
    """As stored, in buckets by the keys, so that grouping and joining by them needs no shuffle.

    The catalog knows the table only while it is written: files at a path of their own outlive the entry.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"pq_{uuid.uuid4().hex}"
    rows = df.repartition(files, *keys) if shuffle else df
    rows.write.bucketBy(files, *keys).sortBy(*keys).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    out = _watch(spark.table(table), path)
    spark.sql(f"DROP TABLE {table}")
    return out


def stamp(spark: SparkSession, path: str) -> tuple:
    """Size, number and latest change of the files at a path: what tells whether a table is still the same."""
    files, at = _files(spark, path)
    total = files.getContentSummary(at)
    return total.getLength(), total.getFileCount(), max((int(s.getModificationTime()) for s in files.listStatus(at)), default=0)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return bool(files.exists(at))
