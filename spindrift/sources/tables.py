"""Tables that are written: once for several readers, as versions with keyed upserts, as reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import BUCKET_ROWS, Versions


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, for a local master only, a new one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables that written() has made in this process and that are still there.
_paths: list[str] = []


def count_written() -> int:
    return len(_paths)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that written() has made after the first ``since``, but for the last ``keep``, once no result
    reads them any more."""
    gone = _paths[since : len(_paths) - keep]
    del _paths[since : len(_paths) - keep]
    _delete(spark, gone)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder, for a result that is read more than once."""
    path = f"{shared_folder(df.sparkSession)}/spindrift-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt over all cores if they come in fewer partitions than there are cores, as those of a small
    file do; for work on each row that outweighs moving it. Large tables have more partitions and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The same rows in as many partitions as shuffles have, and as there are cores at least, by these columns: for rows
    whose work outweighs their size, which adaptive execution would put together."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def current(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    """Rows of a table as upsert leaves it, in its newest version, or the newest before a number."""
    return Versions(spark, folder).read("rows", schema, before)


def upsert(incoming: DataFrame, folder: str, keys: list[str], order: str, number: int, bucket_rows: int = BUCKET_ROWS, keep: int = 2) -> None:
    """Keeps one row per key, the latest by ``order``, in a table in ``folder``, as its version ``number``; see Versions."""
    Versions(incoming.sparkSession, folder, bucket_rows).commit(number, {"rows": (incoming, keys, order)}, keep)


def report(metrics: DataFrame, folder: str) -> None:
    """Writes metrics as one JSON object a line."""
    metrics.write.mode("overwrite").json(folder)


def long_form(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value as text) of a table of metrics, so that reports of several kinds go into one table."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, *(F.col(c).cast("string").alias(c) for c in names)).unpivot(keys, names, "metric", "value")
