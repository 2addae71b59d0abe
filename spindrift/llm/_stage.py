"""Tables written in the folder that all machines of a cluster share, to cut lineage or to be read twice."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, for a local master only, a new one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch for whole texts; Spark's default of 10,000 is meant for short rows, and several
#: copies of a batch are held at once, inside and outside the heap.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Smaller Arrow batches for this session, unless their size was set on purpose."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


#: Tables written by this process.
_paths: list[str] = []


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that written() has made in this process, or those after the first ``since`` of them, once
    no result that reads them is needed any more; returns how many."""
    paths = _paths[since:]
    del _paths[since:]
    drop(spark, paths)
    return len(paths)


def count_written() -> int:
    return len(_paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def plain(docs: DataFrame, known: list[str]) -> DataFrame:
    """docs with the columns not in ``known`` under new names by place, so that none can clash with a name that
    an operator uses, in whatever case."""
    return docs.toDF(*[c if c in known else f"_{k}_" for k, c in enumerate(docs.columns)])


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder; a lost executor then costs no recomputing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spindrift-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
