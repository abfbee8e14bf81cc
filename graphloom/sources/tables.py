"""Shared-folder tables: how jobs cut lineage without depending on one executor's disk."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
PART_BYTES = 4 << 20  # of input files for each partition that a shuffle begins with


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one if the master is local (tests), else an error:
    executors of a cluster would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def sized(spark: SparkSession, *paths: str) -> None:
    """Let shuffles over these inputs begin with a partition for each ``PART_BYTES`` of them, where that is more than the session's number: adaptive
    execution joins small ones, but never splits those of an aggregate, so with a fixed number the memory of a task would grow with the input."""
    conf, sc = spark.conf, spark.sparkContext
    found = 0
    for path in paths:
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        found += hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    wanted = max(int(conf.get("spark.sql.shuffle.partitions")), -(-found // PART_BYTES))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def at_least(spark: SparkSession, partitions: int) -> None:
    """Let shuffles begin with so many partitions, where that is more than the session has: see :func:`sized`, for rows that weigh more later on than
    in their files."""
    conf, name = spark.conf, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf.set(name, str(max(int(conf.get(name, None) or 0), int(conf.get("spark.sql.shuffle.partitions")), partitions)))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written with :func:`written`, through Hadoop's file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back; returns the table and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its lineage cut by a written table, so that a lost executor costs a read and not a recomputation."""
    return written(df, name)[0]


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written once in the shared folder, bucketed by a column, so that later groups and joins on it move none of its rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    df.repartition(n, column).write.format("parquet").option("path", shared_path(spark, name)).bucketBy(n, column).saveAsTable(table)
    return spark.table(table)
