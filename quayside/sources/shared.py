"""Tables between the stages of a job, in the shared folder of the cluster.

A stage's result is written once, dealt into buckets by its key, and read from there by all that follows: what is grouped or joined by
the same key afterwards needs no exchange, and a lost executor costs a retry from stored files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a local session may do without: it has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def parts_of(spark: SparkSession) -> int:
    """Into how many parts a stage deals its rows: the session's shuffle partitions, but four for each core at most where they are left at Spark's default."""
    told = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return told if told != 200 else min(told, 4 * spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, key: str = "shipment_id", dealt: bool = False) -> DataFrame:
    """``df`` as a table in buckets by ``key``; it goes with the session.

    ``dealt``: the rows stand by ``key`` in as many partitions as there are buckets already.
    """
    spark = df.sparkSession
    parts = parts_of(spark)
    name = f"quayside_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = df if dealt else df.repartition(parts, key)
    rows.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for files that aren't tables; it goes with the session."""
    path = f"{shared_dir(spark)}/quayside_{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        jvm, found = df.sparkSession._jvm, df.inputFiles()
        if found:
            at = jvm.org.apache.hadoop.fs.Path(found[0]).getParent()
            if at.getName().startswith("quayside_"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {at.getName()}")
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
