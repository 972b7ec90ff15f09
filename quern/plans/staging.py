"""Stage tables: results written once to the shared folder and read again.

A stage table cuts lineage in a way that outlives executors, keeps Parquet's
column pruning, and tells the planner a true size, by which Spark decides
on its own whether a join side may be broadcast.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's own; in local mode, as in tests, else a new temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def _run_root(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/quern/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession) -> str:
    return f"{_run_root(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a stage table and read it back. Column names must be distinct."""
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all stage tables of this application, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
