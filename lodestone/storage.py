"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``; where that is unset and all runs on this machine, one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and Catalyst knows its size. ``options`` are the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that is dealt to all cores where it is read.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, as a file of one row group is a single task; larger ones stay as they are read."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


#: Bytes of a stored table that a task takes where each row costs much more than its reading.
EACH = 512 << 10


def dealt(df: DataFrame, each: int = EACH) -> DataFrame:
    """A table of any size dealt evenly to as many tasks as its bytes ask for, and all cores at least: for rows that cost much more than a shuffle of them, as a file of any size may be one row group and so one task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)))


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; results that still have to read it are lost."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
