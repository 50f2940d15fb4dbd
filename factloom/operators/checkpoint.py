"""Cut points of iterative operators: in the folder all executors share, never on one executor's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: that of spark.checkpoint.dir. Where it is unset, a local one, but only for a local master: on a
    cluster no executor could read what another wrote there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, as Parquet in the shared folder, and reads it again: the lineage is cut, lost executors cost nothing that is
    written, and Catalyst sees the real size. What is written stays until the folder of the application is removed."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, most: int = 125_000) -> int:
    """In how many parts rows are dealt so that a task's memory does not grow with the table: about `most` rows each."""
    return max(1, -(-rows // most))


def clean(spark: SparkSession) -> None:
    """Removes what this application has written with `cut`; tables that still read from it fail afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(path)
