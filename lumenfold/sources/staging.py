"""Tables written to the folder that all executors share, so that long plans are cut and nothing is computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own if all tasks run on this machine."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def remove_staged(spark: SparkSession) -> None:
    """Delete all that was staged under the shared folder; for jobs whose results are written elsewhere."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/lumenfold")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to shared storage and read back: computed once, lineage cut, safe from lost executors."""
    path = f"{shared_root(df.sparkSession)}/lumenfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
