"""Tables in the folder that all executors share: written once, read again, lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fleetmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)  # the table is there as long as the driver
    return df.sparkSession.read.schema(df.schema).parquet(path)
