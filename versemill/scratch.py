"""Tables written on the way to a result, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local master may leave it unset and gets one of its own; executors of
    a cluster share no temporary folder, so there it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="versemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/versemill"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: this cuts the lineage and fixes the rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the written tables, on whatever file system they are. Results that were not written yet read them, so this is
    for the end of a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
