"""Tables in the folder that the driver and all executors share: what an iterative job cuts its lineage with."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A subfolder, for this application, of the one named in spark.checkpoint.dir; where none is named and all runs in one process, of one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that kept() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
