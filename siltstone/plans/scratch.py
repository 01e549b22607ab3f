"""A folder that all executors see, for what queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.errors import StorageError


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; that is set to a temporary one only where it is unset and all tasks run here."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir has to name a folder that all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    path = f"{known.rstrip('/')}/collections-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new folder, which goes when the session ends: lineage ends there, and it is computed once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
