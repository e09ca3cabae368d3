"""Tables and folders in the storage that driver and executors share.

The folder is the one that ``spark.checkpoint.dir`` names. What is written here
goes when the driver ends, or with ``drop`` as soon as nothing reads it any more.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and all runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{root(spark)}/weft-{label}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        return


def write(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written and read again: its plan ends here, and a lost executor loses nothing."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``write`` made."""
    for t in tables:
        drop(t.sparkSession, t.weft_path)
