"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name within spark.checkpoint.dir; removed when Python exits.

    Where that is unset, a local session gets a temporary folder; a cluster's is refused, as its
    machines wouldn't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/deltaloom/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{what}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def purge() -> None:
    """Remove every scratch folder of this process; tables that still read them end."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)


atexit.register(purge)
