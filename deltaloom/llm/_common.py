"""What the operators share: exact column choice, Arrow batch sizes, shared scratch tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, written
from ..sources.spread import spread

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of an Arrow batch, in rows and bytes; a text above the latter is a batch of its own.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches for long texts, by session settings where the user has set none.

    They must hold until the lazy query has run, so they stay.
    """
    for name, value in ARROW.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select ``names`` (output name = column name); of clashing spellings the exact one wins."""
    columns, found = df.columns, {}
    for out, name in names.items():
        same = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name} in {columns}")
        found[out] = same[0]
    raw = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return raw.select(*[F.col(f"_c{i}").alias(out) for out, i in found.items()])


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def workers_threads() -> None:
    """A Python worker uses the core of its task only."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
