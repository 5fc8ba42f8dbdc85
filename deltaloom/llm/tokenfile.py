"""Token ids in ORC files.

Documents are dealt into ranges of doc_id, sorted, encoded and written, one file for each
range, in ascending doc_id order: integers are run-length encoded, each stripe has row
indexes, and doc_id has a Bloom filter, so a lookup of documents skips files, stripes and
row groups by their metadata and a full scan reads stripes in parallel. A row has its
file's number and its place there; positions in the whole token stream follow from
the counts of the files before.

Results for edge cases: a null or empty text is the end id alone, a text may be of any length; equal doc_ids are
ordered by their text and a null doc_id comes first; repeated rows are written each time; no documents make
a file without rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pick, scratch_dir, table, tune, written
from .tokens import crc32, encoder, id_buffers, ids_column, texts, vocabulary

END_ID = 2
SCHEMA = "doc_id long, part int, place int, ids array<int>"
#: Rows of an index entry: a document has about a thousand ids.
INDEX_ROWS = 1000
STRIPE_BYTES = 16 << 20
#: Compressed input bytes for a file.
FILE_BYTES = 32 << 20


def file_count(docs: DataFrame) -> int:
    """Files by the bytes of the input, one for each core at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def write_token_files(docs: DataFrame, to: str, path: str, end_id: int = END_ID, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write them to the folder ``to``; one shuffle, of the texts."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tune(spark)
    spark.conf.set("spark.sql.orc.columnarWriterBatchSize", "256")
    files = files or file_count(docs)
    end = np.asarray([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, place = encoder(path).encode, TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            ids = ids_column([encode(t) + end for t in texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, "i4")), pa.array(np.arange(place, place + n, dtype="i4")), ids], ["doc_id", "part", "place", "ids"])
            place += n

    encoded = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
    (
        encoded.write.option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(to)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, part, place, ids); ``doc_ids`` is pushed down to the files' metadata."""
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", "256")
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token rows: places in the stream and checksums.

    Collected is one count for each file.
    """
    spark = rows.sparkSession
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(id_buffers(b.column(3)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([len(x) // 4 for x in own], pa.int64()), pa.array([crc32(x) for x in own], pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"]
            )

    sums = written(rows.select("doc_id", "part", "place", "ids").mapInArrow(run, "doc_id long, part int, place int, n_tokens long, ids_crc32 long"), "sums")
    bases, base = [], 0
    for r in sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases.append((r["part"], base))
        base += r["n"]
    bases_df = spark.createDataFrame(bases, "b_part int, b_start long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("own_start", F.coalesce(before, F.lit(0)))
    return placed.join(F.broadcast(bases_df), F.col("part") == F.col("b_part")).select("doc_id", (F.col("b_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    to = f"{scratch_dir(spark)}/tokens.orc"
    write_token_files(table(spark, sf_dir, "documents"), to, vocabulary())
    return token_index(read_token_files(spark, to))
