"""Sequence packing by shortest-pack-first over the length histogram.

Each document's ids (with an end id) are cut into full pieces and a remainder. The histogram
of piece lengths, which has at most ``capacity`` entries, is packed on the driver: lengths
are placed longest first, each into the pack with the most space, and whole groups of equal
packs are placed at once, so only counts of packing patterns change. Patterns are joined
back to pieces by their rank within their length. Ranks are counted in salted cells, so a
length that a third of all pieces share is spread over many tasks.

Results for edge cases: a null or empty text is a document of the end id alone; no
documents make no pieces; repeated rows are packed as often as they occur, in any order
among themselves; a document longer than ``capacity`` lies in several sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pick, spread, table, tune, written
from .tokens import crc32, encoder, ids_column, texts, vocabulary

CAPACITY = 2048
END_ID = 1
#: Pieces of one length that are ranked together.
CELL = 4096


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of each document; no shuffle."""
    docs = spread(pick(docs, doc_id=id_col, text=text_col))
    tune(docs.sparkSession)
    end = np.asarray([end_id], "<i4").tobytes()
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(texts(b.column(1))):
                own = encode(text) + end
                n = len(own) // 4
                for a in range(0, n, capacity):
                    piece = own[4 * a : 4 * (a + capacity)]
                    row.append(i)
                    start.append(a)
                    length.append(len(piece) // 4)
                    crc.append(crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            columns = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + [ids_column(ids)] * with_ids, names)

    return docs.mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (count of packs, [(length, how often)]) for counts of lengths.

    Placing a length either ends its count or uses up a whole group of packs, so there are
    at most twice as many patterns as lengths, besides those of newly opened packs.
    """
    space: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            while top > 0 and not space[top]:
                top -= 1
            if top < length:
                each = capacity // length
                full, rest = divmod(left, each)
                for count, times in ((full, each), (min(rest, 1), rest)):
                    if count:
                        space[free := capacity - times * length].append((count, [(length, times)]))
                        top = max(top, free)
                left = 0
                continue
            count, pattern = space[top].pop()
            taken = min(count, left)
            if count > taken:
                space[top].append((count - taken, pattern))
            left -= taken
            last, times = pattern[-1]
            grown = [*pattern[:-1], (last, times + 1)] if last == length else [*pattern, (length, 1)]
            space[top - length].append((taken, grown))
    return [group for groups in space for group in groups]


def pattern_slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how often in a pack, first sequence, offset) for each pattern's lengths."""
    slots, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            slots.append((length, first, first + count * times, times, sequence, offset))
            ranks[length] = first + count * times
            offset += length * times
        sequence += count
    return slots


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, start and length) with sequence_id and offset.

    Broadcast are the patterns' slots: their number depends on ``capacity``, not on the data.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pattern_slots(pack_histogram(histogram, capacity))
    slots_df = spark.createDataFrame(slots, "s_length long, s_first long, s_end long, s_times long, s_sequence long, s_offset long")
    salts = max(1, math.ceil(max(histogram.values(), default=1) / CELL))
    others = [c for c in pieces.columns if c not in ("length", "doc_id", "start")]
    salted = pieces.withColumn("r_salt", F.pmod(F.xxhash64("doc_id", "start", *others), F.lit(salts)))
    cells = salted.groupBy("length", "r_salt").agg(F.count("*").alias("r_n"))
    before = F.sum("r_n").over(Window.partitionBy("length").orderBy("r_salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("length").alias("c_length"), F.col("r_salt").alias("c_salt"), F.coalesce(before, F.lit(0)).alias("c_before"))
    scalar = [c for c, kind in pieces.dtypes if c in others and not kind.startswith(("array", "map", "struct"))]
    own = F.row_number().over(Window.partitionBy("length", "r_salt").orderBy("doc_id", "start", *scalar))
    ranked = salted.withColumn("r_own", own).join(cells, (F.col("length") == F.col("c_length")) & (F.col("r_salt") == F.col("c_salt")))
    ranked = ranked.withColumn("r_rank", F.col("c_before") + F.col("r_own") - 1)
    met = ranked.join(F.broadcast(slots_df), (F.col("length") == F.col("s_length")) & (F.col("r_rank") >= F.col("s_first")) & (F.col("r_rank") < F.col("s_end")))
    step = F.col("r_rank") - F.col("s_first")
    return met.select(
        *pieces.columns,
        (F.col("s_sequence") + F.floor(step / F.col("s_times"))).cast("long").alias("sequence_id"),
        (F.col("s_offset") + F.pmod(step, F.col("s_times")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: where it comes from and where it lies."""
    return place_pieces(written(cut_documents(docs, path, capacity, end_id, with_ids), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
