"""Incremental page commits: keyed state with a window of two uncommitted pages.

Rows (run, seq, page, total) of a run arrive in any number of micro-batches and in any order; seq
counts the run's writes from 0. A write that comes early waits in the state until its turn, one that
comes again is ignored, so results don't depend on how the rows lie in files. State holds the run's
next sequence number, its frontier, what its uncommitted pages got, and the writes that came early. A
page is final once the frontier is two pages past it, and is emitted then, once, in append mode; the
rest is flushed in writing order when the whole counted run has come. Writes behind the window are
late: they are emitted as such and change no page. A run that isn't whole yet stays open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bits import PAGE, PAGE_DEPTH
from ..sources.scratch import scratch_dir

OUTPUT = "run long, kind string, page long, writes long"
STATE = "next long, frontier long, pages string, early string"


def _pairs(text: str) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in (x.split(":") for x in text.split(",") if x)]


def _text(pairs) -> str:
    return ",".join(f"{a}:{b}" for a, b in pairs)


class Frontier:
    """One run's writes, in their order."""

    def __init__(self, next_seq: int = 0, frontier: int = -1, pages: str = "", early: str = ""):
        self.next, self.frontier, self.pages, self.early = next_seq, frontier, dict(_pairs(pages)), _pairs(early)
        heapq.heapify(self.early)

    def state(self) -> tuple[int, int, str, str]:
        return self.next, self.frontier, _text(sorted(self.pages.items())), _text(self.early)

    def come(self, seq: int, page: int) -> Iterator[tuple[str, int, int]]:
        """What a write, and those that waited for it, bring out: (kind, page, writes)."""
        if seq >= self.next:
            heapq.heappush(self.early, (seq, page))
        while self.early and self.early[0][0] <= self.next:
            turn, page = heapq.heappop(self.early)
            if turn == self.next:
                self.next += 1
                yield from self._write(page)

    def _write(self, page: int) -> Iterator[tuple[str, int, int]]:
        if page <= self.frontier - PAGE_DEPTH:
            yield "late", page, 1
            return
        self.pages[page] = self.pages.get(page, 0) + 1
        if page > self.frontier:
            self.frontier = page
            for p in sorted(p for p in self.pages if p <= page - PAGE_DEPTH):
                yield "page", p, self.pages.pop(p)

    def flush(self) -> Iterator[tuple[str, int, int]]:
        for p in sorted(self.pages):
            yield "page", p, self.pages[p]


def _commit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    run = Frontier(*state.get) if state.exists else Frontier()
    out = [] if state.exists else [("ready", None, 0)]
    total = 0
    for rows in batches:
        total = int(rows["total"].iloc[0])
        for seq, page in zip(rows["seq"].tolist(), rows["page"].tolist(), strict=True):
            out += run.come(seq, page)
        yield _rows(key[0], out)
        out = []
    if run.next >= total:
        yield _rows(key[0], list(run.flush()))
        state.remove()
    else:
        state.update(run.state())


def _rows(run: int, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(run, *x) for x in out], columns=["run", "kind", "page", "writes"]).astype({"run": "Int64", "page": "Int64"})


def committed_pages(writes: DataFrame) -> DataFrame:
    """OUTPUT rows of streamed writes (run, seq, page, total): total is the number of writes that the run has."""
    return writes.groupBy("run").applyInPandasWithState(_commit, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_pages(writes: DataFrame) -> DataFrame:
    """(run, kind, page, writes): what the stream brings out in the end, late writes summed by page, as one window and one aggregation."""
    before = F.max("page").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(F.col("page") <= F.col("before") - PAGE_DEPTH, F.lit(False))
    return writes.withColumn("before", before).groupBy("run", F.when(late, "late").otherwise("page").alias("kind"), "page").agg(F.count("*").alias("writes"))


def sequenced(events: DataFrame) -> DataFrame:
    """(run, seq, page, total) of events: a run for each user, in order of time."""
    of_user = Window.partitionBy("user_id")
    seq = F.row_number().over(of_user.orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("run"), seq.cast("long").alias("seq"), F.floor(F.col("event_id") / PAGE).cast("long").alias("page"), F.count("*").over(of_user).alias("total"))


def replay(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """(user_id, kind, page, writes): the events table streamed as page writes, one of several shuffled files at a time; late writes are summed by page."""
    where = scratch_dir(spark)
    writes = sequenced(spark.read.parquet(f"{sf_dir}/events.parquet"))
    writes.repartition(files).write.parquet(f"{where}/writes")
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/writes")
    query = committed_pages(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(OUTPUT).parquet(f"{where}/out").where("kind != 'ready'")
    return out.groupBy(F.col("run").alias("user_id"), "kind", "page").agg(F.sum("writes").alias("writes"))
