"""Statistics of coded streams: contexts, ranks, adaptive probabilities, parameter fits, prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

#: Values that a recency list holds, of branches and of words.
RECENT_BRANCHES, RECENT_WORDS = 152, 88


def fold_sorted(rows: DataFrame, key: str, order: list[str], value: str, start: Callable[[], object], step: Callable[[object, object], object], finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """A fold over each key's values in order, that keeps one key's state at a time.

    A key's rows stream through one task, in sorted batches, so a hot key needs time but no memory.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("x")).repartition(parts, "k")
    sorted_rows = sorted_rows.sortWithinPartitions("k", *[f"o{i}" for i in range(len(order))]).select("k", "x")
    kind = sorted_rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, out, names = None, None, [], None
        for b in batches:
            names = [f.strip().split(" ")[0] for f in f"{key} {kind}, {schema}".split(",")]
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or k != own:
                    if state is not None:
                        out.append((own, *finish(state)))
                    own, state = k, start()
                state = step(state, x)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], types)
            out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (own, *finish(state)), strict=True))], types)

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"{key} {kind}, {schema}"
    types = to_arrow_schema(rows.sparkSession.createDataFrame([], full).schema)
    return sorted_rows.mapInArrow(run, full)


def adaptive_prob(rows: DataFrame, key: str, order: list[str], bit: str, rate: int = 4) -> DataFrame:
    """(key, n, p): the adaptive 12-bit probability of zero after each key's bits."""

    def step(s: tuple, b: int) -> tuple:
        n, p = s
        return n + 1, p - (p >> rate) if b else p + ((4096 - p) >> rate)

    return fold_sorted(rows, key, order, bit, lambda: (0, 2048), step, lambda s: s, "n long, p long")


def recency_rank(rows: DataFrame, key: str, order: list[str], symbol: str, symbols: list[str], cap: int = RECENT_BRANCHES, seed: object = None) -> DataFrame:
    """``rows`` with rank: the symbol's place in a move-to-front list before this row, -1 if it isn't there.

    The list starts with ``seed`` (if any) and holds ``cap`` symbols; a new one drives the last out. So it holds
    the ``cap`` that occurred last, and the rank is the number of others since the symbol's own last
    place. ``symbols`` are all that occur: each one's last place is a window maximum.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("r_at", F.row_number().over(w))
    places = [F.max(F.when(F.col(symbol) == s, F.col("r_at"))).over(before) for s in symbols]
    last = F.array(*[F.coalesce(p, F.lit(0)) if s == seed else p for s, p in zip(symbols, places, strict=True)])
    placed = placed.withColumn("r_last", last)
    own = F.get(F.col("r_last"), F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col(symbol)).cast("int") - 1)
    place = F.size(F.filter("r_last", lambda x: x > own))
    rank = F.when(own.isNull() | (place >= cap), -1).otherwise(place)
    return placed.withColumn("rank", rank.cast("long")).drop("r_at", "r_last")


def repeat_flags(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with repeated (equal to the value before, at first 0) and its context: the flag before, and 2 if the last value is 0."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("last", F.lag(value, 1, 0).over(w)).withColumn("repeated", F.when(F.col("last") == F.col(value), 1).otherwise(0))
    return marked.withColumn("context", bits.repeat_context(F.lag("repeated", 1, 0).over(w), F.col("last")).cast("long")).drop("last")


def kind_contexts(rows: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """``rows`` with context: the two token kinds before, the later one in the low bit."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("context", (2 * F.lag(kind, 2, 0).over(w) + F.lag(kind, 1, 0).over(w)).cast("long"))


def rice_fit(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, k, cost): the Rice parameter of least total length, the lowest of equals; one pass with 16 sums."""
    costs = [F.when(F.min(bits.rice_feasible(value, k).cast("int")) == 1, F.sum(bits.rice_length(value, k).cast("long"))).alias(f"c{k}") for k in range(16)]
    best = F.array_min(F.array(*[F.when(F.col(f"c{k}").isNotNull(), F.struct(F.col(f"c{k}").alias("cost"), F.lit(k).cast("long").alias("k"))) for k in range(16)]))
    return rows.groupBy(key).agg(*costs).select(key, best.alias("b")).select(key, F.col("b.k").alias("k"), F.col("b.cost").alias("cost"))


def average_price(flags: DataFrame, key: str, cost: str, fallback: Column) -> DataFrame:
    """(key, price): the observed average, rounded down, or the prior's price where nothing was observed."""
    n, total = F.count(cost), F.sum(cost)
    return flags.groupBy(key).agg(F.coalesce(F.floor(total / F.when(n > 0, n)), F.first(fallback)).cast("long").alias("price"))


def suffix_min(rows: DataFrame, key: str, length: str, price: str) -> DataFrame:
    """``rows`` with cheapest: the least price among candidates at least as long."""
    w = Window.partitionBy(key).orderBy(length).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("cheapest", F.min(price).over(w).cast("long"))


def plan_argmin(costs: DataFrame, key: str) -> DataFrame:
    """(key, plan, size): the smallest of plans (ord, plan, size), the earliest of equals; null sizes are infeasible."""
    best = F.min_by(F.struct("plan", "size"), F.struct("size", "ord"))
    return costs.where("size is not null").groupBy(key).agg(best.alias("b")).select(key, "b.plan", "b.size")


def parity_histogram(images: DataFrame, key: str) -> DataFrame:
    """(key, parity, v, n): how often each byte stands at even and odd addresses, plus one.

    Bytes are counted within generated code and summed partially, so a shuffle gets at most 512 rows a key and task.
    """
    from ..sources.images import exploded

    counted = exploded(images.select(key, "content")).groupBy(key, (F.col("pos") % 2).cast("long").alias("parity"), F.col("v").cast("long").alias("v")).agg(F.count("*").alias("n"))
    every = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.struct(p.cast("long").alias("parity"), v.cast("long").alias("v"))))))
    spine = images.select(key).distinct().select(key, every.alias("e")).select(key, "e.parity", "e.v")
    return spine.join(counted, [key, "parity", "v"], "left").select(key, "parity", "v", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def seed_tree(histogram: DataFrame, key: str) -> DataFrame:
    """(key, parity, node, p): each tree node's 8-bit probability of its left half; node is 2^depth + prefix."""
    halves = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.struct((F.pow(F.lit(2.0), d).cast("long") + F.floor(F.col("v") / F.pow(F.lit(2.0), 8 - d)).cast("long")).alias("node"), (F.floor(F.col("v") / F.pow(F.lit(2.0), 7 - d)).cast("long") % 2 == 0).alias("left"))))
    rows = histogram.select(key, "parity", "v", "n").select(key, "parity", "n", halves.alias("h"))
    sums = rows.groupBy(key, "parity", F.col("h.node").alias("node")).agg(F.sum(F.when(F.col("h.left"), F.col("n")).otherwise(0)).alias("left"), F.sum("n").alias("all"))
    return sums.select(key, "parity", "node", bits.tree_prob(bits.ratio_prob(F.col("left"), F.col("all")).cast("int")).cast("long").alias("p"))
