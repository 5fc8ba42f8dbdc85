"""Operation plans: (diff_len, extra_len, adj) rows per key, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits


def op_walk(ops: DataFrame, key: str, order: str, fp_start: Column | int = 0) -> DataFrame:
    """``ops`` with tp and fp, the target and source cursors before each op."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(fp_start) if isinstance(fp_start, int) else fp_start
    walked = ops.withColumn("tp", F.coalesce(F.sum(F.col("diff_len") + F.col("extra_len")).over(before), F.lit(0)).cast("long"))
    return walked.withColumn("fp", (start + F.coalesce(F.sum(F.col("diff_len") + F.col("adj")).over(before), F.lit(0))).cast("long"))


def apply_order(op_no: Column, n: Column, forward: Column) -> Column:
    """The step at which an op is applied: forward in order, else from the last."""
    return F.when(forward, op_no).otherwise(n - 1 - op_no)


def fold_seeks(ops: DataFrame, key: str, order: str) -> DataFrame:
    """Ops without output are folded into the adj of the op before; those that lead become fp_start.

    Rows: (key, kept_no, diff_len, extra_len, adj, fp_start); kept_no 0 with no output holds a leading seek only.
    """
    some = (F.col("diff_len") != 0) | (F.col("extra_len") != 0)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    groups = ops.withColumn("kept_no", F.sum(F.when(some, 1).otherwise(0)).over(upto))
    folded = groups.groupBy(key, "kept_no").agg(F.sum("diff_len").cast("long").alias("diff_len"), F.sum("extra_len").cast("long").alias("extra_len"), F.sum("adj").cast("long").alias("adj"))
    return folded.select(
        key, F.col("kept_no").cast("long").alias("kept_no"), "diff_len", "extra_len", F.when(F.col("kept_no") == 0, 0).otherwise(F.col("adj")).cast("long").alias("adj"),
        F.when(F.col("kept_no") == 0, F.col("adj")).otherwise(0).cast("long").alias("fp_start"),
    )


def hazard_runs(walked: DataFrame) -> DataFrame:
    """``walked`` (with from_size, to_size, forward) with runs: array of (begin, end) of copies that would read what was overwritten.

    Source and target stand a fixed distance apart within a copy. Up to a page apart nothing is
    committed yet, from two pages on everything is; between, a run at one end of each target page
    is. So runs are made page by page, not byte by byte.
    """
    page = bits.PAGE
    low = F.greatest(F.lit(0).cast("long"), -F.col("fp"))
    high = F.least(F.col("diff_len"), F.least("from_size", "to_size") - F.col("fp"))
    apart = F.when(F.col("forward"), F.col("tp") - F.col("fp")).otherwise(F.col("fp") - F.col("tp"))
    found = walked.withColumns({"h_low": low, "h_high": high, "h_apart": apart})
    run = lambda b, e: F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end"))
    edge = F.col("h_apart") - page
    begin = lambda p: p * page + F.when(F.col("forward"), 0).otherwise(page - edge)
    inside = lambda x: F.least(F.greatest(x - F.col("tp"), F.col("h_low")), F.col("h_high"))
    numbers = F.sequence(bits.page_number(F.col("tp") + F.col("h_low")), bits.page_number(F.col("tp") + F.col("h_high") - 1))
    by_page = F.filter(F.transform(numbers, lambda p: run(inside(begin(p)), inside(begin(p) + edge))), lambda r: r["begin"] < r["end"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    some = F.col("h_low") < F.col("h_high")
    runs = F.when(some & (F.col("h_apart") >= 2 * page), F.array(run(F.col("h_low"), F.col("h_high")))).when(some & (F.col("h_apart") > page), by_page).otherwise(none)
    return found.withColumn("runs", runs).drop("h_low", "h_high", "h_apart")


def literalised(walked: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, part, diff_len, extra_len, adj): each hazardous run becomes an insertion and an equal source skip."""
    runs = hazard_runs(walked)
    piece = lambda d, e, a: F.struct(d.cast("long").alias("diff_len"), e.cast("long").alias("extra_len"), a.cast("long").alias("adj"))
    cut = F.transform(F.col("runs"), lambda r, i: piece(r["begin"] - F.when(i > 0, F.get(F.col("runs"), i - 1)["end"]).otherwise(0), r["end"] - r["begin"], r["end"] - r["begin"]))
    done = F.when(F.size("runs") > 0, F.element_at("runs", -1)["end"]).otherwise(0)
    whole = F.concat(cut, F.array(piece(F.col("diff_len") - done, F.col("extra_len"), F.col("adj"))))
    return runs.select(key, order, F.posexplode(whole).alias("part", "o")).select(key, order, "part", "o.diff_len", "o.extra_len", "o.adj")


def merged_spans(spans: DataFrame, key: str, order: str) -> DataFrame:
    """(key, start, length, parts): spans of type S that follow each other without a gap are one."""
    w = Window.partitionBy(key).orderBy(order)
    follows = (F.col("kind") == "S") & (F.lag("kind").over(w) == "S") & (F.lag("start").over(w) + F.lag("length").over(w) == F.col("start"))
    marked = spans.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    groups = marked.withColumn("token_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(key, "token_no").agg(F.min("kind").alias("kind"), F.min("start").cast("long").alias("start"), F.sum("length").cast("long").alias("length"), F.count("*").alias("parts"))
