"""Relocatable fields of Thumb code: branches and literal-pool words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.images import byte_values


def literal_targets(images: DataFrame, key: str) -> DataFrame:
    """(key, target, back): aligned words that a literal load points to, with the distance to the nearest one before.

    Instructions are halfwords at even addresses; a target must lie in the image with its four
    bytes. The minimum is partial before the shuffle.
    """
    halves = images.select(key, F.octet_length("content").alias("size"), byte_values(F.col("content")).alias("v"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda i: F.struct((2 * i).alias("a"), (F.get(F.col("v"), 2 * i) + 256 * F.get(F.col("v"), 2 * i + 1)).alias("up")))
    loads = F.filter(F.when(F.size("v") >= 2, pairs).otherwise(F.array().cast("array<struct<a:int,up:int>>")), lambda h: bits.is_literal_load(h["up"]))
    rows = halves.select(key, "size", F.explode(loads).alias("h"))
    target = bits.literal_target(F.col("h.a"), F.col("h.up"))
    rows = rows.select(key, target.alias("target"), (target - F.col("h.a")).alias("back"), "size")
    return rows.where(F.col("target") + 4 <= F.col("size")).groupBy(key, "target").agg(F.min("back").cast("long").alias("back"))


def classified(fields: DataFrame) -> DataFrame:
    """``fields`` (pc, f_up, f_low, t_up, t_low, pure, loaded) with kind, delta and key.

    A branch comes first; it is suppressed where it isn't pure, or its delta doesn't give the
    target's bytes back. Otherwise a pure word that a load points to is one by difference.
    """
    branch = bits.is_branch(F.col("f_up"), F.col("f_low"))
    delta = bits.branch_signed(F.col("f_up"), F.col("f_low")) - bits.branch_signed(F.col("t_up"), F.col("t_low"))
    moved = bits.branch_moved(F.col("f_up"), F.col("f_low"), delta)
    same = bits.is_branch(F.col("t_up"), F.col("t_low")) & (bits.branch_pack_up(moved) == F.col("t_up")) & (bits.branch_pack_low(moved) == F.col("t_low"))
    word = lambda a, b: bits.long(a) + 65536 * bits.long(b)
    kind = F.when(branch & F.col("pure") & same, "BL").when(branch, "SBL").when(F.col("pure") & F.col("loaded"), "EX").otherwise("NONE")
    out = fields.withColumn("kind", kind)
    ex = bits.i32(word(F.col("f_up"), F.col("f_low")) - word(F.col("t_up"), F.col("t_low")))
    by_kind = lambda bl, ex: F.when(F.col("kind") == "BL", bl).when(F.col("kind") == "EX", ex).otherwise(F.lit(0).cast("long"))
    return out.withColumn("delta", by_kind(delta, ex)).withColumn("key", by_kind(bits.branch_target(F.col("pc"), F.col("f_up"), F.col("f_low")), word(F.col("f_up"), F.col("f_low"))))


def shift_at(entries: list[tuple[int, int]], x: Column) -> Column:
    """The shift of the last boundary at or before x, else 0; a map has at most 48 entries, so they are literals."""
    if not entries:
        return F.lit(0).cast("long")
    if len(entries) > MAP_ENTRIES:
        raise ValueError(f"a shift map has at most {MAP_ENTRIES} entries")
    found = F.lit(0).cast("long")
    for b, v in sorted(entries):
        found = F.when(x >= b, F.lit(v).cast("long")).otherwise(found)
    return found


MAP_ENTRIES = 48
MAP_POOL = 160


def candidate_pool(walked: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, b, v, w, ord): op boundaries, a last one of shift 0, and runs of words with one shift.

    walked: (key, op_no, fp, tp, diff_len, from_size, to_size); words: (key, word_no, word, need).
    """
    from pyspark.sql import Window

    ops = walked.where("diff_len > 0 and fp >= 0").select(key, F.col("fp").alias("b"), (F.col("tp") - F.col("fp")).alias("v"), F.col("diff_len").cast("long").alias("w"), F.lit(0).alias("part"), F.col("op_no").cast("long").alias("no"))
    ends = walked.groupBy(key).agg(F.max(F.greatest("from_size", "to_size")).alias("b")).select(key, "b", F.lit(0).cast("long").alias("v"), F.lit(0x7FFFFFFF).cast("long").alias("w"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("no"))
    by = Window.partitionBy(key).orderBy("word", "word_no")
    shifts = words.where("need != -2147483648").select(key, "word", "word_no", bits.i32(-F.col("need")).alias("v"))
    marked = shifts.withColumn("new", F.when(F.lag("v").over(by).eqNullSafe(F.col("v")), 0).otherwise(1))
    grouped = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run", "v").agg(F.min("word").alias("b"), F.count("*").alias("w"))
    runs = grouped.select(key, "b", "v", "w", F.lit(2).alias("part"), F.col("run").cast("long").alias("no"))
    pool = ops.unionByName(ends).unionByName(runs)
    return pool.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("part", "no"))).drop("part", "no")


def trimmed(pool: DataFrame, key: str, most: int = MAP_POOL) -> DataFrame:
    """The ``most`` heaviest entries; of equal weight the earlier go first."""
    from pyspark.sql import Window

    heavy = Window.partitionBy(key).orderBy(F.col("w").desc(), F.col("ord").desc())
    return pool.withColumn("rank", F.row_number().over(heavy)).where(F.col("rank") <= most).drop("rank")


def finished(pool: DataFrame, key: str) -> DataFrame:
    """(key, b, v) of a map: of one boundary the later entry, none that repeats the shift before; a lone 0 is no map."""
    from pyspark.sql import Window

    last = Window.partitionBy(key, "b").orderBy(F.col("ord").desc())
    once = pool.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    by = Window.partitionBy(key).orderBy("b")
    kept = once.withColumn("p", F.lag("v").over(by)).where(F.col("p").isNull() | (F.col("p") != F.col("v"))).select(key, "b", "v")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("not (n = 1 and v = 0)").drop("n")


def map_feasible(entries: DataFrame, key: str) -> DataFrame:
    """(key, feasible): boundaries ascend, and no gap or value is beyond what the code can hold."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("b")
    gap = F.when(F.lag("b").over(by).isNull(), F.col("b")).otherwise(F.col("b") - F.lag("b").over(by) - 1)
    ok = (gap >= 0) & (gap != 0xFFFFFFFF) & (bits.zigzag("v") != 0xFFFFFFFF)
    return entries.withColumn("ok", ok).groupBy(key).agg(F.every("ok").alias("feasible"))
