"""Same-offset alignment of a pair's two images, within the pair's row: no byte is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import uleb_length
from ..sources.images import byte_values, positions


def common(pairs: DataFrame) -> Column:
    """The length that both images have."""
    return F.least(F.octet_length("f"), F.octet_length("t"))


def sizes(pairs: DataFrame) -> DataFrame:
    """Sizes and checksums of both images, and the natural direction."""
    a, b = F.octet_length("f").cast("long"), F.octet_length("t").cast("long")
    return pairs.select("pair_id", a.alias("from_size"), b.alias("to_size"), F.crc32("f").alias("from_crc"), F.crc32("t").alias("to_crc"), (b > a).alias("descending"))


def diff_values(pairs: DataFrame) -> DataFrame:
    """(pair_id, d): an array of diff bytes over the common length, t - f modulo 256."""
    d = F.zip_with(F.slice(byte_values(F.col("f")), F.lit(1), common(pairs)), F.slice(byte_values(F.col("t")), F.lit(1), common(pairs)), lambda f, t: F.pmod(t - f, F.lit(256)))
    return pairs.select("pair_id", F.octet_length("f").cast("long").alias("from_size"), F.octet_length("t").cast("long").alias("to_size"), d.alias("d"))


def diff_runs(pairs: DataFrame) -> DataFrame:
    """(pair_id, run_no, begin, length): maximal runs of bytes that differ."""
    n = common(pairs)
    differs = lambda i: F.substring(F.col("f"), i + 1, F.lit(1)) != F.substring(F.col("t"), i + 1, F.lit(1))
    begins = F.filter(positions(n), lambda i: differs(i) & ((i == 0) | ~differs(i - 1)))
    ends = F.filter(positions(n), lambda i: differs(i) & ((i == n - 1) | ~differs(i + 1)))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("begin"), (b - a + 1).alias("length")))
    return pairs.select("pair_id", F.posexplode(runs).alias("run_no", "r")).select("pair_id", "run_no", F.col("r.begin").cast("long").alias("begin"), F.col("r.length").cast("long").alias("length"))


def literal_gaps(pairs: DataFrame, forward: bool = True) -> DataFrame:
    """(pair_id, lit_no, pos, gap, gap_bytes, d): the bytes that differ, in writing order, with their coded gaps.

    Forward gaps count from 0, the others step back from the copy's end.
    """
    n = common(pairs)
    own = F.filter(positions(n), lambda i: F.substring(F.col("f"), i + 1, F.lit(1)) != F.substring(F.col("t"), i + 1, F.lit(1)))
    found = pairs.select("pair_id", "f", "t", (own if forward else F.reverse(own)).alias("own"), (F.lit(0) if forward else n).alias("start"))
    before = F.slice(F.concat(F.array("start"), "own"), F.lit(1), F.size("own"))
    rows = found.select("pair_id", "f", "t", F.posexplode(F.zip_with("own", before, lambda p, b: F.struct(p.alias("pos"), b.alias("before")))).alias("no", "x"))
    gap = F.abs(F.col("x.pos") - F.col("x.before"))
    one = lambda c: F.conv(F.hex(F.substring(F.col(c), F.col("x.pos") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("pair_id", F.col("no").cast("long").alias("lit_no"), F.col("x.pos").cast("long").alias("pos"), gap.cast("long").alias("gap"), uleb_length(gap).alias("gap_bytes"), F.pmod(one("t") - one("f"), F.lit(256)).alias("d"))


def summary(pairs: DataFrame) -> DataFrame:
    """A row for each pair: sizes, checksums, runs, differing bytes and appended length."""
    n = common(pairs)
    differs = lambda i: F.substring(F.col("f"), i + 1, F.lit(1)) != F.substring(F.col("t"), i + 1, F.lit(1))
    own = F.filter(positions(n), differs)
    met = pairs.withColumn("own", own)
    n_runs = F.size(F.filter(F.transform(F.col("own"), lambda x, i: (i == 0) | (F.get(F.col("own"), i - 1) != x - 1)), lambda b: b))
    return met.select(
        "pair_id", F.octet_length("f").cast("long").alias("from_size"), F.octet_length("t").cast("long").alias("to_size"), F.crc32("f").alias("from_crc"), F.crc32("t").alias("to_crc"),
        n_runs.cast("long").alias("n_runs"), F.size("own").cast("long").alias("diff_bytes"), (F.octet_length("t") - n).cast("long").alias("extra_len"),
    )


def same_offset_plan(pairs: DataFrame) -> DataFrame:
    """(pair_id, f, copied, literals, extra): a copy's length, its literals in order with their gaps (the first counts from 0), and what is appended."""
    n = common(pairs)
    own = F.filter(positions(n), lambda i: F.substring(F.col("f"), i + 1, F.lit(1)) != F.substring(F.col("t"), i + 1, F.lit(1)))
    before = F.slice(F.concat(F.array(F.lit(0)), F.col("own")), F.lit(1), F.size("own"))
    literals = F.zip_with("own", before, lambda p, b: F.struct(p.alias("pos"), (p - b).alias("gap"), F.pmod(_byte("t", p) - _byte("f", p), F.lit(256)).alias("d")))
    extra = F.substring(F.col("t"), n + 1, F.octet_length("t") - n)
    return pairs.withColumn("own", own).select("pair_id", "f", n.alias("copied"), literals.alias("literals"), extra.alias("extra"))


def _byte(image: str, at: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col(image), at + 1, F.lit(1))), 16, 10).cast("int")


def apply_same_offset(plans: DataFrame) -> DataFrame:
    """(pair_id, out): the image that a ``same_offset_plan`` makes of its source alone: untouched stretches, literals, extras."""
    skip = lambda i: F.when(i > 0, 1).otherwise(0)  # noqa: E731  the literal before is written already
    kept = lambda x, i: F.hex(F.substring(F.col("f"), x["pos"] - x["gap"] + skip(i) + 1, x["gap"] - skip(i)))
    new = lambda x: F.lpad(F.hex(F.pmod(_byte("f", x["pos"]) + x["d"], F.lit(256))), 2, "0")
    done = F.array_join(F.transform("literals", lambda x, i: F.concat(kept(x, i), new(x))), "")
    last = F.coalesce(F.get("literals", F.size("literals") - 1)["pos"], F.lit(-1))
    rest = F.hex(F.substring(F.col("f"), last + 2, F.col("copied") - last - 1))
    return plans.select("pair_id", F.unhex(F.concat(done, rest, F.hex("extra"))).alias("out"))
