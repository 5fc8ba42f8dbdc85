"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text of any length is cut into units: single characters of scripts without spaces, else runs of other than
white space that end at a word's end, behind one of the characters _BREAKS, or at UNIT_CHARS. So a unit's
borders follow from the characters just before it, and a passage has the same units wherever it stands. A
k-mer of K units is an anchor if the least of its units' hashes is at its first or last unit. That depends on
the k-mer alone, so a text keeps its anchors wherever it stands, and about 2/K of all k-mers are anchors. A
fingerprint is the anchors' places and 32-bit hashes; likeness is twice the common distinct anchors
over the sum of both counts.

Results for edge cases: a text of fewer units than a k-mer has one anchor, of all its units; a null or empty text,
or one of white space, has none and an empty fingerprint; two texts without anchors are alike
(1), one without anchors is unlike any other (0); equal texts have equal fingerprints.
Among equal doc_ids the order is by text, and null doc_ids come first; an empty table gives no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import pick, spread, table

K = 5
UNIT_CHARS = 12
#: Characters behind which a unit ends: about a fifth of those of Latin texts, of numbers and of code.
_BREAKS = "cgkoswCGKOSW37/;,}="
#: Ranges of scripts that are written without spaces.
_SOLID = r"฀-໿က-႟ក-៿⺀-鿿豈-﫿"
_UNIT = rf"[^\s{_SOLID}{_BREAKS}]{{1,{UNIT_CHARS - 1}}}+[{_BREAKS}]?|[{_BREAKS}]|[{_SOLID}]"
_FIRST = -(1 << 63)
_LOW = 0xFFFFFFFF
#: Compressed input bytes that a range of doc_ids takes, and the most ranges (their bounds are one literal of the plan).
RANGE_BYTES = 32 << 20
MOST_RANGES = 100_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def packed_anchors(text: Column, k: int = K) -> Column:
    """array<bigint> of the closed syncmers of a text, in order: the place times 2^32, plus the hash as unsigned."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))
    pack = lambda at, h: at.cast("long") * F.lit(1 << 32) + h.cast("long").bitwiseAND(F.lit(_LOW))

    def of(h: Column) -> Column:
        n = F.size(h)
        at = lambda i, j: F.get(h, i + j)
        edge = lambda i: F.least(*[at(i, j) for j in range(k)]) >= F.least(at(i, 0), at(i, k - 1))
        chosen = F.filter(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), edge)
        found = F.transform(chosen, lambda i: pack(i, F.hash(*[at(i, j) for j in range(k)])))
        whole = F.array(pack(F.lit(0), F.hash(h)))
        return F.when(n >= k, found).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(units, lambda u: F.xxhash64(u)), of)


def anchors(text: Column, k: int = K) -> Column:
    """array<struct<at int, hash int>> of the closed syncmers of a text, in order."""
    return _unpacked(packed_anchors(text, k))


def _unpacked(packed: Column) -> Column:
    return F.transform(packed, lambda a: F.struct(F.shiftright(a, 32).cast("int").alias("at"), _signed(a).alias("hash")))


def _signed(a: Column) -> Column:
    low = a.bitwiseAND(F.lit(_LOW))
    return F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int")


def fingerprint(packed: Column) -> Column:
    """Packed anchors as text: numbers (place times 2^32, plus hash), joined by commas."""
    return F.array_join(packed.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct anchor hashes, from 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def distinct_hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda a: a.bitwiseAND(F.lit(_LOW))))


def match_anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two sets of ``fingerprints`` share anchors: (hash, a_id, a_at, b_id, b_at) for anchors that occur once in each document; places count units."""

    def once(df: DataFrame, x: str) -> DataFrame:
        rows = df.select(F.col("doc_id").alias(f"{x}_id"), F.explode("anchors").alias("n"))
        return rows.groupBy(f"{x}_id", F.col("n.hash").alias("hash")).agg(F.min("n.at").alias(f"{x}_at"), F.count("*").alias("c")).where("c = 1").drop("c")

    return once(a, "a").join(once(b, "b"), "hash")


def range_count(docs: DataFrame) -> int:
    """Ranges of doc_id, by the bytes of the input, one for each core at least."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // RANGE_BYTES)
    return min(parts, MOST_RANGES)


def with_next(docs: DataFrame, made: dict[str, Column], nexts: list[str], parts: int | None = None) -> DataFrame:
    """``docs`` with the columns ``made``, and next_<column> of the row that follows in ascending (doc_id, text); the first follows the last.

    Rows are dealt into ranges of doc_id, and each range's first row goes to the range before
    as well. What is made comes after the shuffle, which so carries ``docs`` alone. Collected are the
    ranges' bounds, one for each partition.
    """
    parts = parts or range_count(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = docs.select(key.alias("k")).agg(F.min("k").alias("low"), F.percentile_approx("k", shares, 100 * parts).alias("at")).first()
    bounds = sorted({b for b in (row["at"] or []) if b > row["low"]})
    n = len(bounds)
    known = [row["low"] if row["low"] is not None else _FIRST, *bounds]
    starts = F.split(F.lit(",".join(map(str, known))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(max(1, n.bit_length())))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(starts, at + s) <= F.col("w_key")), at + s).otherwise(at))
    dealt = docs.withColumn("w_key", key).withColumn("w_bucket", bucket)
    own = F.struct(F.col("w_bucket").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("w_bucket") - 1, F.lit(n + 1)).alias("b"), F.lit(True).alias("ghost"))
    dealt = dealt.withColumn("w_in", F.explode(F.when(F.col("w_key") == F.get(starts, F.col("w_bucket")), F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select(*docs.columns, "w_key", F.col("w_in.b").alias("w_part"), F.col("w_in.ghost").alias("w_ghost"))
    dealt = dealt.repartition(n + 1, "w_part").sortWithinPartitions("w_part", "w_ghost", "w_key", "text").withColumns(made)
    window = Window.partitionBy("w_part").orderBy("w_ghost", "w_key", "text")
    led = dealt.select(*docs.columns, *made, "w_ghost", *[F.lead(c).over(window).alias(f"next_{c}") for c in nexts])
    return led.where("not w_ghost").drop("w_ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, anchors, fingerprint) for each row; no shuffle."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("found", packed_anchors(F.col("text"), k))
    return docs.select("doc_id", _unpacked(F.col("found")).alias("anchors"), fingerprint(F.col("found")).alias("fingerprint"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and likenesses."""
    docs = spread(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")).withColumn("text", F.coalesce("text", F.lit("")))
    met = with_next(docs, {"found": packed_anchors(F.col("text"))}, ["text", "found"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    met = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "found", "next_found")
    met = met.withColumn("edited_found", packed_anchors(F.col("edited")))
    met = met.withColumns({f"{c}_set": distinct_hashes(F.col(c)) for c in ("found", "edited_found", "next_found")})
    near = lambda other: likeness(F.col("found_set"), F.col(f"{other}_set"))
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        near("edited_found").alias("near_edited"),
        near("next_found").alias("near_next"),
    )
