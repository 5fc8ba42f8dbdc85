"""How the catalogue's queries bind the driver's tables: the same bindings for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

#: Operations of each order, from its line items: copies, insertions and seeks; small quantities give no output.
OPS_SQL = f"""ops AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS BIGINT) AS op_no,
 CAST(CASE WHEN l_quantity < 8 THEN 0 ELSE l_quantity * 16 END AS BIGINT) AS diff_len,
 CAST(CASE WHEN l_quantity < 8 THEN 0 ELSE round(l_discount * 100) END AS BIGINT) AS extra_len,
 CAST(l_partkey % 1201 AS BIGINT) - 600 AS adj FROM lineitem)"""

WALK_SQL = f"""{OPS_SQL}, walk AS (SELECT *,
 CAST(coalesce(sum(diff_len + extra_len) OVER w, 0) AS BIGINT) AS tp, CAST(coalesce(sum(diff_len + adj) OVER w, 0) AS BIGINT) AS fp
 FROM ops WINDOW w AS (PARTITION BY l_orderkey ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

#: Image pairs: a document and the one before it that starts alike.
PAIRS_SQL = """pairs AS (SELECT doc_id AS pair_id, encode(f) AS f, encode(t) AS t, hex(encode(f)) AS fh, hex(encode(t)) AS th,
 CAST(octet_length(encode(f)) AS BIGINT) AS nf, CAST(octet_length(encode(t)) AS BIGINT) AS nt
 FROM (SELECT doc_id, lag(text) OVER (PARTITION BY substr(text, 1, 40) ORDER BY doc_id) AS f, text AS t FROM documents) WHERE f IS NOT NULL)"""

#: The bytes of the common length of each pair.
BYTES_SQL = f"""{PAIRS_SQL}, spots AS (SELECT pair_id, nf, nt, fh, th, unnest(range(least(nf, nt))) AS pos FROM pairs),
 bytes AS (SELECT pair_id, nf, nt, pos, CAST('0x' || substr(fh, 2 * pos + 1, 2) AS INTEGER) AS fv, CAST('0x' || substr(th, 2 * pos + 1, 2) AS INTEGER) AS tv FROM spots)"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("l_quantity") >= 8
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return lineitem(spark, sf_dir).select(
        "l_orderkey",
        F.row_number().over(by).cast("long").alias("op_no"),
        F.when(some, F.col("l_quantity") * 16).otherwise(0).cast("long").alias("diff_len"),
        F.when(some, F.round(F.col("l_discount") * 100)).otherwise(0).cast("long").alias("extra_len"),
        (F.col("l_partkey") % 1201 - 600).cast("long").alias("adj"),
    )


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words made of line items' keys: branches, loads and other words, with what they became."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    up = F.when(p % 5 == 0, 0x4800 + p % 256).otherwise(0xF000 + p % 2048)
    low = 0xD000 + (s * 37) % 4096
    return lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_orderkey") * 4).alias("pc"), up.cast("long").alias("f_up"), low.cast("long").alias("f_low"),
        F.when(p % 5 == 0, 0x4800 + p % 256).otherwise(0xF000 + (p + n) % 2048).cast("long").alias("t_up"),
        (0xD000 + (s * 37 + n * 11) % 4096).cast("long").alias("t_low"),
        (n % 3 != 0).alias("pure"), (p % 2 == 0).alias("loaded"),
    )


FIELDS_SQL = """fields AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey * 4 AS BIGINT) AS pc,
 CAST(CASE WHEN l_partkey % 5 = 0 THEN 18432 + l_partkey % 256 ELSE 61440 + l_partkey % 2048 END AS BIGINT) AS f_up,
 CAST(53248 + (l_suppkey * 37) % 4096 AS BIGINT) AS f_low,
 CAST(CASE WHEN l_partkey % 5 = 0 THEN 18432 + l_partkey % 256 ELSE 61440 + (l_partkey + l_linenumber) % 2048 END AS BIGINT) AS t_up,
 CAST(53248 + (l_suppkey * 37 + l_linenumber * 11) % 4096 AS BIGINT) AS t_low,
 l_linenumber % 3 <> 0 AS pure, l_partkey % 2 = 0 AS loaded FROM lineitem)"""


def imm_sql(up: str, low: str) -> str:
    """The signed immediate of a branch, in SQL."""
    s, a, b = f"(({up} >> 10) & 1)", f"(({low} >> 13) & 1)", f"(({low} >> 11) & 1)"
    raw = f"((({up} & 1023) << 11) | ({low} & 2047) | ({s} << 23) | ((1 - xor({a}, {s})) << 22) | ((1 - xor({b}, {s})) << 21))"
    return f"(CASE WHEN {raw} >= 8388608 THEN {raw} - 16777216 ELSE {raw} END)"


def i32_sql(x: str) -> str:
    u = f"((({x}) % 4294967296 + 4294967296) % 4294967296)"
    return f"(CASE WHEN {u} > 2147483647 THEN {u} - 4294967296 ELSE {u} END)"


def map_entries(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """A shift map of 48 entries at most, from the orders: bounded, so it may be collected."""
    o = orders(spark, sf_dir)
    span = o.agg(F.max("o_orderkey").alias("m"))
    cut = o.join(F.broadcast(span), F.lit(True)).groupBy(F.floor(F.col("o_orderkey") * 48 / (F.col("m") + 1)).alias("c"))
    return [(r["b"], r["v"]) for r in cut.agg(F.min("o_orderkey").alias("b"), (F.sum("o_custkey") % 257 - 128).alias("v")).collect()]


MAP_SQL = """entries AS (SELECT min(o_orderkey) AS b, CAST(sum(o_custkey) % 257 - 128 AS BIGINT) AS v
 FROM orders, (SELECT max(o_orderkey) AS m FROM orders) GROUP BY (o_orderkey * 48) // (m + 1))"""


def user_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as symbols, by user and time; 0 is the most usual."""
    number = F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), F.col("event_type")).cast("int") - 1
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", number.alias("symbol"), F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("bit"))


SYMBOLS = ["view", "click", "signup", "purchase", "error"]
SYMBOLS_SQL = """symbols AS (SELECT event_id, ts, user_id, event_type, CAST(list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) - 1 AS INTEGER) AS symbol,
 CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS bit FROM events)"""
