"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import align, coding, delta, fields, match, pages, pairs, walk
from ..sources import images
from ..sources.spread import spread
from . import inputs as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(images.documents(spark, sf_dir))


def _i32(x: str) -> str:
    return I.i32_sql(x)


@query("""SELECT 'document' AS kind, doc_id AS image_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size,
 CAST((octet_length(encode(coalesce(text, ''))) + 255) // 256 AS BIGINT) AS pages, CAST((octet_length(encode(coalesce(text, ''))) + 255) // 256 * 256 AS BIGINT) AS rounded FROM documents
 UNION ALL SELECT 'page', page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT), CAST((octet_length(encode(coalesce(html, ''))) + 255) // 256 AS BIGINT),
 CAST((octet_length(encode(coalesce(html, ''))) + 255) // 256 * 256 AS BIGINT) FROM pages""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = images.document_images(spark, sf_dir).unionByName(images.page_images(spark, sf_dir))
    n = F.octet_length("content").cast("long")
    return both.select("kind", "image_id", n.alias("size"), images.page_count(n).alias("pages"), bits.page_round_up(n).alias("rounded"))


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _crc(h: str) -> str:
    """CRC-32 of a hexadecimal column, in SQL."""
    return f"""xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all({h}, '..')]),
 lambda c, b: xor(c >> 8, CAST(({_crc_table()})[(xor(c, b) & 255) + 1] AS BIGINT))))"""


@query(f"""WITH i AS (SELECT 'document' AS kind, doc_id AS image_id, hex(encode(coalesce(text, ''))) AS h FROM documents UNION ALL SELECT 'page', page_id, hex(encode(coalesce(html, ''))) FROM pages),
 c AS (SELECT kind, image_id, {_crc('h')} AS crc FROM i) SELECT kind, image_id, crc, xor(crc, CAST(1 AS BIGINT)) AS wire_crc FROM c""")
def image_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = images.document_images(spark, sf_dir).unionByName(images.page_images(spark, sf_dir))
    return both.select("kind", "image_id", F.crc32("content").alias("crc"), bits.wire_crc(F.col("content")).alias("wire_crc"))


_SPINE = """spine AS (SELECT lang, p.parity, v.v FROM (SELECT DISTINCT lang FROM documents) d, (SELECT unnest(range(2)) AS parity) p, (SELECT unnest(range(256)) AS v) v),
 hexes AS (SELECT lang, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 spots AS (SELECT lang, h, unnest(range(n)) AS pos FROM hexes),
 counted AS (SELECT lang, pos % 2 AS parity, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT) AS v, count(*) AS n FROM spots GROUP BY ALL),
 hist AS (SELECT spine.lang, CAST(spine.parity AS BIGINT) AS parity, CAST(spine.v AS BIGINT) AS v, CAST(coalesce(counted.n, 0) + 1 AS BIGINT) AS n
  FROM spine LEFT JOIN counted ON spine.lang = counted.lang AND spine.parity = counted.parity AND spine.v = counted.v)"""


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(images.documents(spark, sf_dir).select("lang", "text")).select("lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query(f"WITH {_SPINE} SELECT * FROM hist")
def parity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.parity_histogram(_by_lang(spark, sf_dir), "lang")


@query(f"""WITH {_SPINE}, halves AS (SELECT lang, parity, n, (1 << d) + (v >> (8 - d)) AS node, (v >> (7 - d)) % 2 = 0 AS l FROM hist, (SELECT CAST(unnest(range(8)) AS INTEGER) AS d)),
 sums AS (SELECT lang, parity, CAST(node AS BIGINT) AS node, CAST(sum(CASE WHEN l THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(n) AS BIGINT) AS b FROM halves GROUP BY ALL)
 SELECT lang, parity, node, CAST(greatest(1, least(255, (greatest(1, least(4095, (8192 * a + b) // (2 * b))) + 8) >> 4)) AS BIGINT) AS p FROM sums""")
def seed_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.seed_tree(parity_histogram(spark, sf_dir), "lang")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END) % 2000000000 AS v FROM lineitem),
 z AS (SELECT *, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM v)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, z, CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END AS len, v AS back, z AS decoded FROM z""")
def zigzag_uleb_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1) % 2000000000
    rows = I.lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v")).withColumn("z", bits.zigzag("v"))
    return rows.select("*", bits.uleb_length("z").alias("len"), bits.unzigzag("z").alias("back"), bits.uleb_value(bits.uleb_bytes("z")).alias("decoded"))


@query("""WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)
 SELECT o_orderkey, v, CAST(length(bin(v)) AS INTEGER) AS bits, CAST(2 * length(bin(v + 1)) - 1 AS INTEGER) AS gamma, CAST(2 * length(bin(length(bin(v + 1)))) - 1 + length(bin(v + 1)) - 1 AS INTEGER) AS delta,
 CAST((v >> 9) + 1 + 9 AS BIGINT) AS rice FROM v""")
def gamma_delta_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.orders(spark, sf_dir).select("o_orderkey", F.round("o_totalprice").cast("long").alias("v"))
    return rows.select("*", bits.bit_length("v").alias("bits"), bits.gamma_length(F.col("v") + 1).alias("gamma"), bits.delta_length("v").alias("delta"), bits.rice_length("v", 9).cast("long").alias("rice"))


@query("""WITH v AS (SELECT l_returnflag, l_partkey * 3 + l_linenumber AS v FROM lineitem),
 c AS (SELECT l_returnflag, k, CAST(sum((v >> k) + 1 + k) AS BIGINT) AS cost, bool_and((v >> k) <= 1048576) AS ok FROM v, (SELECT CAST(unnest(range(16)) AS INTEGER) AS k) GROUP BY ALL)
 SELECT l_returnflag, CAST(k AS BIGINT) AS k, cost FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY cost, k) = 1""")
def rice_k_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.lineitem(spark, sf_dir).select("l_returnflag", (F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("v"))
    return coding.rice_fit(rows, "l_returnflag", "v")


@query(f"WITH {I.PAIRS_SQL} SELECT pair_id, nf AS from_size, nt AS to_size, nt > nf AS descending FROM pairs")
def natural_direction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = align.sizes(_pairs(spark, sf_dir))
    return n.select("pair_id", "from_size", "to_size", bits.natural_descending(F.col("from_size"), F.col("to_size")).alias("descending"))


@query("""WITH n AS (SELECT CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), p AS (SELECT n, unnest(range((n + 255) // 256)) AS page FROM n)
 SELECT CAST(page AS BIGINT) AS page, count(*) AS images, CAST(sum(least(n - page * 256, 256)) AS BIGINT) AS bytes FROM p GROUP BY page""")
def page_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.occupancy(images.document_images(spark, sf_dir))


_RUNS = f"""{I.BYTES_SQL}, marks AS (SELECT *, (fv <> tv) AS d, coalesce(lag(fv <> tv) OVER w, false) AS before FROM bytes WINDOW w AS (PARTITION BY pair_id ORDER BY pos)),
 starts AS (SELECT pair_id, pos, fv, tv, nf, sum(CASE WHEN d AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos) AS run FROM marks QUALIFY d)"""


@query(f"""WITH {_RUNS.replace(' QUALIFY d', '')}, per AS (SELECT pair_id, count(*) FILTER (WHERE fv <> tv) AS diff_bytes, max(run) AS n_runs FROM starts GROUP BY pair_id)
 SELECT pairs.pair_id, nf AS from_size, nt AS to_size, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(diff_bytes, 0) AS BIGINT) AS diff_bytes, nt - least(nf, nt) AS extra_len FROM pairs LEFT JOIN per USING (pair_id)""")
def same_offset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summary(_pairs(spark, sf_dir)).drop("from_crc", "to_crc")


@query(f"""WITH {_RUNS} SELECT pair_id, CAST(run - 1 AS INTEGER) AS run_no, min(pos) AS begin, count(*) AS length FROM starts GROUP BY pair_id, run""")
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.diff_runs(_pairs(spark, sf_dir))


@query(f"""WITH {I.BYTES_SQL}, own AS (SELECT *, row_number() OVER w - 1 AS lit_no, pos - coalesce(lag(pos) OVER w, 0) AS gap FROM bytes WHERE fv <> tv WINDOW w AS (PARTITION BY pair_id ORDER BY pos))
 SELECT pair_id, CAST(lit_no AS BIGINT) AS lit_no, pos, CAST(gap AS BIGINT) AS gap, CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END AS gap_bytes, CAST((tv - fv + 256) % 256 AS INTEGER) AS d FROM own""")
def diff_run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.literal_gaps(_pairs(spark, sf_dir))


@query(f"WITH {I.WALK_SQL} SELECT * FROM walk")
def op_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.op_walk(I.ops(spark, sf_dir), "l_orderkey", "op_no")


@query(f"""WITH {I.OPS_SQL}, g AS (SELECT *, sum(CASE WHEN diff_len <> 0 OR extra_len <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY op_no) AS kept_no FROM ops)
 SELECT l_orderkey, CAST(kept_no AS BIGINT) AS kept_no, CAST(sum(diff_len) AS BIGINT) AS diff_len, CAST(sum(extra_len) AS BIGINT) AS extra_len,
 CAST(CASE WHEN kept_no = 0 THEN 0 ELSE sum(adj) END AS BIGINT) AS adj, CAST(CASE WHEN kept_no = 0 THEN sum(adj) ELSE 0 END AS BIGINT) AS fp_start FROM g GROUP BY l_orderkey, kept_no""")
def seek_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.fold_seeks(I.ops(spark, sf_dir), "l_orderkey", "op_no")


def _sized_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walked ops, with the order's target size, a source 64 bytes longer or shorter, and the natural direction."""
    by = Window.partitionBy("l_orderkey")
    walked = op_walk(spark, sf_dir).withColumn("to_size", F.sum(F.col("diff_len") + F.col("extra_len")).over(by))
    walked = walked.withColumn("from_size", F.greatest(F.lit(0).cast("long"), F.col("to_size") + F.when(F.col("l_orderkey") % 2 == 0, 64).otherwise(-64)))
    return walked.withColumn("forward", ~bits.natural_descending(F.col("from_size"), F.col("to_size")))


_HAZARD = f"""{I.WALK_SQL}, s AS (SELECT *, CAST(sum(diff_len + extra_len) OVER (PARTITION BY l_orderkey) AS BIGINT) AS to_size FROM walk),
 z AS (SELECT *, greatest(0, to_size + CASE WHEN l_orderkey % 2 = 0 THEN 64 ELSE -64 END) AS from_size FROM s),
 f AS (SELECT *, NOT (to_size > from_size) AS forward FROM z), k AS (SELECT *, unnest(range(diff_len)) AS k FROM f),
 h AS (SELECT l_orderkey, op_no, k FROM k WHERE fp + k >= 0 AND fp + k < from_size AND fp + k < to_size
  AND CASE WHEN forward THEN fp + k < tp + k AND NOT ((fp + k) // 256 >= (tp + k) // 256 - 1) ELSE fp + k > tp + k AND NOT ((fp + k) // 256 <= (tp + k) // 256 + 1) END),
 i AS (SELECT *, k - row_number() OVER (PARTITION BY l_orderkey, op_no ORDER BY k) AS island FROM h)"""


@query(f"WITH {_HAZARD} SELECT l_orderkey, op_no, min(k) AS begin, max(k) + 1 AS \"end\" FROM i GROUP BY l_orderkey, op_no, island")
def copy_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = walk.hazard_runs(_sized_walk(spark, sf_dir))
    return runs.select("l_orderkey", "op_no", F.explode("runs").alias("r")).select("l_orderkey", "op_no", "r.begin", "r.end")


@query(f"""WITH {_HAZARD}, r AS (SELECT l_orderkey, op_no, min(k) AS b, max(k) + 1 AS e, row_number() OVER (PARTITION BY l_orderkey, op_no ORDER BY min(k)) - 1 AS part FROM i GROUP BY l_orderkey, op_no, island),
 c AS (SELECT l_orderkey, op_no, part, b - coalesce(lag(e) OVER (PARTITION BY l_orderkey, op_no ORDER BY part), 0) AS diff_len, e - b AS extra_len, e - b AS adj FROM r),
 t AS (SELECT ops.l_orderkey, ops.op_no, coalesce(x.n, 0) AS part, ops.diff_len - coalesce(x.e, 0) AS diff_len, ops.extra_len, ops.adj
  FROM ops LEFT JOIN (SELECT l_orderkey, op_no, count(*) AS n, max(e) AS e FROM r GROUP BY ALL) x USING (l_orderkey, op_no))
 SELECT l_orderkey, op_no, CAST(part AS INTEGER) AS part, diff_len, extra_len, adj FROM (SELECT * FROM c UNION ALL SELECT * FROM t)""")
def hazard_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.literalised(_sized_walk(spark, sf_dir), "l_orderkey", "op_no")


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'R' ELSE 'S' END AS kind, CAST(floor(value) AS BIGINT) AS length FROM events),
 p AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s),
 m AS (SELECT *, CASE WHEN kind = 'S' AND lag(kind) OVER w = 'S' AND lag(start) OVER w + lag(length) OVER w = start THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS token_no FROM m)
 SELECT user_id, CAST(token_no AS BIGINT) AS token_no, min(kind) AS kind, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, count(*) AS parts FROM g GROUP BY user_id, token_no""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    length = F.floor("value").cast("long")
    spans = I.events(spark, sf_dir).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "R").otherwise("S").alias("kind"), length.alias("length"))
    spans = spans.withColumn("start", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    spans = spans.withColumn("at", F.row_number().over(w))
    return walk.merged_spans(spans, "user_id", "at")


@query(f"WITH {I.PAIRS_SQL} SELECT pair_id, nt AS size, true AS whole FROM pairs")
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's target made anew of its source and the plan alone, held against the target."""
    made = align.apply_same_offset(align.same_offset_plan(_pairs(spark, sf_dir)))
    return made.join(_pairs(spark, sf_dir).select("pair_id", "t"), "pair_id").select("pair_id", F.octet_length("out").cast("long").alias("size"), (F.col("out") == F.col("t")).alias("whole"))


_RAW = I.imm_sql("f_up", "f_low")


@query(f"""WITH {I.FIELDS_SQL}, b AS (SELECT * FROM fields WHERE (f_up & 63488) = 61440 AND (f_low & 53248) = 53248), m AS (SELECT *, {_RAW} AS imm FROM b)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pc, CAST(imm AS BIGINT) AS imm, CAST(((pc + 4 + 2 * imm) % 4294967296 + 4294967296) % 4294967296 AS BIGINT) AS target, f_up AS up, f_low AS low FROM m""")
def bl_unpack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.field_rows(spark, sf_dir)
    up, low = F.col("f_up"), F.col("f_low")
    raw = bits.branch_imm24(up, low)
    return rows.where(bits.is_branch(up, low)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pc", bits.branch_signed(up, low).alias("imm"), bits.branch_target(F.col("pc"), up, low).alias("target"),
        bits.branch_pack_up(raw).alias("up"), bits.branch_pack_low(raw).alias("low"),
    )


@query("""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), s AS (SELECT doc_id, h, n, 2 * unnest(range(n // 2)) AS a FROM h),
 l AS (SELECT doc_id, n, a, (a // 4 + CAST('0x' || substr(h, 2 * a + 1, 2) AS BIGINT) + 1) * 4 AS t FROM s WHERE (CAST('0x' || substr(h, 2 * a + 3, 2) AS BIGINT) & 248) = 72)
 SELECT doc_id AS image_id, CAST(t AS BIGINT) AS target, CAST(min(t - a) AS BIGINT) AS back FROM l WHERE t + 4 <= n GROUP BY doc_id, t""")
def ldr_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.literal_targets(images.document_images(spark, sf_dir), "image_id")


_DELTA = f"({I.imm_sql('f_up', 'f_low')} - {I.imm_sql('t_up', 't_low')})"


@query(f"""WITH {I.FIELDS_SQL}, k AS (SELECT *, CASE WHEN (f_up & 63488) = 61440 AND (f_low & 53248) = 53248 THEN CASE WHEN pure AND (t_up & 63488) = 61440 AND (t_low & 53248) = 53248 THEN 'BL' ELSE 'SBL' END
  WHEN pure AND loaded THEN 'EX' ELSE 'NONE' END AS kind FROM fields)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, CAST(CASE kind WHEN 'BL' THEN {_DELTA} WHEN 'EX' THEN {_i32('(f_up + 65536 * f_low) - (t_up + 65536 * t_low)')} ELSE 0 END AS BIGINT) AS delta,
 CAST(CASE kind WHEN 'BL' THEN ((pc + 4 + 2 * {I.imm_sql('f_up', 'f_low')}) % 4294967296 + 4294967296) % 4294967296 WHEN 'EX' THEN f_up + 65536 * f_low ELSE 0 END AS BIGINT) AS key FROM k""")
def field_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.classified(I.field_rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", "delta", "key")


_AT = "coalesce({x}.v, 0)"


@query(f"""WITH {I.MAP_SQL}, q AS (SELECT o_orderkey, o_orderkey AS pc, o_custkey * 7 AS target FROM orders),
 a AS (SELECT q.*, coalesce(e.v, 0) AS s_pc FROM q ASOF LEFT JOIN entries e ON q.pc >= e.b), b AS (SELECT a.*, coalesce(e.v, 0) AS s_target FROM a ASOF LEFT JOIN entries e ON a.target >= e.b)
 SELECT o_orderkey, pc, target, s_pc, s_target, CAST((s_pc - s_target) // 2 AS BIGINT) + CAST(CASE WHEN s_pc < s_target AND (s_pc - s_target) % 2 <> 0 AND (s_pc - s_target) // 2 * 2 < (s_pc - s_target) THEN 1 ELSE 0 END AS BIGINT) AS branch, -s_pc AS word FROM b""")
def shift_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = I.map_entries(spark, sf_dir)
    rows = I.orders(spark, sf_dir).select("o_orderkey", F.col("o_orderkey").alias("pc"), (F.col("o_custkey") * 7).alias("target"))
    rows = rows.withColumn("s_pc", fields.shift_at(entries, F.col("pc"))).withColumn("s_target", fields.shift_at(entries, F.col("target")))
    return rows.withColumn("branch", bits.predicted_branch(F.col("s_pc"), F.col("s_target"))).withColumn("word", bits.predicted_word(F.col("s_pc")))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.field_rows(spark, sf_dir).select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("word_no"), F.col("f_low").alias("word"), (F.col("l_suppkey") % 3 - 1).alias("need"))
    return fields.candidate_pool(_sized_walk(spark, sf_dir), words, "l_orderkey")


_POOL = f"""{I.WALK_SQL}, {I.FIELDS_SQL}, s AS (SELECT *, CAST(sum(diff_len + extra_len) OVER (PARTITION BY l_orderkey) AS BIGINT) AS to_size FROM walk),
 z AS (SELECT *, greatest(0, to_size + CASE WHEN l_orderkey % 2 = 0 THEN 64 ELSE -64 END) AS from_size FROM s),
 words AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS word_no, f_low AS word, -(l_suppkey % 3 - 1) AS v FROM fields),
 mw AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM words WINDOW w AS (PARTITION BY l_orderkey ORDER BY word, word_no)),
 gw AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY word, word_no) AS run FROM mw),
 u AS (SELECT l_orderkey, fp AS b, tp - fp AS v, diff_len AS w, 0 AS part, op_no AS no FROM z WHERE diff_len > 0 AND fp >= 0
  UNION ALL SELECT l_orderkey, max(greatest(from_size, to_size)), 0, 2147483647, 1, 0 FROM z GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey, min(word), any_value(v), count(*), 2, run FROM gw GROUP BY l_orderkey, run),
 o AS (SELECT l_orderkey, b, v, w, row_number() OVER (PARTITION BY l_orderkey ORDER BY part, no) AS ord FROM u),
 tr AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, ord DESC) <= 160)"""


@query(f"""WITH {_POOL}, once AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY l_orderkey, b ORDER BY ord DESC) = 1),
 kept AS (SELECT l_orderkey, b, v FROM once QUALIFY lag(v) OVER (PARTITION BY l_orderkey ORDER BY b) IS DISTINCT FROM v),
 n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM kept) SELECT l_orderkey, CAST(b AS BIGINT) AS b, CAST(v AS BIGINT) AS v FROM n WHERE NOT (n = 1 AND v = 0)""")
def shift_map_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.finished(fields.trimmed(_pool(spark, sf_dir), "l_orderkey"), "l_orderkey")


@query(f"""WITH {I.MAP_SQL}, q AS (SELECT o_custkey % 16 AS part, o_orderkey AS pc, o_custkey * 7 AS target, (o_orderkey % 9) - 4 AS need FROM orders),
 a AS (SELECT q.*, coalesce(e.v, 0) AS s_pc FROM q ASOF LEFT JOIN entries e ON q.pc >= e.b), b AS (SELECT a.*, coalesce(e.v, 0) AS s_target FROM a ASOF LEFT JOIN entries e ON a.target >= e.b)
 SELECT part, count(*) AS fields, CAST(sum(CASE WHEN need <> CAST(trunc((s_pc - s_target) / 2.0) AS BIGINT) THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM b GROUP BY part""")
def shift_map_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = I.map_entries(spark, sf_dir)
    rows = I.orders(spark, sf_dir).select((F.col("o_custkey") % 16).alias("part"), F.col("o_orderkey").alias("pc"), (F.col("o_custkey") * 7).alias("target"), (F.col("o_orderkey") % 9 - 4).alias("need"))
    left = bits.residual(F.col("need"), bits.predicted_branch(fields.shift_at(entries, F.col("pc")), fields.shift_at(entries, F.col("target"))))
    return rows.groupBy("part").agg(F.count("*").alias("fields"), F.sum(F.when(left != 0, 1).otherwise(0)).alias("misses"))


@query()
def trigram_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_summary(images.document_images(spark, sf_dir), "image_id")


@query("""WITH c AS (SELECT l_orderkey, CAST(l_partkey % 2048 + 1 AS BIGINT) AS dist, CAST(l_quantity AS BIGINT) AS len, l_linenumber, l_suppkey FROM lineitem),
 p AS (SELECT *, max(len) OVER (PARTITION BY l_orderkey ORDER BY dist, len DESC, l_linenumber, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer FROM c WHERE len >= 3),
 q AS (SELECT l_orderkey, dist, len, CAST(16 * len - (length(bin(dist)) - 1) AS BIGINT) AS worth FROM p WHERE nearer IS NULL OR nearer < len)
 SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY worth DESC, dist) <= 128""")
def pareto_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.lineitem(spark, sf_dir).select("l_orderkey", (F.col("l_partkey") % 2048 + 1).cast("long").alias("dist"), F.col("l_quantity").cast("long").alias("len"), "l_linenumber", "l_suppkey").where("len >= 3")
    w = Window.partitionBy("l_orderkey").orderBy("dist", F.col("len").desc(), "l_linenumber", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("nearer", F.max("len").over(w)).where("nearer is null or nearer < len")
    kept = kept.select("l_orderkey", "dist", "len", bits.candidate_value(F.col("len"), F.col("dist")).cast("long").alias("worth"))
    best = Window.partitionBy("l_orderkey").orderBy(F.col("worth").desc(), "dist")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= match.CANDIDATES).drop("rank")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS len, l_partkey % 997 AS price,
 min(l_partkey % 997) OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cheapest FROM lineitem""")
def suffix_min_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("len"), (F.col("l_partkey") % 997).alias("price"))
    return coding.suffix_min(rows, "l_orderkey", "len", "price")


_CLASSES = "[" + ", ".join(map(str, bits.literal_classes())) + "]"


@query(f"""WITH h AS (SELECT lang, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), s AS (SELECT lang, h, unnest(range(n)) AS pos FROM h),
 v AS (SELECT lang, CAST('0x' || substr(h, 2 * pos + 1, 2) AS INTEGER) AS v, CASE WHEN pos = 0 THEN 0 ELSE CAST('0x' || substr(h, 2 * pos - 1, 2) AS INTEGER) END AS p FROM s)
 SELECT lang, CAST(({_CLASSES})[p + 1] AS INTEGER) AS class, count(*) AS bytes, CAST(sum(v) AS BIGINT) AS total FROM v GROUP BY ALL""")
def literal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = images.byte_values(F.col("content"))
    both = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(F.col("v"), 1, F.greatest(F.size("v") - 1, F.lit(0)))), F.col("v"), lambda p, x: F.struct(p.alias("p"), x.alias("x")))
    rows = _by_lang(spark, sf_dir).select("lang", v.alias("v")).where(F.size("v") > 0).select("lang", F.explode(both).alias("b"))
    counted = rows.groupBy("lang", F.col("b.p").alias("p")).agg(F.count("*").alias("n"), F.sum("b.x").alias("s"))
    return counted.groupBy("lang", bits.literal_class(F.col("p")).alias("class")).agg(F.sum("n").alias("bytes"), F.sum("s").alias("total"))


_POINTS = "[" + ", ".join(map(str, bits.LOG2_POINTS)) + "]"


@query(f"""WITH r AS (SELECT unnest(range(4096)) AS p), b AS (SELECT p, unnest([0, 1]) AS bit FROM r), c AS (SELECT p, bit, greatest(1, CASE WHEN bit = 1 THEN 4096 - p ELSE p END) AS q FROM b),
 e AS (SELECT *, length(bin(q)) - 1 AS e FROM c), f AS (SELECT *, CAST(q * (1 << CAST(16 - e AS INTEGER)) - 65536 AS BIGINT) AS f FROM e),
 l AS (SELECT *, ({_POINTS})[f // 2048 + 1] AS a, ({_POINTS})[f // 2048 + 2] AS z FROM f)
 SELECT CAST(p AS BIGINT) AS p, CAST(bit AS INTEGER) AS bit, CAST((12 - e) * 64 - ((a + (z - a) * (f % 2048) // 2048) * 64) // 65536 AS BIGINT) AS price FROM l""")
def bit_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(4096).select(F.col("id").alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
    return rows.select("p", "bit", bits.bit_price("p", F.col("bit")).alias("price"))


@query(f"""WITH {I.SYMBOLS_SQL}, l AS (SELECT user_id, list(CAST(bit AS BIGINT) ORDER BY ts, event_id) AS l FROM symbols GROUP BY user_id)
 SELECT user_id, CAST(len(l) AS BIGINT) AS n, CAST(list_reduce(list_prepend(CAST(2048 AS BIGINT), l), lambda p, b: CASE WHEN b = 1 THEN p - (p >> 4) ELSE p + ((4096 - p) >> 4) END) AS BIGINT) AS p FROM l""")
def adaptive_prob_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.adaptive_prob(I.user_symbols(spark, sf_dir), "user_id", ["ts", "event_id"], "bit")


@query(f"""WITH {I.SYMBOLS_SQL}, a AS (SELECT *, lag(symbol, 1, 0) OVER w AS last FROM symbols WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CASE WHEN last = symbol THEN 1 ELSE 0 END AS r FROM a),
 c AS (SELECT *, lag(r, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN last = 0 THEN 2 ELSE 0 END AS context FROM b) SELECT CAST(context AS BIGINT) AS context, r AS repeated, count(*) AS n FROM c GROUP BY ALL""")
def repeat_flag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = coding.repeat_flags(I.user_symbols(spark, sf_dir), "user_id", ["ts", "event_id"], "symbol")
    return marked.groupBy("context", "repeated").agg(F.count("*").alias("n"))


@query(f"""WITH {I.SYMBOLS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM symbols), b AS (SELECT *, lag(i) OVER (PARTITION BY user_id, symbol ORDER BY i) AS p FROM a)
, c AS (SELECT *, CASE WHEN symbol = 0 THEN coalesce(p, 0) ELSE p END AS q FROM b),
 r AS (SELECT event_id, user_id, event_type, CASE WHEN q IS NULL THEN -1 ELSE (SELECT count(DISTINCT x.symbol) FROM a x WHERE x.user_id = c.user_id AND x.i > c.q AND x.i < c.i) END AS rank FROM c)
 SELECT *, CASE WHEN rank >= 3 THEN -1 ELSE rank END AS rank_of_3 FROM r""")
def mtf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a recency list that starts with the most usual symbol, and in one of three places, which drives symbols out."""
    how = ("user_id", ["ts", "event_id"], "event_type", I.SYMBOLS)
    rows = coding.recency_rank(I.user_symbols(spark, sf_dir), *how, cap=3, seed=I.SYMBOLS[0]).withColumnRenamed("rank", "rank_of_3")
    return coding.recency_rank(rows, *how, seed=I.SYMBOLS[0]).select("event_id", "user_id", "event_type", "rank", "rank_of_3")


@query(f"""WITH {I.SYMBOLS_SQL}, a AS (SELECT *, 2 * lag(bit, 2, 0) OVER w + lag(bit, 1, 0) OVER w AS context FROM symbols WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT CAST(context AS BIGINT) AS context, bit, count(*) AS n FROM a GROUP BY ALL""")
def token_flag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.kind_contexts(I.user_symbols(spark, sf_dir), "user_id", ["ts", "event_id"], "bit").groupBy("context", "bit").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id, ts, event_id, (event_id * 7 % 1000) // 16 AS page FROM events), c AS (SELECT user_id, count(*) AS writes, count(DISTINCT page) AS erased, count(*) - count(DISTINCT page) AS amplified FROM w GROUP BY user_id),
 s AS (SELECT user_id, row_number() OVER o AS i, sign(page - lag(page) OVER o) AS s FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT user_id, arg_min(s, i) AS d FROM s WHERE s <> 0 GROUP BY user_id),
 v AS (SELECT s.user_id, count(*) AS n FROM s JOIN f ON s.user_id = f.user_id WHERE s.s = -f.d AND s.s <> 0 GROUP BY s.user_id)
 SELECT c.user_id, writes, erased, amplified, CAST(coalesce(f.d, 0) AS BIGINT) AS direction, coalesce(v.n, 0) AS inversions, CASE WHEN amplified > 0 THEN 'amplified' WHEN coalesce(v.n, 0) > 0 THEN 'inversions' ELSE 'ok' END AS gate
 FROM c LEFT JOIN f USING (user_id) LEFT JOIN v USING (user_id)""")
def erase_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = I.events(spark, sf_dir).select("user_id", "ts", "event_id", F.floor(F.col("event_id") * 7 % 1000 / 16).cast("long").alias("page"))
    met = pages.page_counters(writes, "user_id").join(pages.inversions(writes, "user_id", ["ts", "event_id"]), "user_id")
    none = F.lit(0)
    return pages.write_gate(met.withColumn("outside", none).withColumn("misaligned", none).withColumn("canary", none)).drop("outside", "misaligned", "canary")


@query("""WITH c AS (SELECT o_orderkey, s.ord, s.plan, CASE WHEN (o_custkey + s.ord) % 5 = 0 THEN NULL ELSE (o_orderkey * (s.ord + 3) + o_custkey) % 23 END AS size
  FROM orders, (VALUES (0, 'plain-11'), (1, 'merge-11'), (2, 'merge-6'), (3, 'merge-20')) s(ord, plan))
 SELECT o_orderkey, plan, size FROM c WHERE size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY size, ord) = 1""")
def plan_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("plan")) for i, p in enumerate(("plain-11", "merge-11", "merge-6", "merge-20"))]))
    rows = I.orders(spark, sf_dir).select("o_orderkey", "o_custkey", specs.alias("s"))
    size = F.when((F.col("o_custkey") + F.col("s.ord")) % 5 != 0, (F.col("o_orderkey") * (F.col("s.ord") + 3) + F.col("o_custkey")) % 23)
    return coding.plan_argmin(rows.select("o_orderkey", "s.ord", "s.plan", size.alias("size")), "o_orderkey")


@query()
def suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.suffix_digest(images.document_images(spark, sf_dir), "image_id")


_GRAPH = """edges(caller, callee, w) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey, length(n_name) FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', length(r_name) FROM region)"""


@query(f"""WITH RECURSIVE {_GRAPH}, paths(start, node, depth, cost) AS (SELECT DISTINCT caller, caller, 0, 0 FROM edges UNION ALL SELECT p.start, e.callee, p.depth + 1, p.cost + CAST(e.w AS INTEGER) FROM paths p JOIN edges e ON p.node = e.caller)
 SELECT start, CAST(max(depth) AS BIGINT) AS depth, CAST(max(cost) AS BIGINT) AS cost FROM paths WHERE depth > 0 GROUP BY start""")
def callgraph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph import longest_paths

    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("caller"), F.concat(F.lit("r"), "n_regionkey").alias("callee"), F.length("n_name").alias("w"))
    edges = edges.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("caller"), F.lit("root").alias("callee"), F.length("r_name").alias("w")))
    return longest_paths(edges)


@query(f"""WITH {I.PAIRS_SQL} SELECT CASE WHEN nt > nf THEN 'grow' WHEN nt < nf THEN 'shrink' ELSE 'same' END AS tag, count(*) AS pairs, CAST(sum(nf) AS BIGINT) AS from_bytes, CAST(sum(nt) AS BIGINT) AS to_bytes, max(nt) AS largest FROM pairs GROUP BY ALL""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = align.sizes(_pairs(spark, sf_dir))
    tag = F.when(F.col("to_size") > F.col("from_size"), "grow").when(F.col("to_size") < F.col("from_size"), "shrink").otherwise("same")
    return n.groupBy(tag.alias("tag")).agg(F.count("*").alias("pairs"), F.sum("from_size").alias("from_bytes"), F.sum("to_size").alias("to_bytes"), F.max("to_size").alias("largest"))


@query("""WITH w AS (SELECT user_id, CAST(event_id // 256 AS BIGINT) AS page, max(event_id // 256) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
 SELECT user_id, CASE WHEN page <= before - 2 THEN 'late' ELSE 'page' END AS kind, page, count(*) AS writes FROM w GROUP BY ALL""")
def stream_page_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed as page writes, out of order; each page comes out once, when the frontier has passed it, and late writes as such."""
    from ..streaming import pages as stream

    return stream.replay(spark, sf_dir)


@query(f"""WITH {_RUNS.replace(' QUALIFY d', '')}, per AS (SELECT pair_id, count(*) FILTER (WHERE fv <> tv) AS diff_bytes, max(run) AS n_runs FROM starts GROUP BY pair_id)
 SELECT pairs.pair_id, nf AS from_size, nt AS to_size, {_crc('fh')} AS from_crc, {_crc('th')} AS to_crc, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(diff_bytes, 0) AS BIGINT) AS diff_bytes,
 nt - least(nf, nt) AS extra_len FROM pairs LEFT JOIN per USING (pair_id)""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summary(_pairs(spark, sf_dir))


@query("""WITH d AS (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) SELECT o_orderkey AS page, coalesce(d.s, o_orderstatus) AS content FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""")
def page_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they read: the uncommitted one where there is one."""
    flash = I.orders(spark, sf_dir).select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("content"))
    dirty = I.lineitem(spark, sf_dir).where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_linestatus").alias("content"))
    return pages.overlay(flash, dirty, ["page"])


@query("""SELECT l_orderkey, CAST(coalesce(floor(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) / count(CASE WHEN l_returnflag = 'R' THEN 1 END)), 128) AS BIGINT) AS price FROM lineitem GROUP BY l_orderkey""")
def average_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed average prices, or the prior's."""
    flags = I.lineitem(spark, sf_dir).select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).alias("cost"))
    return coding.average_price(flags, "l_orderkey", "cost", F.lit(128))


@query("""WITH e AS (SELECT l_orderkey, b, CASE WHEN min(l_suppkey) % 50 = 0 THEN -2147483648 ELSE min(l_suppkey) - 40 END AS v FROM (SELECT l_orderkey, l_suppkey, l_partkey * 11 AS b FROM lineitem) GROUP BY l_orderkey, b),
 g AS (SELECT *, coalesce(b - lag(b) OVER (PARTITION BY l_orderkey ORDER BY b) - 1, b) AS gap, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM e)
 SELECT l_orderkey, bool_and(gap >= 0 AND gap <> 4294967295 AND z <> 4294967295) AS feasible FROM g GROUP BY l_orderkey""")
def map_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a map's gaps and values can be coded."""
    rows = I.lineitem(spark, sf_dir).groupBy("l_orderkey", (F.col("l_partkey") * 11).alias("b")).agg(F.min("l_suppkey").alias("s"))
    return fields.map_feasible(rows.select("l_orderkey", "b", F.when(F.col("s") % 50 == 0, -2147483648).otherwise(F.col("s") - 40).alias("v")), "l_orderkey")


@query(f"""WITH s AS (SELECT user_id, event_id, ts, event_id * 977 % 100000 AS pos, CAST(floor(value) AS BIGINT) + 4 AS len FROM events),
 x AS (SELECT *, coalesce(lag(pos + len) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS expected FROM s), d AS (SELECT *, {_i32('pos - expected')} AS delta FROM x)
 SELECT event_id, user_id, expected, CAST(delta AS BIGINT) AS delta, CAST(CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS BIGINT) AS coded, pos AS back FROM d""")
def out_match_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output positions as differences from where the match before ended."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = I.events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_id") * 977 % 100000).alias("pos"), (F.floor("value").cast("long") + 4).alias("len"))
    after = bits.out_match_next(F.col("pos"), F.col("len"), F.lit(True))
    rows = rows.withColumn("expected", F.coalesce(F.lag(after).over(w), F.lit(0)).cast("long")).withColumn("delta", bits.out_match_delta(F.col("pos"), F.col("expected")))
    return rows.select("event_id", "user_id", "expected", "delta", bits.zigzag("delta").alias("coded"), bits.out_match_position(F.col("expected"), F.col("delta")).alias("back"))


@query(f"""WITH {I.SYMBOLS_SQL}, p AS (SELECT *, lag(symbol, 1, 0) OVER w * 7 + symbol * 3 + 1 AS price FROM symbols WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, user_id, CAST(price AS BIGINT) AS price, CAST(sum(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS upto FROM p""")
def literal_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by the symbol before, and their prefix sums: a span costs the difference of two."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = I.user_symbols(spark, sf_dir).withColumn("price", (F.lag("symbol", 1, 0).over(w) * 7 + F.col("symbol") * 3 + 1).cast("long"))
    return rows.select("event_id", "user_id", "price", F.sum("price").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query(f"""WITH {I.OPS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM ops) SELECT l_orderkey, op_no, CASE WHEN l_orderkey % 2 = 0 THEN op_no - 1 ELSE n - op_no END AS step FROM n""")
def apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which each op is applied, in either direction."""
    rows = I.ops(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    return rows.select("l_orderkey", "op_no", walk.apply_order(F.col("op_no") - 1, F.col("n"), F.col("l_orderkey") % 2 == 0).alias("step"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey * 40000 AS base, CAST(round(o_totalprice) AS BIGINT) * 150 AS z FROM orders), d AS (SELECT *, CASE WHEN z % 2 = 1 THEN base - (z // 2 + 1) ELSE base + z // 2 END AS x FROM v)
 SELECT o_orderkey, base, z, CASE WHEN x >= 0 AND (z % 2 = 1 OR x <= 67108864) THEN x ELSE -1 END AS size FROM d""")
def absolute_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes coded as differences; -1 where out of bounds."""
    rows = I.orders(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") * 40000).alias("base"), (F.round("o_totalprice").cast("long") * 150).alias("z"))
    return rows.select("*", F.coalesce(bits.zigzag_absolute("base", "z"), F.lit(-1)).cast("long").alias("size"))


@query("""WITH r AS (SELECT unnest(range(1, 4096)) AS p), b AS (SELECT p, unnest([0, 1]) AS bit FROM r)
 SELECT p, CAST(bit AS INTEGER) AS bit, CAST(CASE WHEN bit = 1 THEN p - (p >> 4) ELSE p + ((4096 - p) >> 4) END AS INTEGER) AS wide, CAST(CASE WHEN p < 256 THEN CASE WHEN bit = 1 THEN p - (p >> 4) ELSE p + ((256 - p) >> 4) END ELSE 0 END AS INTEGER) AS narrow FROM b""")
def prob_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every adaptive probability after either bit, in 12 bits and in 8."""
    rows = spark.range(1, 4096).select(F.col("id").alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
    p = F.col("p").cast("int")
    return rows.select("p", "bit", bits.prob_step(p, F.col("bit")).alias("wide"), F.when(p < 256, bits.prob_step(p, F.col("bit"), whole=256)).otherwise(0).alias("narrow"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS num, l_partkey % 3 * 1000 AS den FROM lineitem WHERE l_quantity <= 1000),
 p AS (SELECT *, CASE WHEN den = 0 THEN 2048 ELSE greatest(1, least(4095, (8192 * num + den) // (2 * den))) END AS p12 FROM v)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, num, den, CAST(p12 AS BIGINT) AS p12, CAST(greatest(1, least(255, (p12 + 8) >> 4)) AS BIGINT) AS p8 FROM p""")
def ratio_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios as coder probabilities, in 12 bits and in 8."""
    rows = I.lineitem(spark, sf_dir).where("l_quantity <= 1000").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("num"), (F.col("l_partkey") % 3 * 1000).alias("den"))
    rows = rows.withColumn("p12", bits.ratio_prob("num", "den").cast("long"))
    return rows.withColumn("p8", bits.tree_prob(F.col("p12").cast("int")).cast("long"))


@query("""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), k AS (SELECT doc_id, substr(h, 2 * unnest(range(n - 2)) + 1, 6) AS k FROM h WHERE n > 2),
 v AS (SELECT doc_id, CAST('0x' || substr(k, 5, 2) || substr(k, 3, 2) || substr(k, 1, 2) AS BIGINT) AS v FROM k)
 SELECT doc_id AS image_id, count(*) AS places, count(DISTINCT v) AS keys, CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most FROM v GROUP BY doc_id""")
def trigram_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each image's byte trigrams: how many, how many distinct, the least and the greatest."""
    v = images.document_images(spark, sf_dir).select("image_id", images.byte_values(F.col("content")).alias("v")).where(F.size("v") > 2)
    n = F.size("v") - 2
    pairs = F.zip_with(F.slice("v", F.lit(1), n), F.slice("v", F.lit(2), n), lambda a, b: a + 256 * b)
    keys = F.zip_with(pairs, F.slice("v", F.lit(3), n), lambda p, c: p.cast("long") + 65536 * c.cast("long"))
    v = v.select("image_id", keys.alias("k"))
    return v.select("image_id", F.size("k").cast("long").alias("places"), F.size(F.array_distinct("k")).cast("long").alias("keys"), F.array_min("k").alias("least"), F.array_max("k").alias("most"))


@query()
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest patch of every pair, over all plans."""
    made = delta.encode_pairs(_pairs(spark, sf_dir))
    return made.select("pair_id", F.octet_length("blob").cast("long").alias("patch_size"), F.crc32("blob").alias("patch_crc"), "plan", "descending", "literalised")


@query(f"WITH {I.PAIRS_SQL} SELECT pair_id, nf AS from_size, nt AS to_size, 'NONE' AS status, true AS whole, 'ok' AS gate FROM pairs")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's patch made (by one plan), and applied again page by page: the target must come back, written safely."""
    made = delta.encode_pairs(_pairs(spark, sf_dir), quick=True, keep=("f", "t"))
    done = delta.apply_patches(made, keep=("f", "t"))
    gate = pages.write_gate(done.withColumn("outside", F.lit(0)).withColumn("misaligned", F.lit(0)))
    return gate.select("pair_id", F.octet_length("f").cast("long").alias("from_size"), F.octet_length("t").cast("long").alias("to_size"), "status", (F.col("out") == F.col("t")).alias("whole"), "gate")


@query(f"""WITH {I.PAIRS_SQL}, d AS (SELECT unnest(['none', 'cut', 'tail', 'revision', 'source']) AS damage)
 SELECT damage, CASE WHEN damage = 'none' THEN 'NONE' ELSE 'CORRUPT' END AS status, count(*) AS patches FROM pairs, d WHERE nf > 0 GROUP BY damage""")
def reject_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged patches and wrong sources are refused, each before the image is taken for done."""
    rows = delta.damaged(delta.encode_pairs(_pairs(spark, sf_dir), quick=True, keep=("f",)))
    done = delta.apply_patches(rows, keep=("damage",))
    return done.groupBy("damage", "status").agg(F.count("*").alias("patches"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_summary(spark, sf_dir)
