"""Quality rules, for documents and for their hosts.

Each document is measured once. Rule failures are counted by host (partial sums first, so a
host with a third of all rows is no more than a few rows in a shuffle). Failure rates are
shrunk towards all hosts' by a beta prior that is fitted to the hosts by moments. Of each host
and rule that gives a verdict: a failure is the host's habit, or an accident. It is a habit where
the shrunk rate is above RARE and above HABIT times the rate of the whole corpus. Verdicts
are joined back: a document is dropped if it fails a rule of which failures are a habit of its host.
So junk goes where it is common, and the odd table or list of a host that hardly has any stays. A
document that passes every rule is kept whatever its host.

Results for edge cases: a null or empty text has no words and fails; a null host counts as
the empty one; repeated rows are judged alike; an empty table gives no rows; columns of other or
clashing names stay as they are; a text may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, spread, table, tune, written

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_START = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Hosts that fit a broadcast; with more, verdicts are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Failures of a rule on a host are accidents up to this shrunk rate,
RARE = 0.01
#: and up to this part of the corpus' own rate.
HABIT = 0.5


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a UTF-8 text."""
    words = text.split()
    n = len(words)
    word_chars = len(text.translate(None, _SPACE + _NOT_START))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x] if b"\n" in text else [text] * (n > 0)
    repeats = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        seen: set = set(windows)
        if len(seen) < len(windows):
            seen.clear()
            again = set()
            for w in windows:
                if w in seen:
                    again.add(w)
                else:
                    seen.add(w)
            end = 0
            for i, w in enumerate(windows):
                if w in again:
                    repeats += i + 5 - max(i, end)
                    end = i + 5
    return n, word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeats


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: bool = False) -> DataFrame:
    """COUNTS for each row, with its host, or with ``keep`` with all columns; no shuffle.

    The columns are named m_doc_id, m_host and m_<count>.
    """
    tune(docs.sparkSession)
    chosen = spread(pick(docs, m_doc_id=id_col, m_host=host_col, m_text=text_col))
    chosen = chosen.select("m_doc_id", F.coalesce(F.col("m_host").cast("string"), F.lit("")).alias("m_host"), F.coalesce(F.col("m_text"), F.lit("")).cast("binary").alias("m_text"))
    counts = ", ".join(f"m_{c} long" for c in COUNTS)
    if keep:
        return _measured_rows(docs, id_col, text_col, host_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measures(t) for t in b.column(2).to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["m_doc_id", "m_host", *(f"m_{c}" for c in COUNTS)])

    return chosen.mapInArrow(run, f"m_doc_id {chosen.schema['m_doc_id'].dataType.simpleString()}, m_host string, {counts}")


def _measured_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """All columns of ``docs`` (renamed c0, c1 ...) with the measures."""
    names = docs.columns
    index = lambda name: next((i for i, c in enumerate(names) if c == name), None) if name in names else next(i for i, c in enumerate(names) if c.lower() == name.lower())
    at, host = index(text_col), index(host_col)
    raw = spread(docs.toDF(*[f"c{i}" for i in range(len(names))]))
    raw = raw.withColumn("m_host", F.coalesce(F.col(f"c{host}").cast("string"), F.lit("")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields)
    width = len(raw.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measures((t or "").encode()) for t in b.column(at).to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *columns], [*b.schema.names[:width], *(f"m_{c}" for c in COUNTS)])

    return raw.mapInArrow(run, f"{fields}, " + ", ".join(f"m_{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("m_n_words") < 10) | (100 * F.col("m_n_repeat_words") > 20 * F.col("m_n_words"))


def rules() -> dict[str, Column]:
    """The rules whose failures are counted by host."""
    n = F.col("m_n_words")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("m_n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("m_n_symbols") > n,
        "lines": 100 * F.col("m_n_dup_lines") > 30 * F.col("m_n_lines"),
        "word_length": (F.col("m_word_chars") < 3 * n) | (F.col("m_word_chars") > 12 * n),
    }


def host_verdicts(measured: DataFrame, rare: float = RARE, habit: float = HABIT) -> DataFrame:
    """(d_host, v_<rule>, p_<rule>): of each host and rule whether failures are a habit, and the shrunk rate."""
    names = list(rules())
    hosts = measured.groupBy("m_host").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules().items()])
    sums = hosts.agg(
        F.count("*").alias("h"),
        F.sum("n").alias("docs"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        *[F.sum(f"f_{k}").alias(f"t_{k}") for k in names],
        *[F.sum(F.col(f"f_{k}").cast("double") * F.col(f"f_{k}") / F.col("n")).alias(f"q_{k}") for k in names],
    )
    joined = hosts.join(F.broadcast(sums), F.lit(True))  # one row
    out = []
    for k in names:
        mean = F.col(f"t_{k}") / F.col("docs")
        within = mean * (1 - mean)
        between = F.col(f"q_{k}") - F.col(f"t_{k}") * mean
        space = F.col("docs") - F.col("nn") / F.col("docs") - (F.col("h") - 1)
        rho = F.when((within > 0) & (space > 0), (F.try_divide(between, within) - (F.col("h") - 1)) / F.when(space > 0, space))
        rho = F.greatest(F.lit(1e-4), F.least(F.lit(0.99), F.coalesce(rho, F.lit(1e-4))))
        weight = 1 / rho - 1
        shrunk = (F.col(f"f_{k}") + mean * weight) / (F.col("n") + weight)
        out += [((shrunk > rare) & (shrunk > habit * mean)).alias(f"v_{k}"), shrunk.alias(f"p_{k}")]
    return joined.select(F.col("m_host").alias("d_host"), *out)


def with_verdicts(measured: DataFrame, rare: float = RARE, habit: float = HABIT) -> DataFrame:
    """``measured`` (a written table) with m_base_failed, m_by_host (dropped by the host's verdict alone) and m_kept."""
    spark = measured.sparkSession
    verdicts = [f"v_{k}" for k in rules()]
    hosts = host_verdicts(measured, rare, habit).select("d_host", *verdicts).where(" or ".join(verdicts))
    hosts = written(hosts, "hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    if not few:
        salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        hosts = hosts.withColumn("d_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        measured = measured.withColumn("m_salt", F.pmod(F.xxhash64("m_doc_id"), F.lit(salts)).cast("int"))
        met = measured.join(hosts, (F.col("m_host") == F.col("d_host")) & (F.col("m_salt") == F.col("d_salt")), "left").drop("m_salt", "d_salt")
    else:
        met = measured.join(F.broadcast(hosts), F.col("m_host") == F.col("d_host"), "left")
    fails = F.lit(False)
    for k, c in rules().items():
        fails = fails | (c & F.coalesce(F.col(f"v_{k}"), F.lit(False)))
    met = met.withColumn("m_base_failed", base_failed()).withColumn("m_by_host", ~base_failed() & fails)
    return met.withColumn("m_kept", ~(F.col("m_base_failed") | F.col("m_by_host"))).drop("d_host", *verdicts)


def judge_documents(docs: DataFrame, rare: float = RARE, habit: float = HABIT) -> DataFrame:
    """(doc_id, source host, counts, base_failed, by_host, kept) for each row."""
    judged = with_verdicts(written(measure_documents(docs), "measures"), rare, habit)
    found = [F.col(f"m_{c}").alias(c) for c in (*COUNTS, "base_failed", "by_host", "kept")]
    return judged.select(F.col("m_doc_id").alias("doc_id"), F.col("m_host").alias("host"), *found)


def keep_documents(docs: DataFrame, rare: float = RARE, habit: float = HABIT) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    judged = with_verdicts(written(measure_documents(docs, keep=True), "measures"), rare, habit)
    return judged.where("m_kept").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the rules and by its host."""
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[c for c in COUNTS if c != "n_lines"], "base_failed", "by_host", "kept")
