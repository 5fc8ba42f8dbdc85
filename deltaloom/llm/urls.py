"""URL filter by character language models, with DataFrame functions only.

Urls that a rule allows or blocks teach two Markov models of characters. A model's order
varies: a context of three characters is used where it was seen often enough, else a shorter
one, and each order is smoothed by the next shorter (Witten-Bell). A url's score is the
mean, over its characters, of the difference of log-likelihoods. The threshold lies midway
between the medians of allowed and blocked urls in a held-out fifth, which the models for
calibration haven't seen. Urls without a rule are judged by score and threshold.

Characters are mapped to 41 symbols, so the model has at most 41^4 rows; it is broadcast
after its size was checked, and joined by a shuffle beyond that.

Results for edge cases: a null url or one without :// has an empty host and path and no
rule; without urls of both kinds the verdict is to allow; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, table, written

#: (verdict, host and path) of the rules; the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 3
#: A context seen less often is left for a shorter one.
LEAST_SEEN = 3
#: Model rows that fit a broadcast (about 50 MB).
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(urls: DataFrame) -> DataFrame:
    """``urls`` (with url) with host and path."""
    url = F.coalesce("url", F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(url, _PARTS, 2))


def rule_of(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule of host and path, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def symbols() -> Column:
    """The url's symbols, with its start and end marked."""
    small = F.translate(F.coalesce("url", F.lit("")), _UPPER + "123456789", _LOWER + "000000000")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(small, r"[^a-z0./_?=&%:#-]", "~"), F.lit("$"))


def _grams(urls: DataFrame, *more: str) -> DataFrame:
    """A row for each symbol of s with the ORDER before it."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - ORDER))
    return urls.select("s", *more, at.alias("i")).select(F.substring(F.col("s"), F.col("i"), F.lit(ORDER + 1)).alias("gram"), *more)


def model_of(counts: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, allow, block): log-likelihood of the last symbol, allowed less blocked."""
    levels = [counts]
    for _ in range(ORDER):
        shorter = levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        levels.append(shorter)
    levels.reverse()
    kinds = ("allow", "block")
    totals = levels[0].agg(*[F.sum(k).alias(f"n_{k}") for k in kinds], F.count("*").alias("v"))
    p = levels[0].join(F.broadcast(totals), F.lit(True)).select("gram", *[((F.col(k) + 0.5) / (F.col(f"n_{k}") + 0.5 * F.col("v"))).alias(f"p_{k}") for k in kinds])
    for order, level in enumerate(levels[1:], 1):
        before = F.substring("gram", 1, order)
        seen = level.groupBy(before.alias("before")).agg(*[F.sum(k).alias(f"n_{k}") for k in kinds], *[F.sum((F.col(k) > 0).cast("long")).alias(f"t_{k}") for k in kinds])
        shorter = p.select(F.col("gram").alias("rest"), *[F.col(f"p_{k}").alias(f"q_{k}") for k in kinds])
        met = level.withColumn("before", before).withColumn("rest", F.expr("substring(gram, 2)")).join(seen, "before").join(shorter, "rest")
        mixed = lambda k: F.when(F.col(f"n_{k}") >= LEAST_SEEN, (F.col(k) + F.col(f"t_{k}") * F.col(f"q_{k}")) / (F.col(f"n_{k}") + F.col(f"t_{k}"))).otherwise(F.col(f"q_{k}"))
        p = met.select("gram", *[mixed(k).alias(f"p_{k}") for k in kinds])
    return p.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (each row once) with score, the mean ratio over symbols."""
    few = model.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = _grams(urls, *urls.columns[1:]) if urls.columns[0] == "s" else None
    met = met.join(F.broadcast(model) if few else model, "gram")
    return met.groupBy(*urls.columns[1:]).agg(F.round(F.avg("ratio"), 9).alias("score"))


def url_models(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model and the one for calibration, from urls (s, page_id, url, host, path, rule, label, copies).

    Every url's grams are counted, so each gram of the table has a row.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    grams = _grams(urls.withColumn("held", fold), "label", "held", "copies")
    count = lambda label, held: F.sum(F.when((F.col("label") == label) & (F.lit(True) if held else ~F.col("held")), F.col("copies")).otherwise(0))
    counts = written(grams.groupBy("gram").agg(*[count(k, h).alias(f"{k}_{int(h)}") for k in ("allow", "block") for h in (True, False)]), "grams")
    model = lambda h: written(model_of(counts.select("gram", F.col(f"allow_{h}").alias("allow"), F.col(f"block_{h}").alias("block"))), "model")
    return model(1), model(0)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row."""
    urls = pick(pages, page_id=id_col, url=url_col).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    urls = with_parts(urls).withColumn("rule", rule_of(rules))
    label = reduce(lambda found, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(found), rules, F.lit(None).cast("string"))
    urls = written(urls.select(symbols().alias("s"), "page_id", "url", "host", "path", "rule", label.alias("label"), "copies"), "urls")
    model, trial = url_models(urls)
    held = urls.where((F.pmod(F.xxhash64("url"), F.lit(5)) == 0) & F.col("label").isNotNull())
    middle = lambda k: F.percentile_approx(F.when(F.col("label") == k, F.col("score")), 0.5)
    row = _scored(held, trial).agg(middle("allow").alias("allow"), middle("block").alias("block")).first()
    threshold = (row["allow"] + row["block"]) / 2 if row["allow"] is not None and row["block"] is not None else float("-inf")
    judged = _scored(urls, model).withColumn("verdict", F.coalesce("label", F.when(F.col("score") < threshold, "block").otherwise("allow")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule or by the models."""
    return judge_urls(table(spark, sf_dir, "pages"))
