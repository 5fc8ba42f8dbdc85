"""Small tables with hard rows, and a sf_dir that holds them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"], k=rng.randint(1, 4))) for _ in range(n)]


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random documents, copies, near copies, null and empty, long ones, odd white space, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for i in range(n):
        w = words(rng, rng.choice([1, 2, 3, 5, 9, 12, 60, 200, 400]))
        texts.append(" ".join(w) + rng.choice(["", ".", "\n" + " ".join(w[:4]) + "\n" + " ".join(w[:4])]))
        if i % 4 == 0:
            base = texts[rng.randrange(len(texts))] or ""
            v = base.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9, 20])):
                v[rng.randrange(len(v))] = rng.choice(words(rng, 3))
            texts.append(" ".join(v))
        if i % 9 == 0:
            texts.append(rng.choice(texts))
    texts += [None, "", "   \n\t ", "a", "a b", "A B", "a\x0bb\x0cc\x1cd", "x" * 3000, "日本語のテキスト。" * 40, "one two three four five " * 700, "<|endoftext|> a <|endoftext|>", "é́ 😀 it's 'll", None]
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[5], rows[5]]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def folder(spark: SparkSession, tmp_path, rows: list[tuple]) -> str:
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def clashing(df: DataFrame) -> DataFrame:
    """With more columns, whose names the operators use too."""
    from pyspark.sql import functions as F

    for c in ("ids", "kept", "sequence_id", "component_id", "length", "start", "key", "m_kept", "host", "part", "node", "c0"):
        df = df.withColumn(c, F.lit("x"))
    return df
