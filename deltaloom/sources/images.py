"""Byte images: scans, exploded bytes, safe writes and the page emulator's fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import MAX_IMAGE, PAGE
from .spread import spread


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, content, size, status) of whole files; one larger than the format allows is refused: RESOURCE, without its content."""
    files = spark.read.format("binaryFile").load(path)
    read = files.where(F.col("length") <= MAX_IMAGE).select(F.col("path").alias("image_id"), "content", F.col("length").alias("size"), F.lit("NONE").alias("status"))
    # a second scan that doesn't ask for the content: the reader then doesn't load it
    refused = files.where(F.col("length") > MAX_IMAGE).select(F.col("path").alias("image_id"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"), F.lit("RESOURCE").alias("status"))
    read = read.unionByName(refused)
    # the reader leaves out empty files, which are images as well
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [s for top in fs.globStatus(p) or [] for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    empty = [(s.getPath().toString(), bytearray(), 0, "NONE") for s in listed if s.isFile() and s.getLen() == 0 and s.getPath().getName()[0] not in "._"]
    return read.unionByName(spark.createDataFrame(empty, "image_id string, content binary, size long, status string")) if empty else read


def text_images(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(kind, image_id, content) of a text column's UTF-8 bytes."""
    df = spread(df.select(key, text))
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("image_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(documents(spark, sf_dir), "doc_id", "text", "document")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_images(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "page")


def positions(n: Column) -> Column:
    """0..n-1 as an array, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def byte_values(content: Column) -> Column:
    """The bytes as an array of integers, by one pass over the image's Latin-1 text."""
    letters = F.split(F.decode(content, "ISO-8859-1"), "")
    return F.when(F.octet_length(content) > 0, F.transform(letters, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def exploded(images: DataFrame, content: str = "content") -> DataFrame:
    """A row (pos, v) for each byte, beside the other columns; a generator, without a shuffle."""
    rest = [c for c in images.columns if c != content]
    return images.select(*rest, F.posexplode(byte_values(F.col(content))).alias("pos", "v"))


def same_path(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths name one place, in their file system's full form."""

    def full(path: str) -> str:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        p = fs.makeQualified(p)
        return (fs.resolvePath(p) if fs.exists(p) else p).toString().rstrip("/")

    return full(a) == full(b)


def replace_table(df: DataFrame, path: str, inputs: list[str]) -> None:
    """Write ``df`` over ``path`` as a whole: a draft beside it is renamed when complete.

    Refused where ``path`` is one of the inputs: overwriting would delete what is still read.
    """
    spark = df.sparkSession
    if any(same_path(spark, path, i) for i in inputs):
        raise ValueError(f"output {path} is also an input")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    target, draft, old = jvm(path), jvm(f"{path}.draft"), jvm(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(draft, True)
    df.write.parquet(draft.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(draft, target):
        fs.rename(old, target)
        raise OSError(f"{path} couldn't be replaced")
    fs.delete(old, True)


def poison(n: Column, seed: int = 1) -> Column:
    """n bytes of a linear congruential sequence, that fill flash before a run."""
    step = lambda s: F.struct((s["r"] * 1664525 + 1013904223).bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"))
    start = F.struct(F.lit(seed).cast("long").alias("r"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        positions(n), start, lambda s, _: F.struct(step(s)["r"].alias("r"), F.concat(s["out"], F.array(F.shiftright(step(s)["r"], 24).cast("int"))).alias("out")), lambda s: s["out"]
    )


def page_count(size: Column) -> Column:
    return F.ceil(size / PAGE).cast("long")
