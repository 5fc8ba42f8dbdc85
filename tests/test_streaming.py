import collections
import random

from pyspark.sql import functions as F

from deltaloom.plans import catalogue
from deltaloom.sources.bytestream import ByteStreamSource
from deltaloom.streaming import pages

from .conftest import SMALL


def stream(spark, tmp_path, batches, total=None):
    total = total or collections.Counter(run for rows in batches for run, *_ in rows)
    schema = "run long, seq long, page long, total long"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, s, p, total[r]) for r, s, p in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03}")
    writes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = pages.committed_pages(writes).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.read.schema(pages.OUTPUT).parquet(f"{tmp_path}/out").collect()]


def test_pages_come_out_once_over_batches(spark, tmp_path):
    rows = [(1, i, i // 3) for i in range(20)] + [(2, i, i // 2) for i in range(9)]
    batches = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    got = stream(spark, tmp_path, batches)
    want = {tuple(r) for r in pages.batch_pages(spark.createDataFrame(rows, "run long, seq long, page long")).collect()}
    assert {x for x in got if x[1] != "ready"} == want
    assert sorted(r for r, k, *_ in got if k == "ready") == [1, 2] and not [x for x in got if x[1] == "late"]


def test_late_writes_are_set_apart(spark, tmp_path):
    got = stream(spark, tmp_path, [[(1, 0, 0), (1, 1, 5)], [(1, 2, 1), (1, 3, 4)]])
    assert sorted(x for x in got if x[1] != "ready") == [(1, "late", 1, 1), (1, "page", 0, 1), (1, "page", 4, 1), (1, "page", 5, 1)]


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    """Shuffled over files, with writes that come twice, and late ones."""
    rng = random.Random(5)
    rows = [(run, i, max(0, i // 4 - rng.choice([0, 0, 0, 1, 3]))) for run in (1, 2, 3) for i in range(40)]
    want = {tuple(r) for r in pages.batch_pages(spark.createDataFrame(rows, "run long, seq long, page long")).collect()}
    assert any(k == "late" for _, k, *_ in want)
    mixed = rng.sample(rows, len(rows))
    again = [mixed[i : i + 17] + mixed[max(0, i - 9) : i] for i in range(0, len(mixed), 17)]
    got = stream(spark, tmp_path, again, {1: 40, 2: 40, 3: 40})
    sums = {}
    for run, kind, page, n in got:
        if kind != "ready":
            sums[run, kind, page] = sums.get((run, kind, page), 0) + n
    assert {(*k, n) for k, n in sums.items()} == want
    assert len([x for x in got if x[1] == "page"]) == len([x for x in want if x[1] == "page"])


def test_events_in_many_files(spark, tmp_path):
    """The query reads the same from one file and from eight, and not from a neighbour whose name begins alike."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    events.limit(9).write.parquet(f"{tmp_path}/events.parquet.old")
    one, many = (sorted(map(tuple, catalogue.queries()["stream_page_commit"](spark, d).collect())) for d in (SMALL, str(tmp_path)))
    assert one == many and sum(r[3] for r in one) == events.count()


def test_byte_stream_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(bytes(range(100)))
    (tmp_path / "in" / "b").write_bytes(b"xy")
    spark.dataSource.register(ByteStreamSource)
    read = spark.read.format("bytestream").option("path", f"{tmp_path}/in").option("piece", 30).load()
    assert read.groupBy("name").agg(F.sum(F.length("data")).alias("n")).orderBy("name").collect() == [("a", 100), ("b", 2)]
    s = spark.readStream.format("bytestream").option("path", f"{tmp_path}/in").option("piece", 30).load()
    q = s.writeStream.format("memory").queryName("pulled").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("pulled").orderBy("name", "start").collect()
    assert b"".join(bytes(r["data"]) for r in rows if r["name"] == "a") == bytes(range(100))
    assert max(len(r["data"]) for r in rows) == 30 and [r["last"] for r in rows if r["name"] == "a"] == [False] * 3 + [True]
