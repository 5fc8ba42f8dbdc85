import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from deltaloom.llm import bpe, packing, tokenfile
from deltaloom.llm.tokens import encoder, vocabulary

from .tables import clashing, documents, folder, frame


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def random_texts(n):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(128), 0x85, 0xA0, 0x130, 0x1680, 0x2028, 0x3000, 0x301, 0x3A3, 0xE9, 0x4E00, 0x1F600, 0x660, 0x2160, 0xB2]]
    for i in range(n):
        t = "".join(rng.choices(letters if i % 3 else "aAbneitrs ouhl'sdm\n", k=rng.randint(0, 14)))
        yield t[:3] + "<|endoftext|>" + t[3:] if i % 9 == 0 else t


def test_automaton_equals_library(word_library):
    coder = bpe.coder(vocabulary("word_bpe_49k.json"))
    for t in random_texts(6000):
        ids = word_library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids, repr(t)
        assert coder.decode(ids) == word_library.decode(ids, skip_special_tokens=False)


def test_automaton_equals_greedy_merges():
    rng = random.Random(5)
    for _ in range(60):
        names, merges, base = list("ab"), [], 2
        while len(merges) < 8:
            u, v = rng.randrange(len(names)), rng.randrange(len(names))
            if names[u] + names[v] not in names:
                names.append(names[u] + names[v])
                merges.append((u, v, len(names) - 1))
        automaton = bpe.MergeAutomaton(list(range(base)), merges, len(names))
        for _ in range(60):
            ids = [rng.randrange(base) for _ in range(rng.randint(1, 9))]
            for u, v, w in merges:
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [u, v]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert automaton.has_arc(0, ids[0])
            assert all(automaton.follows(a, b) for a, b in zip(ids, ids[1:]))


def test_pieces_equal_library(byte_library):
    e = encoder(vocabulary())
    for t in random_texts(6000):
        assert np.frombuffer(e.encode(t), "<i4").tolist() == byte_library.encode(t, add_special_tokens=False).ids, repr(t)


def test_op1(spark, tmp_path, word_library):
    rows = documents()
    want = []
    for i, t, *_ in rows:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op1_bpe(spark, folder(spark, tmp_path, rows)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [0, 120])
def test_op2(spark, tmp_path, byte_library, n):
    rows = documents(n=n) if n else []
    got = packing.op2_packing(spark, folder(spark, tmp_path, rows)).collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*byte_library.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        ids = want[r["doc_id"]][0]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.asarray(own, "<u4").tobytes())
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        assert sum(r["length"] for r in own) == sum(map(len, want[i]))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    if n:
        assert sorted(sequences) == list(range(len(sequences)))
        assert len(sequences) <= 1.03 * sum(len(x) for w in want.values() for x in w) / 2048 + 1


def test_histogram_is_packed_whole():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 20))}
        patterns = packing.pack_histogram(dict(histogram), 64)
        total = {}
        for count, pattern in patterns:
            assert sum(a * b for a, b in pattern) <= 64
            for length, times in pattern:
                total[length] = total.get(length, 0) + count * times
        assert total == histogram
        slots = packing.pattern_slots(patterns)
        for length, n in histogram.items():
            own = sorted((a, b) for x, a, b, *_ in slots if x == length)
            assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_cut_with_clashing_columns(spark):
    rows = documents()
    plain = packing.cut_documents(frame(spark, rows), vocabulary(), with_ids=True)
    more = packing.cut_documents(clashing(frame(spark, rows)), vocabulary(), with_ids=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, more.collect()))


@pytest.mark.parametrize("n", [0, 120])
def test_op9(spark, tmp_path, byte_library, n):
    rows = documents(n=n) if n else []
    got = [tuple(r) for r in tokenfile.op9_token_files(spark, folder(spark, tmp_path, rows)).collect()]
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*byte_library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got) == sorted(want)


def test_token_files_are_looked_up(spark, tmp_path):
    tokenfile.write_token_files(clashing(frame(spark, documents())), f"{tmp_path}/t", vocabulary(), files=4)
    found = tokenfile.read_token_files(spark, f"{tmp_path}/t", [3, 9])
    assert {r["doc_id"] for r in found.collect()} == {3, 9}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def rows_read(df):
    """Rows that the scan of a collected query gave, by its own metrics."""
    node, found = df._jdf.queryExecution().executedPlan(), []
    todo = [node]
    while todo:
        n = todo.pop()
        if "AdaptiveSparkPlan" in n.nodeName():
            n = n.executedPlan()
        if n.nodeName().startswith("Scan"):
            found.append(n.metrics().apply("numOutputRows").value())
        todo += [n.children().apply(i) for i in range(n.children().size())]
    return sum(found)


def test_lookups_skip_row_groups_by_index_and_bloom_filter(spark, tmp_path):
    """A lookup within the files' range of ids, of one that is there and of one that isn't; the footers tell the encoding and the filters."""
    from pyarrow import orc

    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    tokenfile.write_token_files(docs, f"{tmp_path}/t", vocabulary(), files=4)
    for ids, found in (([2000], 1), ([2001], 0), ([2000, 39_000], 2)):
        df = tokenfile.read_token_files(spark, f"{tmp_path}/t", ids)
        assert len(df.collect()) == found
        assert rows_read(df) <= found * tokenfile.INDEX_ROWS, ids
    parts = sorted((tmp_path / "t").glob("*.orc"))
    files = [orc.ORCFile(p) for p in parts]
    assert len(files) == 4 and sum(f.nrows for f in files) == 20_000
    assert all(f.compression == "ZSTD" and f.row_index_stride == tokenfile.INDEX_ROWS and f.nstripes > 0 for f in files)
    fs = spark._jvm.org.apache.hadoop.fs.Path(str(parts[0]))
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(fs, spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    assert "BLOOM_FILTER_UTF8" in {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
    assert {str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())} <= {"DIRECT", "DIRECT_V2"}
    assert "DIRECT_V2" in {str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())}


def test_stripes_of_one_file_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "STRIPE_BYTES", 256 << 10)
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> hash(i, id))) AS text")
    tokenfile.write_token_files(docs, f"{tmp_path}/t", vocabulary(), files=1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        rows = tokenfile.read_token_files(spark, f"{tmp_path}/t")
        from pyspark.sql import functions as F

        tasks = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 40_000


def test_very_long_texts(spark, tmp_path, byte_library, word_library):
    """A text of several MB passes every operator of ids."""
    rows = [(1, "some words and numbers 12 " * 120_000, "en", "s", 1), (2, "x" * 40_000, "en", "s", 1), (3, "short", "en", "s", 1)]
    where = folder(spark, tmp_path, rows)
    want = {i: len(byte_library.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in tokenfile.op9_token_files(spark, where).collect()} == want
    pieces = packing.op2_packing(spark, where).collect()
    assert {i: sum(r["length"] for r in pieces if r["doc_id"] == i) for i in want} == want
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.op1_bpe(spark, where).collect()}
    assert got == {i: len(word_library.encode(t, add_special_tokens=False).ids) for i, t, *_ in rows}
