import random

import pytest
from pyspark.sql import functions as F

from deltaloom.codec import encode as enc
from deltaloom.codec.patch import branch_like
from deltaloom.codec.plan import made_safe
from deltaloom.operators import align, coding, fields, pages, pairs, walk
from deltaloom.plans import graph
from deltaloom.sources import images


def pair_rows(n=12):
    rng = random.Random(1)
    rows = [(100, b"", b""), (101, b"", b"abc"), (102, b"abc", b"")]
    for i in range(n):
        a = bytes(rng.randrange(4) for _ in range(rng.randrange(1, 60)))
        b = bytes(rng.randrange(4) for _ in range(rng.randrange(1, 60)))
        rows.append((i, a, b))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, bytearray(f), bytearray(t)) for i, f, t in rows], "pair_id long, f binary, t binary")


def test_runs_gaps_and_apply(spark):
    rows = pair_rows()
    df = frame(spark, rows)
    runs, gaps, back = {}, {}, {}
    for r in align.diff_runs(df).collect():
        runs.setdefault(r["pair_id"], []).append((r["begin"], r["length"]))
    for forward in (True, False):
        for r in align.literal_gaps(df, forward).orderBy("lit_no").collect():
            (gaps if forward else back).setdefault(r["pair_id"], []).append((r["pos"], r["gap"], r["d"]))
    values = {r["pair_id"]: r["d"] for r in align.diff_values(df).collect()}
    made = {r["pair_id"]: bytes(r["out"]) for r in align.apply_same_offset(align.same_offset_plan(df)).collect()}
    for i, f, t in rows:
        n = min(len(f), len(t))
        d = [(t[k] - f[k]) % 256 for k in range(n)]
        assert values[i] == d and made[i] == t
        at = [k for k in range(n) if d[k]]
        assert [p for b, k in runs.get(i, []) for p in range(b, b + k)] == at
        assert gaps.get(i, []) == [(k, k - (at[j - 1] if j else 0), d[k]) for j, k in enumerate(at)]
        down = at[::-1]
        assert back.get(i, []) == [(k, (down[j - 1] if j else n) - k, d[k]) for j, k in enumerate(down)]


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_pairs_whatever_the_ranges(spark, parts):
    rng = random.Random(parts)
    head = ["a" * 40, "b" * 40, "short"]
    docs = [(i, rng.choice(head) + str(rng.random())) for i in range(60)]
    want, last = set(), {}
    for i, t in docs:
        if t[:40] in last:
            want.add((i, last[t[:40]], t))
        last[t[:40]] = t
    got = pairs.near_pairs(spark.createDataFrame(docs, "doc_id long, text string"), parts).collect()
    assert {(r["pair_id"], bytes(r["f"]).decode(), bytes(r["t"]).decode()) for r in got} == want


@pytest.mark.parametrize("forward", [True, False])
def test_literalised_plans(spark, forward):
    rng = random.Random(3)
    for _ in range(3):
        ops = [(rng.choice([0, 50, 700, 1500]), rng.choice([0, 9, 300]), rng.randrange(-900, 900)) for _ in range(6)]
        size = sum(d + e for d, e, _ in ops)
        df = spark.createDataFrame([(1, i, d, e, a) for i, (d, e, a) in enumerate(ops)], "k long, op_no long, diff_len long, extra_len long, adj long")
        walked = walk.op_walk(df, "k", "op_no").withColumns({"from_size": F.lit(2000).cast("long"), "to_size": F.lit(size).cast("long"), "forward": F.lit(forward)})
        cut = walk.literalised(walked, "k", "op_no").withColumn("no", F.col("op_no") * 10000 + F.col("part"))
        done = walk.fold_seeks(cut, "k", "no").orderBy("kept_no").collect()
        want, start, _, _ = made_safe(ops, 2000, size, forward)
        assert [(r["diff_len"], r["extra_len"], r["adj"]) for r in done if r["kept_no"]] == want
        assert sum(r["fp_start"] for r in done) == start


def test_fold_of_bits_and_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.choice("abcd"), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "u long, i long, s string, b int")
    probs, lists, ranks = {}, {}, {}
    for u, i, s, b in rows:
        n, p = probs.get(u, (0, 2048))
        probs[u] = (n + 1, p - (p >> 4) if b else p + (4096 - p >> 4))
        known = lists.setdefault(u, [])
        ranks[i] = known.index(s) if s in known else -1
        if s in known:
            known.remove(s)
        known.insert(0, s)
    assert {r["u"]: (r["n"], r["p"]) for r in coding.adaptive_prob(df, "u", ["i"], "b").collect()} == probs
    assert {r["i"]: r["rank"] for r in coding.recency_rank(df, "u", ["i"], "s", list("abcd")).collect()} == ranks
    for cap in (1, 2, 3):
        lists, ranks = {}, {}
        for u, i, s, _ in rows:
            known = lists.setdefault(u, ["c"])
            ranks[i] = known.index(s) if s in known else -1
            known[:] = [s, *[k for k in known if k != s]][:cap]
        assert {r["i"]: r["rank"] for r in coding.recency_rank(df, "u", ["i"], "s", list("abcd"), cap=cap, seed="c").collect()} == ranks


def test_averages_and_feasible_maps(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", None)], "k string, c long")
    assert {r["k"]: r["price"] for r in coding.average_price(df, "k", "c", F.lit(64)).collect()} == {"a": 3, "b": 64}
    maps = spark.createDataFrame([(1, 5, 2), (1, 9, -3), (2, 0, -(1 << 31)), (3, 0xFFFFFFFF, 1)], "k long, b long, v long")
    assert {r["k"]: r["feasible"] for r in fields.map_feasible(maps, "k").collect()} == {1: True, 2: False, 3: False}


def test_map_pools_agree_with_the_codec(spark):
    rng = random.Random(7)
    ops = [(rng.randrange(0, 90), rng.randrange(0, 20), rng.randrange(-30, 60)) for _ in range(8)]
    words = [enc.Field(0, "EX", 0, rng.choice([4, 4, -4, 9]), rng.randrange(500)) for _ in range(20)]
    rows, tp, fp = [], 0, 0
    for i, (d, e, a) in enumerate(ops):
        rows.append((1, i, d, fp, tp, 900, 950))
        tp, fp = tp + d + e, fp + d + a
    walked = spark.createDataFrame(rows, "k long, op_no long, diff_len long, fp long, tp long, from_size long, to_size long")
    found = spark.createDataFrame([(1, i, w.key, w.need) for i, w in enumerate(words)], "k long, word_no long, word long, need long")
    for most in (160, 6):
        pool = fields.trimmed(fields.candidate_pool(walked, found, "k"), "k", most)
        old, enc.MAP_POOL = enc.MAP_POOL, most
        try:
            want = enc.map_pool(ops, 0, 950, words)
        finally:
            enc.MAP_POOL = old
        kept = [e for i, e in enumerate(want) if not i or want[i - 1][1] != e[1]]
        assert [(r["b"], r["v"]) for r in fields.finished(pool, "k").orderBy("b").collect()] == kept


def test_page_gate_and_overlay(spark):
    writes = spark.createDataFrame([(1, i, p) for i, p in enumerate([0, 1, 2, 1, 5])] + [(2, 0, 4)], "r long, i long, page long")
    counted = {r["r"]: (r["writes"], r["erased"], r["amplified"]) for r in pages.page_counters(writes, "r").collect()}
    assert counted == {1: (5, 4, 1), 2: (1, 1, 0)}
    assert {r["r"]: (r["direction"], r["inversions"]) for r in pages.inversions(writes, "r", ["i"]).collect()} == {1: (1, 1), 2: (0, 0)}
    flash = spark.createDataFrame([(0, "old"), (1, "old")], "page long, content string")
    dirty = spark.createDataFrame([(1, "new")], "page long, content string")
    assert {r["page"]: r["content"] for r in pages.overlay(flash, dirty, ["page"]).collect()} == {0: "old", 1: "new"}
    before, after = (spark.createDataFrame(x, "pos long, v int") for x in ([(0, 1), (1, 2)], [(0, 1), (1, 3)]))
    assert pages.canary_mismatches(before, after, ["pos"]).first()["mismatches"] == 1


def test_images(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)))
    (tmp_path / "b.bin").write_bytes(b"")
    read = images.read_images(spark, str(tmp_path))
    assert sorted((r["size"], r["status"]) for r in read.collect()) == [(0, "NONE"), (256, "NONE")]
    monkeypatch.setattr(images, "MAX_IMAGE", 255)
    assert sorted((r["size"], r["status"], r["content"] is None) for r in images.read_images(spark, str(tmp_path)).collect()) == [(0, "NONE", False), (256, "RESOURCE", True)]
    rows = images.exploded(read.select("image_id", "content")).orderBy("pos").collect()
    assert [r["v"] for r in rows] == list(range(256))
    r, want = 1, []
    for _ in range(9):
        r = (r * 1664525 + 1013904223) & 0xFFFFFFFF
        want.append(r >> 24)
    assert spark.range(1).select(images.poison(F.lit(9)).alias("p")).first()["p"] == want


def test_replacing_a_table(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.range(5).write.parquet(a)
    with pytest.raises(ValueError):
        images.replace_table(spark.read.parquet(a).where("id > 1"), f"{tmp_path}/./a", [a])
    assert spark.read.parquet(a).count() == 5
    for n in (3, 2):
        images.replace_table(spark.read.parquet(a).where(f"id < {n}"), b, [a])
        assert spark.read.parquet(b).count() == n


def test_literal_targets(spark):
    rng = random.Random(11)
    data = bytes(rng.choice([0x48, 0x49, 1, 2, 3, 7]) for _ in range(200))
    from deltaloom.codec.patch import Branches

    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, bytearray(b"H"))], "image_id long, content binary")
    got = {r["target"]: r["back"] for r in fields.literal_targets(df, "image_id").collect()}
    assert got == Branches(data).back and not branch_like(0)


def test_call_graphs(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 4), ("a", "c", 5)], "caller string, callee string, w long")
    assert {r["start"]: (r["depth"], r["cost"]) for r in graph.longest_paths(edges).collect()} == {"a": (2, 7), "b": (1, 4)}
    assert not graph.has_cycle(edges)
    assert graph.has_cycle(edges.unionByName(spark.createDataFrame([("c", "a", 1)], "caller string, callee string, w long")))
    edges = spark.createDataFrame([(f"f{i:03}", f"f{i + 1:03}", i) for i in range(70)] + [("x", "f000", 1), (None, "f001", 9), ("f001", None, 9)], "caller string, callee string, w long")
    got = {r["start"]: (r["depth"], r["cost"]) for r in graph.longest_paths(edges).collect()}
    assert got["f000"] == (70, sum(range(70))) and got["x"] == (71, 1 + sum(range(70))) and len(got) == 71
    below = spark.createDataFrame([("start", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "b", 1), ("d", "e", 1)], "caller string, callee string, w long")
    assert graph.has_cycle(below)
    with pytest.raises(ValueError):
        graph.longest_paths(below)
    assert graph.longest_paths(edges.where("w > 1000")).count() == 0
