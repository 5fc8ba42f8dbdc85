import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from deltaloom.llm import syncmers

from .tables import clashing, documents, folder, frame


def brute_units(text):
    """Character by character: a unit ends at white space, before and behind a character of a solid script, behind a break, and at its greatest length."""
    solid, breaks, units, open_unit = re.compile(f"[{syncmers._SOLID}]"), syncmers._BREAKS, [], ""
    for c in text:
        if c in "\t\n\x0b\f\r " or solid.match(c):
            units += [open_unit] * bool(open_unit) + [c] * bool(solid.match(c))
            open_unit = ""
        elif c in breaks:
            units.append(open_unit + c)
            open_unit = ""
        else:
            if len(open_unit) == syncmers.UNIT_CHARS - 1:
                units.append(open_unit)
                open_unit = ""
            open_unit += c
    return units + [open_unit] * bool(open_unit)


def hashes(spark, units):
    return [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").coalesce(1).orderBy("i").select(F.xxhash64("u")).collect()] if units else []


def brute_anchors(spark, text):
    h, k = hashes(spark, brute_units(text)), syncmers.K
    if len(h) < k:
        return [0] * bool(h)
    return [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]


def test_anchors_equal_the_definition(spark):
    texts = ["", "a b", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "日本語のテキスト。abc" * 5, "x" * 200, "one  two\nthree\tfour five six seven eight", "a=b;c/d,e}" * 9, " \n", "ghs kkk xxxxxxxxxxxk xxxxxxxxxxxxk"]
    got = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]).select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()
    for r in got:
        assert [x["at"] for x in r["a"]] == brute_anchors(spark, texts[r["doc_id"]])


def test_anchors_move_with_their_text(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(80))
    rows = [(0, text, "", "", 0), (1, "some words before " + text, "", "", 0)]
    f = syncmers.fingerprints(frame(spark, rows))
    own = {r["doc_id"]: {(x["at"], x["hash"]) for x in r["anchors"]} for r in f.collect()}
    before = len(brute_units("some words before "))
    assert {(a + before, h) for a, h in own[0]} <= own[1]
    met = syncmers.match_anchors(f.where("doc_id = 0"), f.where("doc_id = 1")).collect()
    assert met and {r["b_at"] - r["a_at"] for r in met} == {before}


@pytest.mark.parametrize("n", [0, 1, 120])
def test_op4(spark, tmp_path, n):
    rows = documents(n=n) if n > 1 else documents()[:n]
    got = sorted(tuple(r) for r in syncmers.op4_syncmers(spark, folder(spark, tmp_path, rows)).collect())
    order = sorted(((i, t or "") for i, t, *_ in rows))
    want, prints = [], {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert [r[:3] for r in got] == sorted(want)
    texts = dict(order)
    for r in got:
        assert prints.setdefault(texts[r[0]], r[3]) == r[3]
        assert 0 <= r[5] <= 1 and 0 <= r[6] <= 1
        if r[3] == r[4]:
            assert r[5] == 1
    long = [r for r in got if 400 < r[1] < 3000]
    if long:
        assert sum(r[5] for r in long) / len(long) > 0.4
        assert sorted(r[6] for r in long)[len(long) // 2] < 0.1


def test_next_rows_whatever_the_partitions(spark):
    rows = documents()
    order = sorted(((i, t or "") for i, t, *_ in rows))
    df = clashing(frame(spark, rows)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "kept")
    for parts in (1, 2, 7, 40):
        got = sorted((r["doc_id"], r["text"], r["next_text"], r["next_n"]) for r in syncmers.with_next(df, {"n": F.length("text")}, ["text", "n"], parts).collect())
        assert got == sorted((a, b, c, len(c)) for (a, b), (_, c) in zip(order, order[1:] + order[:1]))


def test_no_python_in_the_plan(spark, tmp_path):
    plan = syncmers.op4_syncmers(spark, folder(spark, tmp_path, documents()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lengths_make_no_difference(spark, tmp_path):
    """A near copy, an edited text and a passage of any length are compared alike; 150 to 201 characters had another unit once."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(90))
    for i, (a, b) in enumerate([(150, 170), (158, 162), (170, 150), (201, 160), (600, 620)]):
        rows = [(0, text[:a], "", "", 0), (1, text[:b], "", "", 0), (2, text[:201], "", "", 0), (3, "", "", "", 0)]
        where = tmp_path / str(i)
        where.mkdir()
        got = {r["doc_id"]: r for r in syncmers.op4_syncmers(spark, folder(spark, where, rows)).collect()}
        assert got[0]["near_next"] > 0.8 * min(a, b) / max(a, b)
        assert got[2]["near_edited"] > 0.5 and got[2]["near_next"] == 0  # the first 101 characters are left
    f = syncmers.fingerprints(frame(spark, [(0, text[100:200], "", "", 0), (1, text, "", "", 0)]))
    met = syncmers.match_anchors(f.where("doc_id = 0"), f.where("doc_id = 1")).collect()
    assert len(met) > 5 and len({r["b_at"] - r["a_at"] for r in met}) == 1


def test_unbroken_text_is_cut_by_content(spark):
    """One character more in a long run without white space changes the anchors around it only."""
    rng = random.Random(5)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789", "0123456789abcdef"):
        run = "".join(rng.choices(alphabet, k=3000))
        f = syncmers.fingerprints(frame(spark, [(0, run, "", "", 0), (1, run[:40] + "Z" + run[40:], "", "", 0)])).collect()
        a, b = ({x["hash"] for x in r["anchors"]} for r in f)
        assert len(a & b) > 0.95 * len(a | b)


def test_likeness_equals_brute_force(spark, tmp_path):
    """The whole result but the hash values: anchors by the definition, likeness by sets of k-mers."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeghiknorstuw", k=rng.randint(1, 9))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 8, 20, 60, 200]))) for _ in range(30)]
    texts += [texts[7], texts[7] + " more", "日本語のテキスト。" * 8, "\n\t ", texts[9].upper()]
    got = {r["doc_id"]: r for r in syncmers.op4_syncmers(spark, folder(spark, tmp_path, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()}

    def kmers(text):
        units = brute_units(text)
        if len(units) < syncmers.K:
            return {tuple(units)} if units else set()
        return {tuple(units[i : i + syncmers.K]) for i in brute_anchors(spark, text)}

    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    own = [kmers(t) for t in texts]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert abs(got[i]["near_next"] - alike(own[i], own[(i + 1) % len(texts)])) < 1e-12
        assert abs(got[i]["near_edited"] - alike(own[i], kmers(edited))) < 1e-12
        assert [int(x) >> 32 for x in got[i]["fingerprint"].split(",") if x] == brute_anchors(spark, t)
