import random
import re

import pytest

from deltaloom.llm import quality

from ..conftest import MIDDLE
from .tables import clashing, documents, folder, frame


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def small(rows):
    return [(i, t if t is None or len(t) < 9000 else t[:9000], *rest) for i, t, *rest in rows]


@pytest.mark.parametrize("n", [0, 60])
def test_op5(spark, tmp_path, n):
    rows = small(documents(n=n)) if n else []
    got = sorted(tuple(r) for r in quality.op5_quality(spark, folder(spark, tmp_path, rows)).collect())
    want = []
    for i, t, *_ in rows:
        m = brute(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want.append((i, *m, failed))
    assert [r[:-2] for r in got] == sorted(want)
    assert all(kept == (not failed and not by_host) and not (failed and by_host) for *_, failed, by_host, kept in got)


def judged(spark, rows, **more):
    return {r["doc_id"]: r["kept"] for r in quality.judge_documents(frame(spark, rows), **more).collect()}


def test_bad_host(spark):
    """A host's habit counts against a document that shares it; an accident doesn't; what passes all is kept."""
    clean = " ".join(f"word{i} other" for i in range(40))
    symbols = " ".join(f"word{i} $%" for i in range(40))
    bad = [(i, symbols if i < 90 else clean, "en", "bad", 0) for i in range(100)]
    good = [(1000 + i, clean if i else symbols, "en", f"good{i % 5}", 0) for i in range(500)]
    kept = judged(spark, bad + good)
    assert sorted(i for i, k in kept.items() if not k) == list(range(90))
    assert kept == judged(spark, bad + good) and all(judged(spark, good).values())


def test_hosts_with_failure_rates_of_a_few_per_cent(spark):
    """Planted hosts at the usual rates: failures go where they are usual, and stay on the host that hardly has any."""
    rng = random.Random(4)
    clean, symbols = " ".join(f"word{i} other" for i in range(40)), " ".join(f"word{i} $%" for i in range(40))
    rates = {"h0": 0.05, "h1": 0.07, "h2": 0.09, "h3": 0.08, "neat": 0.004}
    rows, i = [], 0
    for host, rate in rates.items():
        for k in range(500):
            rows.append((i, symbols if k < rate * 500 else clean, "en", host, 0))
            i += 1
    rng.shuffle(rows)
    kept = judged(spark, rows)
    gone = {(host, t == symbols) for i, t, _, host, _ in rows if not kept[i]}
    assert gone == {(h, True) for h in rates if h != "neat"}
    assert all(kept[i] for i, t, _, host, _ in rows if t == clean or host == "neat")
    one = judged(spark, [r for r in rows if r[3] == "h1"])
    assert sum(not k for k in one.values()) == 35


def test_the_given_tables_have_documents_that_hosts_decide(spark):
    """And of those that are labelled, most are of low quality."""
    judged = quality.op5_quality(spark, MIDDLE).where("by_host")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    marks = [r["quality"] for r in judged.join(labels, "doc_id").collect()]
    assert judged.count() > 30 and marks.count(0) > 10 * marks.count(1)


def test_shrunk_rates_equal_brute_force(spark):
    rng = random.Random(8)
    symbols, clean = " ".join(f"word{i} $%" for i in range(40)), " ".join(f"word{i} other" for i in range(40))
    rows = [(i, symbols if rng.random() < (i % 7) / 9 else clean, "en", f"h{i % 7}", 0) for i in range(700) for _ in range(1 + (i % 7 == 3))]
    rates = {r["d_host"]: r["p_symbols"] for r in quality.host_verdicts(quality.measure_documents(frame(spark, rows))).collect()}
    hosts = {h: [t == symbols for _, t, _, host, _ in rows if host == h] for h in rates}
    total, bad = len(rows), sum(map(sum, hosts.values()))
    mean = bad / total
    between = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in hosts.values())
    rho = (between / (mean * (1 - mean)) - 6) / (total - sum(len(x) ** 2 for x in hosts.values()) / total - 6)
    a, b = mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)
    for h, x in hosts.items():
        assert abs(rates[h] - (sum(x) + a) / (len(x) + a + b)) < 1e-9


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    clean = " ".join(f"word{i} other" for i in range(40))
    rows = [(i, clean if i % 9 else clean.replace("other", "$%"), "en", "bad" if i % 9 == 0 else f"h{i % 9}", 0) for i in range(900)]
    first = judged(spark, rows)
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert judged(spark, rows) == first and not all(first.values())


def test_kept_rows_have_the_same_columns(spark):
    df = clashing(frame(spark, documents()))
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns and kept.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    want = {r["doc_id"] for r in quality.judge_documents(df).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == want
