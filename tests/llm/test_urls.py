import random
import re

from deltaloom.llm import urls


def pages(n=900, seed=1):
    """Urls with rules, and without; the latter look like one kind or the other."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.5
        word = "".join(rng.choices("garden" if good else "xqzjkw", k=rng.randint(5, 9)))
        host = rng.choice([f"{word}.example.net/en/" if good else f"{word}.net/", f"{word}.org/fr/" if good else f"www.example.com/de/{word}", f"{word}.example.org/"])
        rows.append((i, f"https://{host}{word}{rng.randrange(99)}?q={word}", "<p>", good))
    return rows


def folder(spark, tmp_path, rows):
    spark.createDataFrame([(i, u, h) for i, u, h, *_ in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = [r for _, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


HARD = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.net/en/x", "http://example.net/EN/", "x://NET", "x://net/", "x://a.net?x=/", "x://anet/", "ftp://É.org/fr/a#b", "a://b://net/", "x://example.com/de", "http://org/fr/\nq", "x" * 4000]


def test_parts_and_rules(spark, tmp_path):
    rows = [(i, u, "") for i, u in enumerate(HARD)] + pages(50) + [(3, HARD[3], "")]
    got = urls.op7_urls(spark, folder(spark, tmp_path, rows)).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in got) == sorted((i, *brute(u)[:2], brute(u)[2] or "") for i, u, *_ in rows)
    verdicts = {r: v for v, r in urls.RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got} <= {"allow", "block"}


def test_the_model_tells_urls_apart(spark, tmp_path):
    rows = pages()
    got = urls.op7_urls(spark, folder(spark, tmp_path, rows)).collect()
    good = {i: g for i, _, _, g in rows}
    free = [(r["verdict"] == "allow") == good[r["page_id"]] for r in got if r["rule"] is None]
    assert len(free) > 100 and sum(free) / len(free) > 0.95


def test_shuffled_model_and_tables_of_one_kind(spark, tmp_path, monkeypatch):
    rows = pages(300)
    where = folder(spark, tmp_path, rows)
    first = sorted(map(tuple, urls.op7_urls(spark, where).collect()), key=str)
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, urls.op7_urls(spark, where).collect()), key=str) == first
    one = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.org/")], "page_id long, url string")
    assert sorted(r["verdict"] for r in urls.judge_urls(one).collect()) == ["allow", "block"]
    assert urls.judge_urls(one.where("page_id > 9")).count() == 0


def test_smoothing_equals_brute_force(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choices("ab$", k=4)): (rng.randrange(6), rng.randrange(6)) for _ in range(60)}
    df = spark.createDataFrame([(g, a, b) for g, (a, b) in counts.items()], "gram string, allow long, block long")
    got = {r["gram"]: r["ratio"] for r in urls.model_of(df).collect()}
    import math

    def p(gram, kind, order):
        sums = {}
        for g, n in counts.items():
            sums[g[3 - order :]] = sums.get(g[3 - order :], 0) + n[kind]
        if order == 0:
            return (sums[gram] + 0.5) / (sum(sums.values()) + 0.5 * len(sums))
        own = {g: n for g, n in sums.items() if g[:-1] == gram[:-1]}
        n, t = sum(own.values()), sum(x > 0 for x in own.values())
        shorter = p(gram[1:], kind, order - 1)
        return (sums[gram] + t * shorter) / (n + t) if n >= urls.LEAST_SEEN else shorter

    for g, ratio in got.items():
        assert abs(ratio - math.log(p(g, 0, 3) / p(g, 1, 3))) < 1e-9
    assert got.keys() == counts.keys()


def test_nulls_and_clashing_columns(spark):
    rows = [(None, "http://a.net/x"), (1, None), (None, None), (2, "http://b.org/fr/"), (2, "http://b.org/fr/"), (3, "http://c.com/" + "long/" * 400)]
    plain = spark.createDataFrame(rows, "page_id long, url string")
    more = plain
    for c in ("host", "path", "rule", "label", "s", "gram", "copies", "score", "verdict", "ratio"):
        more = more.selectExpr("*", f"'x' AS {c}")
    got = [sorted(map(tuple, urls.judge_urls(df).collect()), key=str) for df in (plain, more)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert sorted((r[0] or 0, r[3] or "") for r in got[0]) == sorted((i or 0, brute(u)[2] or "") for i, u in rows)


def test_no_python_worker_on_the_main_path(spark, tmp_path):
    plan = urls.op7_urls(spark, folder(spark, tmp_path, pages(60)))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas", "RDDScan"))
