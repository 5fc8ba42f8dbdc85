from tokenizers import Tokenizer

from deltaloom.llm import counts
from deltaloom.llm.tokens import vocabulary

from .tables import clashing, documents, folder, frame


def totals(rollup):
    return sorted((str(r["source"]), str(r["lang"]), r["version"], r["documents"], r["tokens"], r["chars"]) for r in rollup.totals().collect())


def test_op6(spark, tmp_path):
    """Totals of the whole table and whole texts, for both tokenizers."""
    want = {}
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        library = Tokenizer.from_file(vocabulary(f"{version}.json"))
        for _, t, lang, source, _ in (rows := [*documents(), (7000, "long " * 700_000 + "\n", "en", "hot", 0)]):
            old = want.setdefault((source, lang, version), [0, 0, 0])
            for k, x in enumerate((1, len(library.encode(t or "", add_special_tokens=False).ids), len(t or ""))):
                old[k] += x
    got = {(r["source"], r["lang"], r["version"]): [r["documents"], r["tokens"], r["chars"]] for r in counts.op6_counts(spark, folder(spark, tmp_path, rows)).collect()}
    assert got == want
    empty = tmp_path / "empty"
    empty.mkdir()
    assert counts.op6_counts(spark, folder(spark, empty, [])).count() == 0


def event(spark, tokens, sign=1):
    return spark.createDataFrame([("s", "en", "v", sign, tokens, 1)], "source string, lang string, version string, sign long, tokens long, chars long")


def test_a_batch_that_is_committed_during_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup, other = counts.Rollup(spark, f"{tmp_path}/r"), counts.Rollup(spark, f"{tmp_path}/r")
    rollup.commit("a", event(spark, 5))
    publish = counts.Rollup._publish

    def slow(self, sums, name, names):
        if name.startswith("until-"):
            assert other.commit("b", event(spark, 6))
        return publish(self, sums, name, names)

    monkeypatch.setattr(counts.Rollup, "_publish", slow)
    assert rollup.compact()
    monkeypatch.undo()
    assert totals(rollup) == [("s", "en", "v", 2, 11, 2)] and rollup.committed() == {"a", "b"}
    assert rollup.compact() and totals(rollup) == [("s", "en", "v", 2, 11, 2)]


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path, monkeypatch):
    rollup, other = counts.Rollup(spark, f"{tmp_path}/r"), counts.Rollup(spark, f"{tmp_path}/r")
    named = counts.Rollup._named

    def late(self, folder, name):
        monkeypatch.undo()
        assert other.commit("a", event(spark, 6))
        return named(self, folder, name)

    monkeypatch.setattr(counts.Rollup, "_named", late)
    assert not rollup.commit("a", event(spark, 5))
    assert totals(rollup) == [("s", "en", "v", 1, 6, 1)]
    assert not counts.Rollup(spark, f"{tmp_path}/r")._named("other", "batch-a") and totals(rollup) == [("s", "en", "v", 1, 6, 1)]


def test_batches_commit_once(spark, tmp_path):
    c = counts.count_tokens(clashing(frame(spark, documents())), {"v": vocabulary()})
    rollup = counts.Rollup(spark, f"{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", counts.inserts(c, "v"))
    first = totals(rollup)
    assert not rollup.commit("a", counts.inserts(c, "v")) and totals(rollup) == first
    rollup.compact()
    assert totals(rollup) == first and not rollup.commit("a", counts.inserts(c, "v"))
    assert rollup.commit("b", counts.deletes(c, "v")) and totals(rollup) == []
    rollup.compact()
    assert totals(rollup) == [] and rollup.committed() == {"a", "b"}


def test_counters_agree_with_the_library_and_keep_lengths_only():
    texts = [None, "", " ", "a", "It's  don't've\n\nx\t y ", "caf\u00e9\u00a0na\u00efve \u00c0\u00c9", "e\u0301 \u65e5\u672c\u8a9e \u0130", "a<s>b </s> <", "\x1c x\x1f", "7 42 x" * 50, "long" * 3000, *[r[1] for r in documents()]]
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        path = vocabulary(f"{version}.json")
        library, count = Tokenizer.from_file(path), counts.token_counter(path)
        for _ in range(2):
            assert [count(t) for t in texts] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    plain = counts.coder(path)
    plain.words.clear()
    plain.chunks.clear()
    assert count("several newish words here") == 4 + len(plain.encode("newish")) - 1
    assert len(plain.words) <= 1 and len(plain.chunks) <= 1
