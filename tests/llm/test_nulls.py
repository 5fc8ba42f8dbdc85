"""Nulls in every column, one row, and tables with clashing spellings."""

import pytest

import corpus_pipeline
from deltaloom.llm import registry

from .tables import folder, frame, words

NAMES = [n for n in registry.queries() if n not in ("op7_urls", "op10_chat")]


def rows():
    import random

    rng = random.Random(3)
    text = " ".join(words(rng, 60))
    near = text + " more"
    return [(None, text, None, None, None), (1, near, "en", "s", 5), (None, None, None, None, None), (2, text, None, "s", None), (3, None, "en", None, 0), (None, text, "de", "s", 1), (4, " ".join(words(rng, 40)), "en", "s", 1)]


@pytest.mark.parametrize("name", NAMES)
def test_nulls_in_any_column(spark, tmp_path, name):
    got = registry.queries()[name](spark, folder(spark, tmp_path, rows())).collect()
    if name == "op2_packing":
        assert sum(r["start"] == 0 for r in got) == 7
    elif name == "op6_counts":
        assert sum(r["documents"] for r in got) == 14 and {r["lang"] for r in got} == {None, "en", "de"}
    else:
        assert len(got) == 7
    if name == "op8_near":
        assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}


def test_pipeline_with_nulls(spark, tmp_path):
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, rows())).collect()
    assert {r["doc_id"] for r in got} == {1, 4}
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == next(r["doc_tokens"] for r in got if r["doc_id"] == 1)


@pytest.mark.parametrize("name", NAMES)
def test_one_row(spark, tmp_path, name):
    versions = 2 if name == "op6_counts" else 1
    assert len(registry.queries()[name](spark, folder(spark, tmp_path, [(7, "some words that are enough to make a text of more than ten words or so, and a few more " * 2, "en", "s", 1)])).collect()) == versions


def test_the_exact_spelling_wins(spark):
    from deltaloom.llm import bpe
    from deltaloom.llm.tokens import vocabulary

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = frame(spark, [(1, "right", "en", "s", 1)]).selectExpr("doc_id", "'wrong' AS TEXT", "text", "9 AS Doc_Id")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    path = vocabulary("word_bpe_49k.json")
    got = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert [(r["doc_id"], r["decoded"]) for r in got] == [(1, "right</w>")]
