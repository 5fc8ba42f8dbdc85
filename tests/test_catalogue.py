import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from deltaloom.plans import catalogue

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"delta_encode"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, db, name):
    got, want = catalogue.queries()[name](spark, SMALL).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 41 and {"pair_id", "n_runs", "from_crc"} <= set(got[0].asDict())


def test_checksums(spark, db):
    got = {(r["kind"], r["image_id"]): r["crc"] for r in catalogue.image_crc32(spark, SMALL).collect()}
    for kind, sql in (("document", "SELECT doc_id, text FROM documents"), ("page", "SELECT page_id, html FROM pages")):
        for i, t in db.sql(sql).fetchall():
            assert got[kind, i] == zlib.crc32((t or "").encode())


def test_partitions_do_not_matter(spark):
    names = ["pair_summary", "diff_runs", "op_walk", "mtf_rank", "shift_map_finish"]
    before = {n: sorted(map(str, catalogue.queries()[n](spark, SMALL).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {n: sorted(map(str, catalogue.queries()[n](spark, SMALL).collect())) for n in names} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
