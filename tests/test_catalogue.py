"""Every query of the catalogue gives the rows of its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from cairn.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=key)
    sql = catalogue.ORACLE_SQL[name]
    assert cols == sorted(con.sql(sql).columns)
    want = sorted((tuple(norm(x) for x in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), key=key)
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert catalogue.f15_snippet(spark, DATA).count() == docs
    assert catalogue.r15_bucket_score(spark, DATA).count() == docs * len(catalogue.BUCKETS)
    queries = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert sum(r["queries"] for r in catalogue.a15_hit_at_3(spark, DATA).collect()) == queries


def test_pack_cuts_sources_before_the_shuffle(spark):
    plan = catalogue.r22_pack(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
