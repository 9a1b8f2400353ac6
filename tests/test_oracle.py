"""Every registered query agrees with its DuckDB twin (sf0.001 driver tables)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    from convolens.plans import queries as Q

    assert set(Q.ORACLE) == set(Q.QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert cols == sorted(ocols)
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "conversation_digest" in df.columns


def test_inputs_are_whole(spark):
    """No driver row or text is dropped or replaced on the way in."""
    from convolens.sources import adapters as A

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    m = A.message_rows(spark, SF)
    own = m.where("src_ord % 2 = 0")
    assert own.count() == conv.count() < m.count()
    assert own.select("message").exceptAll(conv.select("text")).count() == 0
    assert A.raw_message_metrics(spark, SF).count() == m.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = E.queries()["phone_variants"](spark, SF).where("source = 'document'").select("id").distinct()
    assert seen.count() == docs.count()
