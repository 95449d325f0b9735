"""Queries with SQL agree with it on small tables; every query runs on its whole table."""
import duckdb
import pytest
from riskframe.llm import queries

TABLES = ("documents", "embeddings", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE VIEW answer AS {queries.ORACLES[name]}")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM answer").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_covers_the_table(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    if name == "op10_ann":
        want = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert got.select("query_id").distinct().count() == want
    elif name == "op9_chat_format":
        want = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
        assert got.count() == want + 1
    elif name == "op11_spelling_groups":
        assert got.count() == got.select("word").distinct().count() > 100
    else:
        want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()
        assert got.select("doc_id").distinct().count() == want
