"""Every query that SQL can state gives the rows of its SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__
from wardgraph.plans import facts, ingested, oracle, queries, updates  # noqa: F401  these register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    yield con
    con.close()


def plain(rows):
    """Rows as sorted texts: numbers to six digits, dates and times alike."""

    def one(x):
        if isinstance(x, datetime.datetime | datetime.date):
            return str(x)[:10]
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_sql(spark, sf, sql, name):
    found = queries.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    told = sql.execute(oracle.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(found.select(*[f"`{c}`" for c in columns]).collect()) == plain([[r[i] for i in order] for r in told.fetchall()])


def test_queries_without_sql(spark, sf):
    assert {*queries.QUERIES} - {*oracle.ORACLES} == {"exposure_exact", "residual_points", "name_suggestions"}
    found = {r["id"]: r for r in queries.QUERIES["exposure_exact"](spark, sf).collect()}
    walks = {r["id"]: r["hops"] for r in queries.QUERIES["exposure_hops"](spark, sf).collect()}
    assert {*found} <= {*walks} and all(found[i]["hops"] >= walks[i] for i in found)


def test_entry(spark):
    assert {"id", "hops"} == {*__spark_entry__.entry(spark).columns}
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
