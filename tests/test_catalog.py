import os

import duckdb
import pytest

from graphmine import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, views, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(views.sql(catalog.oracle_sql()[name]).df())


def test_bounds_hold_the_domains(spark):
    q = catalog.queries()
    bound = {tuple(r) for r in q["domain_bounds"](spark, SF).collect()}
    from graphmine.operators import match

    exact = {tuple(r) for r in match.domains(match.embeddings(catalog.trade(spark, SF), catalog.PATH3)).collect()}
    assert exact <= bound


def test_three_edges_hold_the_fixed_patterns(spark):
    found = {r.code: r.support for r in catalog.queries()["mine_3"](spark, SF).collect()}
    least = min(found.values())
    for name, code in (("path3_support", catalog.PATH3), ("star3_support", catalog.STAR3)):
        support = catalog.queries()[name](spark, SF).first()["support"]
        assert found.get(catalog.text(code), 0) == (support if support >= least else 0)


def test_projection_keeps_embeddings_with_allowed_values(spark):
    got = catalog.queries()["semi_join_projection"](spark, SF)
    every = catalog.queries()["embedding_list"](spark, SF)
    assert got.subtract(every).isEmpty() and 0 < got.count() <= every.count()
