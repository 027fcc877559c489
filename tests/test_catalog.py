"""Every registered query with SQL against DuckDB at the smallest scale."""

import pytest
from conftest import SF, same_rows

from covey.plans import catalog, views


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert same_rows(got, want)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["precision", "recall", "f1"]


def test_searches_see_the_whole_network(spark, duck):
    want = duck.execute("WITH b AS (SELECT DISTINCT l_orderkey AS kid, l_partkey AS node FROM lineitem) SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM b AS a JOIN b ON a.kid = b.kid AND a.node < b.node GROUP BY 1, 2").df()
    assert (want["weight"] == 1).any() and same_rows(views.copart(spark, SF).toPandas(), want)
    ends = {tuple(map(int, r.members.split())) for r in catalog.QUERIES["maximal_cliques"](spark, SF).collect()}
    held = {(x, y) for c in ends for x in c for y in c if x < y}
    single = want[want["weight"] == 1]
    assert held & set(zip(single["src"], single["dst"], strict=True))


def test_walks_cover_all_baskets(spark, duck):
    want = duck.execute("WITH k AS (SELECT count(DISTINCT l_partkey) AS size FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 3) SELECT size, CAST(ceil(count(*) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS n FROM k GROUP BY 1").df()
    assert same_rows(catalog._walk_plan(spark, SF).toPandas(), want)
    walks = catalog.QUERIES["random_walks"](spark, SF).toPandas()
    reached = walks.groupby("gid").apply(lambda e: len({*e["src"], *e["dst"]})).value_counts()
    assert reached.sum() == want["n"].sum() and reached.index.max() == want["size"].max()
