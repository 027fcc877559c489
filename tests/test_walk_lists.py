import pytest

from covey.operators import graph, training


@pytest.fixture
def network(spark):
    """A hub with 40 neighbours, which are a ring."""
    pairs = [(0, i, 1.0) for i in range(1, 41)] + [(i, i % 40 + 1, float(i)) for i in range(1, 41)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src long, dst long, weight double")
    return graph.adjacency(edges).cache(), spark.createDataFrame([(3, 40), (6, 20)], "size int, n long")


def test_a_step_meets_a_list_of_neighbours_and_not_each_of_them(network, monkeypatch):
    tables = []
    monkeypatch.setattr(training, "stored", lambda df: tables.append(df.cache()) or tables[-1])
    training.random_walks(*network, seed=3)
    assert tables[0].count() == 41  # one row a node


def test_walks_do_not_depend_on_the_length_of_lists(network, monkeypatch):
    runs = []
    for n in (512, 7):  # with 7, the hub has six lists
        monkeypatch.setattr(training, "LIST", n)
        runs.append(sorted(map(tuple, training.random_walks(*network, seed=3).collect())))
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) == 60
    known = {(r.node, r.nbr, r.weight) for r in network[0].collect()}
    assert all((a, b, w) in known for _, a, b, w in runs[0])
    assert any(a == 0 and b > 7 for _, a, b, _ in runs[0])
