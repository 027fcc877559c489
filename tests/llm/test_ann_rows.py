"""Operator 1 with repeated rows, and its recall on queries that nothing was calibrated on."""

from __future__ import annotations

import numpy as np

from covey.llm import op1_ann


def brute(rows: list, queries: list, k: int) -> list[tuple]:
    """Every row but one with the query's id and vector, which is its own."""
    out = []
    for own, v in queries:
        rest = list(rows)
        if (own, v) in rest:
            rest.remove((own, v))
        scored = sorted((-float(np.dot(v, w)), i) for i, w in rest)[:k]
        out += [(own, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_equal_rows_of_a_query_s_id_are_candidates(spark):
    v, w = [1.0, 2.0, 0.5], [0.9, 2.1, 0.4]
    for repeats in (1, 3, 40):
        rows = [(0, v)] * repeats + [(5, v), (7, w), (7, v), (9, w), (33, [0.1, 0.1, 0.2])]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        queries = table.filter("vec_id in (0, 7)")
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op1_ann.nearest(table, queries, 20).collect())
        assert got == brute(rows, [r for r in rows if r[0] in (0, 7)], 20)


def test_recall_on_queries_outside_the_calibration_sample(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(op1_ann, "CALIBRATION", 60)
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding}
    ids, matrix = np.array(list(rows)), np.array(list(rows.values()))
    queries = table.filter("vec_id % 4 = 1")
    from pyspark.sql import functions as F

    sample = {r.vec_id for r in queries.orderBy(F.xxhash64(F.col("vec_id").cast("long")), "vec_id").limit(60).collect()}
    found: dict = {}
    for r in op1_ann.nearest(table, queries).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in found:
        if q not in sample:
            score = matrix @ rows[q]
            score[ids == q] = -np.inf
            shares.append(len(found[q] & set(ids[np.lexsort([ids, -score])[:20]].tolist())) / 20)
    assert len(shares) > 400 and np.mean(shares) >= 0.9
