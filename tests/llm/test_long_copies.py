"""Blocks of long near copies: the exact check holds a bounded part of them and finds every link."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from covey.llm import op2_ngram_jaccard as op
from covey.operators.components import Forest


def block(texts):
    pack = zstandard.ZstdCompressor(3).compress
    n = len(texts)
    columns = {"component": pa.array([7] * n), "low": pa.array([0] * n, pa.int32()), "high": pa.array([0] * n, pa.int32()), "row": pa.array(range(n))}
    return pa.RecordBatch.from_pydict(columns | {"text": pa.array([pack(t.encode()) for t in texts], pa.binary())})


def changed(rng, base, share):
    words = np.where(rng.random(len(base)) < share, rng.integers(0, 10**6, len(base)), base)
    return " ".join(f"w{w}" for w in words.tolist())


def found(texts):
    edges = pa.Table.from_batches(list(op._verified(5, (80, 100))(iter([block(texts)]))))
    return dict(zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True))


def test_a_block_of_long_copies_is_checked_in_little_memory():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 10**6, 4000)
    texts = [changed(rng, base, 0.01) for _ in range(250)]
    rows = block(texts)
    tracemalloc.start()
    edges = list(op._verified(5, (80, 100))(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(e.num_rows for e in edges) == 249
    assert peak < 40 << 20


@pytest.mark.parametrize("at_once", [1 << 20, 3000])
def test_all_links_are_found_in_parts(monkeypatch, at_once):
    monkeypatch.setattr(op, "AT_ONCE", at_once)
    monkeypatch.setattr(op, "SPAN", 500)
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):  # chains, in which only neighbours link, and texts alone
        words = rng.integers(0, 10**6, 300)
        for _ in range(int(rng.integers(1, 7))):
            texts.append(" ".join(f"w{w}" for w in words.tolist()))
            words = np.where((np.arange(300) >= (at := int(rng.integers(0, 270)))) & (np.arange(300) < at + 26), rng.integers(0, 10**6, 300), words)
    texts = [texts[i] for i in rng.permutation(len(texts)).tolist()]
    sets, forest = op.shingles(pa.array(texts), 5), Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                forest.join(i, j)
    assert found(texts) == dict(forest.stars()) != {}
