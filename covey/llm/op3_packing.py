"""Lexical retrieval packing with a sharded BM25 index.

Documents become token ids and an end id.  Whole windows are cut off the front
of long documents where they are tokenised; they fill a sequence each and never
move again.  What remains of each document, shorter than a window, is a piece.

1. Pieces are routed by content, so that neighbours meet.  A tree of k-means over
   sketches of BM25 weights, fitted on a bounded sample, gives each piece a leaf;
   leaves are numbered so that close ones follow each other.  Inside a leaf,
   pieces are in order of a signature, the first of their tokens in two random
   orders that favour rare ones, and copies stay together.
2. Ranges of this order are sorted in tasks and cut into shards of about
   ``shard_tokens`` tokens.  A hot group of copies fills shards of its own.
3. Each shard has an inverted index with BM25 weights (document frequencies of the
   whole corpus, a table no longer than the vocabulary).  The longest unused piece
   is the next seed; it asks with all its terms, and its unused neighbours fill the
   window in order of score.  One that doesn't fit is cut to close the gap, and its
   rest stays unused.  So all but the last sequence of a shard are full.

Work and memory grow with the corpus and not with its square.  The README has the
share of whole-corpus neighbours that meet in a shard.

Null and empty texts have the end id only.  Repeated rows and ids and null ids are
packed once per row.  A text of any length is tokenised whole.  An empty table
gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from . import _words
from .transducer import encoder

FULL, REST, FREQUENCY = 0, 1, 2
#: Tokens of a shard, about; and the most tasks that pack, beyond which a task packs several shards one after another.
SHARD_TOKENS, MOST_TASKS = 1 << 20, 20_000
#: The tree: pieces it is fitted on at most, coordinates of a sketch, children of a node, pieces of the sample in a leaf.
SAMPLE, SKETCH, FANOUT, LEAF_SAMPLE = 8_000, 128, 8, 30
K1, LENGTH_WEIGHT = 1.2, 0.75

_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "kind byte, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        width = "<u2" if library.size <= 1 << 16 else "<u4"
        frequency = np.zeros(library.size, np.int64)
        for batch in _words.slices(batches, "text"):
            data, offsets = _words.buffers(batch.column("text"))
            ids, bounds = library.encode(data, offsets)
            rows = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], end_id)
                frequency[np.unique(own)] += 1
                whole = len(own) // window * window
                for at in range(0, whole, window):
                    rows.append((FULL, doc_id, at, window, _crc(own[at : at + window]), len(own), None))
                if whole < len(own):
                    rows.append((REST, doc_id, whole, len(own) - whole, 0, len(own), own[whole:].astype(width).tobytes()))
            yield _batch(rows)
        seen = np.flatnonzero(frequency)
        yield _batch([(FREQUENCY, token, n, 0, 0, 0, None) for token, n in zip(seen.tolist(), frequency[seen].tolist(), strict=True)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int8(), *[pa.int64()] * 5, pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


class Index:
    """BM25 over pieces; postings are token-major."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(pieces)
        size = np.array([len(p) for p in pieces])
        owner = np.repeat(np.arange(self.n), size)
        key, tf = np.unique(np.concatenate(pieces).astype(np.int64) * self.n + owner, return_counts=True)
        token, self.piece = key // self.n, key % self.n
        self.weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * size[self.piece] / mean_length))
        self.bounds = np.searchsorted(token, np.arange(len(idf) + 1))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of every piece for all terms of a seed; the terms are added in order, so shards don't change a score."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in np.unique(ids).tolist()]
        return np.bincount(np.concatenate([self.piece[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), minlength=self.n)


def fill(pieces: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``piece, from, length, sequence, offset`` of every part placed; each token lies in one part.

    A sequence has the place of its seed among ``pieces``.
    """
    if not pieces:
        return
    index = Index(pieces, idf, mean_length)
    start = np.zeros(len(pieces), np.int64)
    left = np.array([len(p) for p in pieces])

    def place(piece: int, room: int, sequence: int) -> tuple[int, int, int, int, int]:
        take = min(int(left[piece]), room)
        part = (piece, int(start[piece]), take, sequence, window - room)
        start[piece] += take
        left[piece] -= take
        return part

    def follow(ids: np.ndarray, room: int, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
        if not room:
            return
        score = index.scores(ids)
        score[left == 0] = -1
        for piece in np.argsort(-score, kind="stable").tolist():
            if not room or score[piece] < 0:
                return
            part = place(piece, room, sequence)
            room -= part[2]
            yield part

    for seed in np.argsort(-left, kind="stable").tolist():
        if left[seed]:
            ids = pieces[seed][start[seed] :]
            part = place(seed, window, seed)
            yield part
            yield from follow(ids, window - part[2], seed)


class Sketcher:
    """Sketches of BM25 weights, and signatures, of many pieces at once."""

    def __init__(self, idf: np.ndarray):
        token = np.arange(len(idf), dtype=np.uint64)
        mixed = _words.mix(token)
        self.idf, self.slot = idf, (mixed % np.uint64(SKETCH)).astype(np.int64)
        self.sign = np.where(mixed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        #: Each token's places in random orders that favour rare tokens.
        self.places = []
        for salt in (1, 2):
            u = (_words.mix(token ^ np.uint64(salt << 32)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            late = -np.log(u + 1e-18) / np.maximum(idf, 1e-9) ** 2
            self.places.append(np.argsort(np.argsort(late, kind="stable"), kind="stable"))

    def __call__(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and two signatures, of pieces of one token or more."""
        owner = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        key, tf = np.unique(owner * len(self.idf) + np.concatenate(pieces).astype(np.int64), return_counts=True)
        owner, token = key // len(self.idf), key % len(self.idf)
        weight = self.idf[token] * self.sign[token] * tf * (K1 + 1) / (tf + K1)
        vectors = np.bincount(owner * SKETCH + self.slot[token], weight, len(pieces) * SKETCH).reshape(len(pieces), SKETCH)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        first = np.searchsorted(owner, np.arange(len(pieces)))
        return vectors.astype(np.float32), np.stack([np.minimum.reduceat(p[token], first) for p in self.places], 1)


class Router:
    """A tree of spherical k-means whose leaves are numbered so that close ones follow each other."""

    def __init__(self, vectors: np.ndarray):
        #: Of each inner node the centres of its children, and each child's node, or minus its leaf less one.
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaves = 0
        self._split(vectors)

    def _split(self, vectors: np.ndarray) -> int:
        parts = centres = None
        if len(vectors) > LEAF_SAMPLE:
            centres = vectors[np.random.default_rng(len(vectors)).choice(len(vectors), FANOUT, replace=False)]
            for _ in range(8):
                near = (vectors @ centres.T).argmax(1)
                centres = np.stack([vectors[near == k].sum(0) if (near == k).any() else centres[k] for k in range(FANOUT)])
                centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            chain, rest = [0], set(range(1, FANOUT))
            while rest:
                chain.append(max(sorted(rest), key=lambda k: centres[chain[-1]] @ centres[k]))
                rest.discard(chain[-1])
            centres = centres[chain]
            near = (vectors @ centres.T).argmax(1)
            parts = [vectors[near == k] for k in range(FANOUT)]
        if parts is None or max(len(x) for x in parts) == len(vectors):  # few pieces, or equal ones
            self.leaves += 1
            return -self.leaves
        at = len(self.centres)
        self.centres.append(centres)
        self.children.append(np.zeros(FANOUT, np.int64))
        for k, part in enumerate(parts):
            self.children[at][k] = self._split(part)
        return at

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.full(len(vectors), 0 if self.centres else -1)
        while len(inner := np.unique(at[at >= 0])):
            for node in inner.tolist():
                own = np.flatnonzero(at == node)
                at[own] = self.children[node][(vectors[own] @ self.centres[node].T).argmax(1)]
        return -at - 1


def _pieces_of(batch: pa.RecordBatch, width: str) -> list[np.ndarray]:
    return [np.frombuffer(x, width) for x in batch.column("ids").to_pylist()]


def _sketched(shared, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                vectors, _ = sketch(_pieces_of(batch.slice(at, 1000), width))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), SKETCH).cast(pa.list_(pa.float32()))], ["vector"])

    return run


def _routed(shared, router, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, leaf_of = Sketcher(shared.value), router.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors, signature = sketch(_pieces_of(part, width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf_of(vectors).astype(np.int32)), *(pa.array(signature[:, k].astype(np.int32)) for k in (0, 1))], [*part.schema.names, "leaf", "s1", "s2"])

    return run


def _packed(shared, mean_length: float, window: int, width: str, shard_tokens: int):
    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        own = [np.frombuffer(x, width) for x in table["ids"].to_pylist()]
        parts = [(p, a, n, s, o, _crc(own[p][a : a + n])) for p, a, n, s, o in fill(own, shared.value, mean_length, window)]
        piece, start, length, sequence, offset, crc = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        column = {c: table[c].combine_chunks() for c in ("piece", "doc_id", "start", "doc_tokens")}
        of = pa.array(piece)
        return pa.RecordBatch.from_arrays(
            [column["doc_id"].take(of), pa.array(column["start"].to_numpy()[piece] + start), pa.array(length), pa.array(crc), column["doc_tokens"].take(of), pa.array(column["piece"].to_numpy()[sequence]), pa.array(offset)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, have = [], 0
        for batch in batches:
            while batch.num_rows:
                fits = int(np.searchsorted(np.cumsum(batch.column("length").to_numpy()), shard_tokens - have, "right"))
                fits = max(fits, 0 if kept else 1)
                if fits:
                    kept.append(batch.slice(0, fits))
                    have += int(kept[-1].column("length").to_numpy().sum())
                if fits < batch.num_rows:
                    yield shard(kept)
                    kept, have = [], 0
                batch = batch.slice(fits)
        if kept:
            yield shard(kept)

    return run


def route(rests: DataFrame, idf: np.ndarray, width: str) -> DataFrame:
    """``rests(piece, ids, ...)`` with ``leaf, s1, s2``, by which pieces with much in common come close."""
    sc, n = rests.sparkSession.sparkContext, rests.count()
    shared = sc.broadcast(idf)
    # SAMPLE sketches of SKETCH floats come to the driver at most.
    some = rests.filter(F.pmod(F.xxhash64("piece"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).limit(SAMPLE)
    found = some.select("ids").mapInArrow(_sketched(shared, width), "vector array<float>").toArrow()["vector"].combine_chunks()
    router = sc.broadcast(Router(found.flatten().to_numpy().reshape(-1, SKETCH)))
    return rests.mapInArrow(_routed(shared, router, width), T.StructType([*rests.schema.fields, *T.StructType.fromDDL("leaf int, s1 int, s2 int").fields]))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of ``docs(doc_id, text)``.

    Sequences of whole windows have odd ids, those of pieces even ones.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(_tokenise(tokenizer, window, end_id), _PIECES).withColumn("piece", F.monotonically_increasing_id()))
    # At most one row for each entry of the vocabulary comes to the driver.
    frequency = pieces.filter(F.col("kind") == FREQUENCY).groupBy("doc_id").agg(F.sum("start").alias("n")).collect()
    rests = pieces.filter(F.col("kind") == REST)
    total, count = rests.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    size = encoder(tokenizer).size
    n = np.zeros(size)
    for token, seen in frequency:
        n[token] = seen
    idf = np.log1p((n.max(initial=0) - n + 0.5) / (n + 0.5))  # every document has the end id, so its count is theirs
    width = "<u2" if size <= 1 << 16 else "<u4"
    order = ["leaf", "s1", "s2", "piece"]
    routed = stored(route(rests.select("piece", "doc_id", "start", "length", "doc_tokens", "ids"), idf, width))
    tasks = min(max(1, -(-total // shard_tokens)), MOST_TASKS)
    sorted_ = routed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("piece", "doc_id", "start", "length", "doc_tokens", "ids")
    packed = sorted_.mapInArrow(_packed(docs.sparkSession.sparkContext.broadcast(idf), total / max(1, count), window, width, shard_tokens), _PACKED)
    packed = packed.withColumn("sequence_id", F.col("sequence_id") * 2)
    full = pieces.filter(F.col("kind") == FULL).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens of the 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
