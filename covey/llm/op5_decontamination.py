"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all runs of ``window`` words of the benchmark items, and whole
items that are shorter.  For each pattern length a shift table over blocks of
two words tells how far the end of any pattern can at least be; a block in no
pattern skips all positions that contain it.  Where the shift is nothing, the
block's hash names the bucket of patterns that end with it, and these are
compared with the text word by word.

The items of one pass are of bounded size and broadcast; a worker compiles them
once.  A larger benchmark is dealt into several passes whose hits are merged.  Null
and empty texts have no words, and null item ids take no part; repeated items and
ids count once.  Repeated document rows are judged one by one, and a text of any
length is read whole.  With an empty benchmark nothing is hit; an empty table gives
no rows.  Other columns of any name are carried along in ``row``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import _words

#: Bytes of benchmark text that are searched for in one pass and sent to every executor.
PASS_BYTES = 8 << 20


class Patterns:
    """All patterns of one length: runs of the benchmark's words from ``at`` on."""

    def __init__(self, words: _words.Words, raw: bytes, place: np.ndarray, at: np.ndarray, items: np.ndarray, length: int):
        self.raw, self.place, self.hash, self.at, self.items, self.length = raw, place, words.hash, at, items, length
        self.block = min(2, length)
        self.stride = length - self.block + 1
        blocks = _words.grams(words.hash, self.block)
        self.mask = np.uint64((1 << max(16, (4 * len(at)).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, min(self.stride, 255), np.uint8)
        for j in range(self.stride):
            np.minimum.at(self.shift, blocks[at + j] & self.mask, min(self.stride - 1 - j, 255))
        last = blocks[at + self.stride - 1]
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def text(self, pattern: int) -> bytes:
        """The words of a pattern, with a space after each."""
        return self.raw[self.place[self.at[pattern]] : self.place[self.at[pattern] + self.length]]

    def find(self, words: _words.Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of all occurrences."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = _words.grams(words.hash, self.block)
        if not len(blocks):
            return nothing
        # Any occurrence holds exactly one block of this grid.
        grid = np.arange(0, len(blocks), self.stride)
        shift = self.shift[blocks[grid] & self.mask]
        open_ = shift < self.stride
        ends = grid[open_, None] + np.arange(self.stride)
        ends = ends[(np.arange(self.stride) >= shift[open_, None]) & (ends < len(blocks))]
        ends = ends[self.shift[blocks[ends] & self.mask] == 0]
        low, high = np.searchsorted(self.suffix, blocks[ends], "left"), np.searchsorted(self.suffix, blocks[ends], "right")
        many = high - low
        start = np.repeat(ends + self.block - self.length, many)
        bucket = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if many.sum() else nothing[0]
        pattern = self.order[bucket]
        whole = _words.inside(words.first, self.length)
        fits = (start >= 0) & (start < len(whole))
        fits[fits] = whole[start[fits]]
        start, pattern = start[fits], pattern[fits]
        for j in range(self.length):
            same = words.hash[start + j] == self.hash[self.at[pattern] + j]
            start, pattern = start[same], pattern[same]
        sure = [b" ".join([*words.text(s, s + self.length), b""]) == self.text(p) for s, p in zip(start.tolist(), pattern.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return start[sure], pattern[sure]


def compile_patterns(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Patterns of ``(item, text)``, by length; item ``i`` is known by its place in the list."""
    words = _words.split(pa.array([t for _, t in items], pa.string()), _words.NOT_ALNUM, lower=True)
    data, place = _words.joined(words)
    raw = data.tobytes()
    count = np.diff(words.first)
    out = []
    for length in np.unique(np.minimum(count[count > 0], window)).tolist():
        own = np.flatnonzero(count >= window if length == window else count == length)
        many = count[own] - length + 1
        at = np.repeat(words.first[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        out.append(Patterns(words, raw, place, at, np.repeat(own, many), length))
    return out


#: What this worker has compiled last, by broadcast.
_compiled: dict[tuple[object, int], list[Patterns]] = {}


def _patterns_of(items, window: int) -> list[Patterns]:
    """The compiled patterns of broadcast items, once for each worker."""
    key = (items.value[0], window)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_patterns(items.value[1], window)
    return _compiled[key]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(items, window: int):
    """Adds one pass's hits to the spans and items that earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _patterns_of(items, window)
        names = [name for name, _ in items.value[1]]
        for batch in _words.slices(batches, "text"):
            words = _words.split(batch.column("text"), _words.NOT_ALNUM, lower=True)
            edge = np.zeros(len(words.start) + 1, np.int64)
            found: dict[int, set[str]] = defaultdict(set)
            for d, own in enumerate(batch.column("items").to_pylist()):
                if own:
                    found[d] |= set(own)
                    for span in batch.column("spans")[d].as_py():
                        edge[words.first[d] + span["start"]] += 1
                        edge[words.first[d] + span["end"]] -= 1
            for group in groups:
                start, pattern = group.find(words)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + group.length, -1)
                docs = np.searchsorted(words.first, start, "right") - 1
                for d, i in set(zip(docs.tolist(), group.items[pattern].tolist(), strict=True)):
                    found[d].add(names[i])
            hit = np.cumsum(edge[:-1]) > 0
            spans = [[] for _ in range(batch.num_rows)]
            for d in found:
                own = np.concatenate([[0], hit[words.first[d] : words.first[d + 1]].astype(np.int8), [0]])
                turns = np.flatnonzero(np.diff(own))
                spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
            new = {"n_words": pa.array(np.diff(words.first), pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array([sorted(found.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``row, text, n_words, spans, items`` of every row of ``docs(text, ...)`` against ``benchmark(item_id, text)``.

    ``row`` is a struct of the other columns of ``docs``.  ``spans`` are the hit words
    from ``start`` to before ``end``; ``items`` are the ids, as strings, of items
    with windows in the text, sorted.
    """
    known = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = -(-2 * size // pass_bytes) if size > pass_bytes else 1  # shares differ, so aim at half
    dealt = known.withColumn("turn", F.pmod(F.xxhash64("item"), F.lit(passes)))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    out = docs.select(
        (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("row"),
        F.col("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    for turn in range(passes):
        share = sorted(map(tuple, dealt.filter(F.col("turn") == turn).select("item", "text").collect()))
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, share))  # no more than pass_bytes, about
        out = (stored(out) if turn else out).mapInArrow(_scan(shared, window), out.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(lower_az, '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_FOLD} AS lower_az FROM documents)),
b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, {_FOLD} AS lower_az FROM benchmark)),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM wins),
hits AS (
  SELECT g.doc_id, g.i, g.m, wins.item_id
  FROM (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
    FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
  ) g JOIN wins ON g.m = wins.m AND g.win = wins.win
),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY doc_id),
per_item AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
