"""Runs of repeated words, found on tiles whose size follows the period.

A run is a stretch of words with smallest period ``q`` that is ``max(6, 4 q)``
words long or more and that no neighbouring word extends.  Words ``q`` apart are
equal over ``length - q`` places in a row, a *stretch*, so a run is a stretch of
``3 q`` places or more.

Periods are handled by octaves ``[P, 2P)``.  Words are cut into tiles that
overlap by more than ``8 P`` words, and each tile is solved by itself: a stretch
holds one of the boundaries that lie ``P`` words apart, and the values of the
Z-function there (how far the words from the boundary, and those before it, agree
with the words ``q`` further on) give its ends inside the tile.  A period whose root
is a power of a shorter word is left out; all fragments of a run agree on that,
as they overlap by more than two periods.  Fragments are then dealt by document and
period and stitched to whole runs.

A text of up to ``LONG_CHARS`` characters fits one tile of every octave: it is
solved in the task that read it, and its fragments are whole.  Longer texts have
their tiles dealt over the cluster.

Words are compared by 64-bit hashes, and Z-values come from running hashes by
halving; every fragment is compared word by word afterwards.  A null or empty
text, or one of white space, has no words, no runs and an empty rest.  Repeated
rows, repeated and null ids keep a row each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import _words

#: Words in the tiles of small periods; a tile of octave P has 32 P words at least.
TILE_WORDS = 1 << 15
#: Texts up to this many characters have at most ``TILE_WORDS`` words.
LONG_CHARS = 2 * TILE_WORDS
#: An odd number for running hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_factors(n: int) -> np.ndarray:
    """The smallest prime factor of every number below ``n``."""
    out = np.arange(n)
    for r in range(2, int(n**0.5) + 1):
        if out[r] == r:
            multiples = out[r * r :: r]
            multiples[multiples == np.arange(r * r, n, r)] = r
    return out


class Segments:
    """Words of several tiles in one array, each tile with a symbol after it that occurs nowhere else."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        count = len(first) - 1
        self.low = first[:-1] + np.arange(count)
        self.high = first[1:] + np.arange(count)
        self.code = np.empty(len(hashes) + count, np.uint64)
        inside = np.ones(len(self.code), bool)
        inside[self.high] = False
        self.code[inside] = hashes
        self.code[self.high] = _words.mix(np.arange(1, count + 1, dtype=np.uint64) * _BASE)
        self.power = np.cumprod(np.full(len(self.code) + 1, _BASE))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.code * self.power[:-1])])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``a`` and from ``b``, which is not before it, have the same hash."""
        return (self.sums[a + size] - self.sums[a]) * self.power[b - a - 1] == self.sums[b + size] - self.sums[b]

    def z_values(self, at: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before and from the boundary ``at`` agree with those ``q`` further on, inside ``low`` to ``high``."""
        back, ahead = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        most_back, most_ahead = at - low, high - at - q
        while (back < most_back).any():
            half = (back + most_back + 1) // 2
            fits = self.same(at - half, at - half + q, half)
            back, most_back = np.where(fits, half, back), np.where(fits, most_back, half - 1)
        while (ahead < most_ahead).any():
            half = (ahead + most_ahead + 1) // 2
            fits = self.same(at, at + q, half)
            ahead, most_ahead = np.where(fits, half, ahead), np.where(fits, most_ahead, half - 1)
        return back, ahead

    def fragments(self, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``segment, start, end, q`` of all long stretches with primitive periods in the octave, places within the segment."""
        none = (np.zeros(0, np.int64),) * 4
        size = self.high - self.low
        large = np.flatnonzero(size >= max(6, 4 * octave))
        if not len(large):
            return none
        steps = (size[large] - 1) // octave + 1
        segment = np.repeat(large, steps)
        at = self.low[segment] + octave * (np.arange(len(segment)) - np.repeat(np.cumsum(steps) - steps, steps))
        width = 4 if octave < 4 else 8  # a stretch has that many words from its first boundary on
        gram = _words.grams(self.code, width)
        fits = at + width <= len(self.code)
        segment, at = segment[fits], at[fits]
        periods = np.arange(octave, 2 * octave)
        found = []
        block = max(1, (1 << 21) // octave)
        for i in range(0, len(at), block):
            there = at[i : i + block, None] + periods[None, :]
            hit = gram[np.minimum(there, len(gram) - 1)] == gram[at[i : i + block]][:, None]
            hit &= there < len(gram)
            k, j = np.nonzero(hit)
            found.append((segment[i + k], at[i + k], periods[j]))
        segment, at, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none[:3]
        fits = at + q <= self.high[segment]
        segment, at, q = segment[fits], at[fits], q[fits]
        root = np.ones(len(q), bool)
        factors, left = least_factors(2 * octave), q.copy()
        while (left > 1).any():
            r = np.where(left > 1, factors[left], 1)
            d = q // np.maximum(r, 1)
            shorter = (left > 1) & (d < q)
            root &= ~(shorter & self.same(at, at + np.maximum(d, 1), np.where(shorter, q - d, 0)))
            while (more := (r > 1) & (left % np.maximum(r, 2) == 0)).any():
                left = np.where(more, left // np.maximum(r, 1), left)
        segment, at, q = segment[root], at[root], q[root]
        back, ahead = self.z_values(at, q, self.low[segment], self.high[segment])
        start, end = at - back, at + ahead
        long = end - start >= np.maximum(3 * q, 6 - q)
        rows = np.unique(np.stack([segment[long], start[long], end[long], q[long]]), axis=1)
        exact = [row for s, a, b, p in rows.T.tolist() for row in self._checked(s, a, b, p)]
        if not exact:
            return none
        segment, start, end, q = np.unique(np.array(exact, np.int64), axis=0).T
        return segment, start - self.low[segment], end - self.low[segment], q

    def _checked(self, segment: int, start: int, end: int, q: int) -> list[tuple[int, int, int, int]]:
        """The stretch itself, if its words agree and its neighbours don't; else all stretches of the period, word by word."""
        low, high, code = self.low[segment], self.high[segment], self.code
        if np.array_equal(code[start:end], code[start + q : end + q]) and (start == low or code[start - 1] != code[start - 1 + q]) and (end + q == high or code[end] != code[end + q]):
            return [(segment, start, end, q)]
        equal = np.concatenate([[False], code[low : high - q] == code[low + q : high], [False]])
        starts, ends = np.flatnonzero(equal[1:] & ~equal[:-1]) + low, np.flatnonzero(~equal[1:] & equal[:-1]) + low
        return [(segment, a, b, q) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= max(3 * q, 6 - q)]


def octaves(n: int) -> list[int]:
    """The octaves of all periods that a run among ``n`` words can have."""
    out, octave = [], 1
    while max(6, 4 * octave) <= n:
        out.append(octave)
        octave *= 2
    return out


def tile_plan(n: int, tile: int = TILE_WORDS) -> list[tuple[int, int, int, int]]:
    """``first octave, last octave, start, end`` of all tiles of ``n`` words: octaves with one tiling share their tiles."""
    groups: dict[int, list[int]] = {}
    for octave in octaves(n):
        stride = max(tile, 32 * octave)
        groups.setdefault(stride if stride < n else n, []).append(octave)
    out = []
    for stride, own in groups.items():
        for at in range(0, n, stride):
            end = min(n, at + stride + 8 * own[-1] + 16)
            out.append((own[0], own[-1], at, end))
            if end == n:
                break
    return out


def _kept(words: _words.Words, document: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """Texts without the words that some run contains after its first period."""
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, words.first[document] + start + period, 1)
    np.add.at(change, words.first[document] + start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    data, place = _words.joined(_words.Words(words.data, words.start[keep], words.end[keep], first, words.hash[keep]))
    raw = data.tobytes()
    return [raw[place[a] : place[b] - 1] if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _run_lists(count: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that fit one tile of every octave."""
    for batch in _words.slices(batches, "text"):
        words = _words.split(batch.column("text"))
        tiles = Segments(words.hash, words.first)
        parts = [tiles.fragments(octave) for octave in octaves(int(np.diff(words.first).max(initial=0)))]
        document, start, end, q = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort([q, start, document])
        document, start, length, q = document[order], start[order], (end - start + q)[order], q[order]
        runs = _run_lists(np.bincount(document, minlength=batch.num_rows), start, length, q)
        kept = pa.array(_kept(words, document, start, length, q), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), runs, kept], ["doc_id", "runs", "kept"])


def _tiles(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "text", rows=1):
            words = _words.split(batch.column("text"))
            _, code = np.unique(words.hash, return_inverse=True)
            code = code.astype("<i4")
            for low, high, a, b in tile_plan(len(code), tile):
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([low]), pa.array([high]), pa.array([a]), pa.array([code[a:b].tobytes()], pa.binary())], ["row", "low", "high", "at", "codes"])

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, low, high, at, codes in zip(*(batch.column(c).to_pylist() for c in ("row", "low", "high", "at", "codes")), strict=True):
            code = np.frombuffer(codes, "<i4")
            tile = Segments(_words.mix(code.astype(np.uint64) + np.uint64(1)), np.array([0, len(code)]))
            octave = low
            while octave <= high:
                _, start, end, q = tile.fragments(octave)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row)), *(pa.array(x, pa.int64()) for x in (start + at, end + at, q))], ["row", "start", "end", "q"])
                octave *= 2


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words.slices(batches, "text"):
        words = _words.split(batch.column("text"))
        runs = batch.column("runs")
        count = np.array(runs.value_lengths().fill_null(0).to_pylist(), np.int64)
        start, length, period = (runs.flatten().field(f).to_numpy() for f in ("start", "length", "period"))
        kept = _kept(words, np.repeat(np.arange(batch.num_rows), count), start, length, period)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _run_lists(count, start, length, period), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "kept"])


def stitched(fragments: DataFrame) -> DataFrame:
    """``row, start, length, period``: fragments of one document and period that overlap are one run."""
    own = W.partitionBy("row", "q").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))
    groups = fragments.withColumn("reached", reached).withColumn("island", island)
    runs = groups.groupBy("row", "q", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("row", "start", (F.col("end") - F.col("start") + F.col("q")).alias("length"), F.col("q").alias("period"))


def find_runs(docs: DataFrame, long_chars: int = LONG_CHARS, tile: int = TILE_WORDS) -> DataFrame:
    """``doc_id, runs, kept`` of ``docs(doc_id, text)``: all runs by start and period, and the text with each run's first period only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long_chars
    whole = rows.filter(~is_long).mapInArrow(_whole, f"doc_id long, runs {RUNS}, kept string")
    long = stored(rows.filter(is_long).withColumn("row", F.monotonically_increasing_id()))
    tiles = long.select("row", "text").mapInArrow(_tiles(tile), "row long, low long, high long, at long, codes binary")
    fragments = tiles.repartition("row", "low", "at").mapInArrow(_solved, "row long, start long, end long, q long")
    runs = stitched(fragments).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("own"))
    # The order of a text's runs is by start, then period; lengths come between in the struct.
    runs = runs.select("row", F.expr("transform(array_sort(transform(own, x -> struct(x.start, x.period, x.length))), x -> struct(x.start as start, x.length as length, x.period as period))").alias("runs"))
    apart = long.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(_collapsed, f"doc_id long, runs {RUNS}, kept string")
    return whole.unionByName(apart)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, by a hash of the id, repeat a part of themselves to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # Words and numbers are bound once a row, wherever the optimiser puts the expression.
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    bound = f"transform(filter(array({words}), w -> size(w) > 0), w -> struct(w, g % size(w) as a, 1 + floor((size(w) - g % size(w)) / (3 + g % 8)) as p))"
    word = "x.w[cast(if(i < x.a, i, x.a + (i - x.a) % x.p) as int)]"
    tail = F.expr(f"get(transform({bound}, x -> array_join(transform(sequence(0L, size(x.w) - 1L), i -> {word}), ' ')), 0)")
    hashed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    return hashed.select("doc_id", F.coalesce(F.when(F.col("chosen"), tail), "text").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document."""
    found = find_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.expr("element_at(array_sort(transform(runs, x -> struct(-x.length as below, x.start, x.period))), 1)")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    best = F.when(F.size("runs") > 0, longest)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("kept"), 256).alias("collapsed_sha256"))
    length = -F.col("best.below")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
