"""Substring deduplication by prefix-partitioned suffix trees over words.

Every word starts a suffix, and a node of the suffix tree that is ``window`` words
deep or more is a passage that repeats.  The suffixes are split into groups that
fit memory, each group's suffixes are sorted, and the longest common prefixes of
neighbours give the inner nodes of its subtree.

1. The partitioning prefix.  Suffixes that share ``window`` words are in one group
   if the group is named by anything in these words.  It is named by its anchor,
   the run of five words with the smallest hash, instead of the first five words:
   then neighbouring suffixes, which have all words but one in common, mostly go to
   the same group as one segment of text, about 27 words for 8 suffixes and not 20
   for each.  A suffix whose anchor occurs once in the corpus has no partner and
   leaves first.
2. Variable length.  The number of occurrences of an anchor bounds its group.  In a
   group up to the bound a task sorts the suffixes of its segments and builds the
   subtree.  In a larger one the prefix is lengthened to the whole window, named by
   a digest of 128 bits of its words.  Such a group is one deep node by itself, of
   any number of leaves: the first of each slice of a task go on, are ranked in
   shares, and then the first of the shares.
3. Of the leaves below each highest node of ``window`` words or more, all but the
   first one start words to remove; what overlaps or touches joins into maximal repeats.

Words are compared by their bytes.  The first leaf is the one with the smallest
document id, then the earliest row, then the earliest start.  Nulls and empty texts
have no words.  A null id sorts before all others.  Repeated rows are documents of
their own: the later row loses what it repeats.  A text of any length is read in
one piece; its segments are short unless one anchor repeats all along.  An empty
table gives no rows.  Other columns of any name are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ..sources.scratch import stored

#: Words in an anchor.
ANCHOR_WORDS = 5
#: An anchor with more occurrences has its prefix lengthened.
GROUP_ANCHORS = 5_000
#: Shares in which the copies of one path are ranked.
SHARES = 256


class SuffixTree:
    """The subtree of some segments of words: leaves in order and the depths of the nodes between neighbours.

    ``code`` numbers the words of all segments, segment ``s`` being ``first[s]`` to
    ``first[s + 1]``.  A suffix ends with its segment.  Leaves are the suffixes of
    ``least`` words or more.
    """

    def __init__(self, code: np.ndarray, first: np.ndarray, least: int):
        n = len(code)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        # Ranks by the first 1, 2, 4, ... words; a suffix that ends earlier sorts before those that go on.
        ranks, size = [np.unique(code, return_inverse=True)[1]], 1
        while size < left.max(initial=0):
            rest = np.zeros(n, np.int64)
            more = np.flatnonzero(left > size)
            rest[more] = ranks[-1][more + size] + 1
            ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + rest, return_inverse=True)[1])
            size *= 2
        at = np.flatnonzero(left >= least)
        self.least = least
        self.leaves = at[np.argsort(ranks[-1][at], kind="stable")]
        #: Depth of the node that joins each leaf to the next one.
        self.depth = np.zeros(max(len(self.leaves) - 1, 0), np.int64)
        a, b = self.leaves[:-1], self.leaves[1:]
        for level in range(len(ranks) - 1, -1, -1):
            step = 1 << level
            go = np.flatnonzero((left[a] - self.depth >= step) & (left[b] - self.depth >= step))
            same = ranks[level][a[go] + self.depth[go]] == ranks[level][b[go] + self.depth[go]]
            self.depth[go[same]] += step

    def repeated(self) -> np.ndarray:
        """Positions of all leaves below the highest nodes of ``least`` words or more, but the first of each node."""
        if not len(self.leaves):
            return self.leaves
        top = np.concatenate([[True], self.depth < self.least])
        node = np.cumsum(top) - 1
        return np.sort(self.leaves[self.leaves != np.minimum.reduceat(self.leaves, np.flatnonzero(top))[node]])

    def nodes(self) -> Iterator[tuple[int, np.ndarray]]:
        """Depth and leaves of each inner node of ``least`` words or more: the right-maximal repeats."""
        open_: list[tuple[int, int]] = []  # depth, first leaf
        for i, depth in enumerate([*self.depth.tolist(), 0]):
            begin = i
            while open_ and open_[-1][0] > depth:
                deep, begin = open_.pop()
                yield deep, self.leaves[begin : i + 1]
            if depth >= self.least and not (open_ and open_[-1][0] == depth):
                open_.append((depth, begin))


def _sliding(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each run of ``size`` values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(words: _words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows that lie in one text, and their anchors."""
    size = min(ANCHOR_WORDS, window)
    runs = _words.grams(words.hash, size)
    low = _sliding(runs, window - size + 1, np.minimum)
    start = np.flatnonzero(_words.inside(words.first, window)) if len(words.hash) >= window else np.zeros(0, np.int64)
    return start, low[start]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(ANCHOR_WORDS, window)
        span = window - size + 1
        for batch in _words.slices(_words.unpacked(batches), "text"):
            words = _words.split(batch.column("text"))
            start, low = window_anchors(words, window)
            if not len(start):
                continue
            runs = _words.grams(words.hash, size)
            # A run is an anchor if one of the windows that hold it has it as its smallest.
            padded = np.zeros(len(runs) + span - 1, np.uint64)
            padded[start + span - 1] = low
            place = np.flatnonzero(_sliding(padded, span, np.maximum) == runs)
            doc = np.searchsorted(words.first, place, "right") - 1
            order = np.lexsort((runs[place], doc))
            doc, value = doc[order], runs[place][order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
            times = np.diff(np.append(first, len(doc)))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc[first])), pa.array(value[first].view(np.int64)), pa.array(times)], ["row", "anchor", "times"])

    return run


def _flagged_windows(batch: pa.RecordBatch, window: int) -> tuple[_words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch, and of the windows whose anchor is among their row's: start, anchor and text."""
    words = _words.split(batch.column("text"))
    start, low = window_anchors(words, window)
    doc = np.searchsorted(words.first, start, "right") - 1
    bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    kept = [np.flatnonzero(np.isin(low[bounds[d] : bounds[d + 1]].view(np.int64), own.values.to_numpy())) + bounds[d] for d, own in enumerate(batch.column("anchors"))]
    at = np.concatenate(kept)
    return words, start[at], low[at].view(np.int64), doc[at]


def _segments(window: int):
    """Runs of neighbouring suffixes with one anchor, as stretches of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(_words.unpacked(batches), "text"):
            words, start, anchor, doc = _flagged_windows(batch, window)
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
            last = start[np.append(new[1:], len(start)) - 1] + window - 1
            raw = words.data.tobytes()
            texts = pa.array([raw[a:b].decode() for a, b in zip(words.start[start[new]].tolist(), words.end[last].tolist(), strict=True)], pa.string())
            where = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[new]), batch.column("doc_id").take(where), batch.column("row").take(where), pa.array((start[new] - words.first[doc[new]]).astype(np.int32)), texts],
                ["anchor", "doc_id", "row", "start", "segment"],
            )

    return run


def _subtrees(window: int):
    """Words to remove by the subtrees of whole groups of segments, which come in the order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _words.whole_groups(batches, ["anchor"]):
            words = _words.split(table["segment"])
            gone = SuffixTree(_words.codes(words), words.first, window).repeated()
            if not len(gone):
                continue
            segment = np.searchsorted(words.first, gone, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (gone[1:] != gone[:-1] + 1)]))
            last = np.append(new[1:], len(gone)) - 1
            of = segment[new]
            shift = table["start"].to_numpy()[of] - words.first[of]
            yield pa.RecordBatch.from_arrays(
                [table["row"].combine_chunks().take(pa.array(of)), pa.array((gone[new] + shift).astype(np.int32)), pa.array((gone[last] + shift + window).astype(np.int32))], ["row", "start", "end"]
            )

    return run


def _paths(window: int):
    """Single suffixes with a digest of their first ``window`` words: of equal ones in a slice the first, and without a digest the words of the others, which are to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(_words.unpacked(batches), "text"):
            words, start, _, doc = _flagged_windows(batch, window)
            if not len(start):
                continue
            data, place = _words.joined(words)
            raw = data.tobytes()
            path = np.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(place[start].tolist(), place[start + window].tolist(), strict=True)], "V16")
            by_id = pc.sort_indices(pa.table({c: batch.column(c) for c in ("doc_id", "row")}), sort_keys=[("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
            turn = np.empty(batch.num_rows, np.int64)
            turn[by_id] = np.arange(batch.num_rows)
            order = np.lexsort((start, turn[doc]))  # a slice's windows as documents follow each other
            _, first = np.unique(path[order].view([("a", "<u8"), ("b", "<u8")]), return_index=True)
            head = np.zeros(len(order), bool)
            head[order[first]] = True
            gone = np.flatnonzero(~head)
            new = np.flatnonzero(np.concatenate([[True], (doc[gone][1:] != doc[gone][:-1]) | (start[gone][1:] != start[gone][:-1] + 1)])) if len(gone) else gone
            heads = np.flatnonzero(head)
            at = np.concatenate([heads, gone[new]])
            last = np.concatenate([start[heads], start[gone[np.append(new[1:], len(gone)) - 1]] if len(gone) else gone])
            shift = words.first[doc[at]]
            digests = pa.array([path[i].tobytes() for i in heads.tolist()] + [None] * len(new), pa.binary())
            where = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([digests, batch.column("doc_id").take(where), batch.column("row").take(where), pa.array((start[at] - shift).astype(np.int32)), pa.array((last - shift + window).astype(np.int32))], ["path", "doc_id", "row", "start", "end"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words.slices(_words.unpacked(batches), "text"):
        words = _words.split(batch.column("text"))
        spans = [[] for _ in range(batch.num_rows)]
        for d, gone in enumerate(batch.column("gone")):
            if gone.is_valid:
                start, end = (gone.values.field(c).to_numpy() for c in ("start", "end"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                spans[d] = [{"start": a, "end": b} for a, b in zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist(), strict=True)]
        kept = []
        for d, gone in enumerate(spans):
            a, b = int(words.first[d]), int(words.first[d + 1])
            keep = np.ones(b - a, bool)
            for x in gone:
                keep[x["start"] : x["end"]] = False
            kept.append(b" ".join(w for w, k in zip(words.text(a, b), keep.tolist(), strict=True) if k).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), batch.column("text"), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
            ["row", "text", "n_words", "repeats", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = 20, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """``row, text, n_words, repeats, kept`` of every row of ``docs(doc_id, text, ...)``.

    ``row`` is a struct of the other columns of ``docs``, ``text`` the input (a null
    as an empty text).  ``repeats`` are the removed words from ``start`` to before
    ``end``, as maximal repeats; ``kept`` is the rest, joined by spaces.  Rows are
    numbered once and stored with their compressed texts; all later steps read that.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest)
    kind = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema])
    numbered = stored(rows.mapInArrow(_words.packed, kind))
    anchors = numbered.select("row", "text").mapInArrow(_anchors(window), "row long, anchor long, times long")
    frequent = anchors.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1")
    shared = anchors.select("row", "anchor").join(frequent, "anchor").groupBy("row")
    flagged = stored(shared.agg(F.collect_list(F.when(F.col("times") <= group_anchors, F.col("anchor"))).alias("small"), F.collect_list(F.when(F.col("times") > group_anchors, F.col("anchor"))).alias("large")))
    texts = numbered.repartition("row")  # one exchange for all joins

    def suffixes(group: str, form, schema: str) -> DataFrame:
        own = flagged.filter(F.size(group) > 0).select("row", F.col(group).alias("anchors"))
        return texts.join(own.hint("shuffle_hash"), "row").select("row", "doc_id", "text", "anchors").mapInArrow(form(window), schema)

    leaf = ["doc_id", "row", "start"]
    segments = suffixes("small", _segments, "anchor long, doc_id long, row long, start int, segment string")
    small = segments.repartition("anchor").sortWithinPartitions("anchor", *leaf).mapInArrow(_subtrees(window), "row long, start int, end int")
    # Of a frequent path's copies only the first of each slice is ranked, in shares first; only the first of each share meet.
    large = stored(suffixes("large", _paths, "path binary, doc_id long, row long, start int, end int"))
    shares = large.filter("path is not null").withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES))).withColumn("leaf", F.row_number().over(W.partitionBy("path", "share").orderBy(*leaf)))
    heads = shares.filter("leaf = 1").drop("leaf").withColumn("leaf", F.row_number().over(W.partitionBy("path").orderBy(*leaf)))
    parts = [small, large.filter("path is null"), shares.filter("leaf > 1"), heads.filter("leaf > 1")]
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part.select("row", "start", "end"))
    gone = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    found = texts.join(gone.hint("shuffle_hash"), "row", "left").select("rest", "text", "gone")
    out = T.StructType([T.StructField("row", rows.schema["rest"].dataType), *T.StructType.fromDDL("text string, n_words long, repeats array<struct<start: long, end: long>>, kept string")])
    return found.mapInArrow(_removed, out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated twenty-word windows."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", F.expr("aggregate(repeats, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS text
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
