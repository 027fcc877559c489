"""Alignment of two tokenizers over one corpus by merge-path partitioning.

A text, after a space, is encoded by a byte-level BPE (A) and by a piece model
(B).  Both cut the same bytes, so their tokens are two rising lists of end
offsets, and to align them is to merge these lists.  Diagonals of the merge path,
found by binary search, cut the merge into pieces of equal work that don't need
each other: each piece gives the links (pairs of tokens whose bytes overlap, one
for each distinct end) and the ends that both share; groups that go over the
bounds of pieces are put together from the shared ends.

A long text is cut before a single space between two ASCII letters or digits,
where both tokenizers start a token whatever surrounds it; its parts are dealt
over the cluster and their groups joined in order.

Counts of linked id pairs are summed before they are shuffled.  A pair with at
least one in ``HEAVY`` of all links is one of ``HEAVY`` pairs at most, so these are
looked up where the documents are; a lighter pair has few rows, and is joined.

A text that is null or empty, or that B does not give back byte by byte (one
with U+2581), has no tokens.  Repeated rows, repeated and null ids keep a row each;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import _words
from .transducer import WordTable, encoder

#: Characters in a part of a long text.
CHUNK_CHARS = 1 << 20
#: Text bytes encoded at once inside a task.
SLICE_BYTES = 1 << 20
#: Distinct words whose ids a worker keeps for each tokenizer.
KEPT_WORDS = 300_000
#: Steps of the merge in a piece.
PIECE_STEPS = 1 << 16
#: Pairs that are looked up instead of joined, at most.
HEAVY = 1 << 17
#: Distinct pairs that a task holds before it passes counts on.
HELD_PAIRS = 1 << 21
#: Stands for a space in a piece; fixed value.
BLANK = "▁"


class PieceEncoder:
    """Ids of texts that start with a space, by the piece model, one call for each distinct word that a worker meets.

    No piece has a blank behind another character, so nothing merges across the
    start of a run of spaces, and what lies between such starts is encoded alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces) or BLANK not in pieces:
            raise ValueError("the model has pieces over several words, or none for a space")
        self.blank = pieces.index(BLANK)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.table = WordTable(KEPT_WORDS)
        self.ids, self.bounds, self.whole = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, the bounds of each text among them, and whether each text's ids give its bytes back."""
        space = data == 0x20
        begins = space & ~np.concatenate([[False], space[:-1]])
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        row, fresh = self.table.rows_of(data, start, end)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
        new = [ids or [self.blank] for ids in self.library.encode([w[1:].decode() for w in words], num_threads=1)] if words else []
        if self.table.size == len(new):
            self.ids, self.bounds, self.whole = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in new], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter((t for x in new for t in x), np.int32)])
        self.whole = np.concatenate([self.whole, np.array([b"".join(self.bytes_of[t] for t in x) == w for x, w in zip(new, words, strict=True)], bool)])
        first, size = self.bounds[row], self.bounds[row + 1] - self.bounds[row]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - place[:-1], size) + np.arange(place[-1])]
        own = np.searchsorted(start, offsets)
        broken = np.concatenate([[0], np.cumsum(~self.whole[row])])[own]
        return ids, place[own], np.diff(broken) == 0


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """How many of ``a`` are among the first ``0, steps, 2 steps, …`` of the merge of two rising lists; equal ones of ``a`` come first."""
    d = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        half = (low + high) // 2
        # a[half] is among the first d if it is not after b[d - half - 1]
        more = (low < high) & (a[np.minimum(half, len(a) - 1)] <= b[np.clip(d - half - 1, 0, len(b) - 1)])
        low, high = np.where(more, half + 1, low), np.where(more | (low >= high), high, half)
    return low


def merge_ends(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links, as places in two rising lists of ends in order, and which of each list are shared by both."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(a), bool), np.zeros(len(b), bool)
    cuts_a = diagonals(a, b, steps)
    cuts_b = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b)) - cuts_a
    links, shared_a, shared_b = [], np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i0, i1, j0, j1 in zip(cuts_a[:-1].tolist(), cuts_a[1:].tolist(), cuts_b[:-1].tolist(), cuts_b[1:].tolist(), strict=True):
        # What ends first is the end of a link: with the token of the other list that is open there.
        from_a, from_b = np.arange(i0, i1), np.arange(j0, j1)
        other_b = j0 + np.searchsorted(b[j0:j1], a[i0:i1], "left")
        before = max(i0 - 1, 0)  # an equal end of a may be the last of the piece before
        other_a = before + np.searchsorted(a[before:i1], b[j0:j1], "left")
        tie = a[np.minimum(other_a, len(a) - 1)] == b[j0:j1]
        shared_b[j0:j1] = tie
        shared_a[other_a[tie]] = True
        at = np.argsort(np.concatenate([a[i0:i1], b[j0:j1][~tie]]), kind="stable")
        links.append((np.concatenate([from_a, other_a[~tie]])[at], np.concatenate([other_b, from_b[~tie]])[at]))
    return *(np.concatenate(x) for x in zip(*links, strict=True)), shared_a, shared_b


def _groups(ids_a: np.ndarray, ids_b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray, tables: list[bytes]) -> list[bytes]:
    """All tokens in the order of groups, those of A first, each with the sign that follows it."""
    group_a = np.concatenate([[0], np.cumsum(shared_a)])[:-1]
    group_b = np.concatenate([[0], np.cumsum(shared_b)])[:-1]
    ends_a, ends_b = np.flatnonzero(shared_a) + 1, np.flatnonzero(shared_b) + 1
    at_a = np.arange(len(ids_a)) + np.concatenate([[0], ends_b])[group_a]
    at_b = np.arange(len(ids_b)) + ends_a[group_b]
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[at_a] = ids_a * 3 + shared_a  # , or |
    code[at_b] = ids_b * 3 + 2 * shared_b  # , or ;
    return list(map(tables.__getitem__, code.tolist()))


@lru_cache(maxsize=1)
def _signed(size: int) -> list[bytes]:
    return [f"{i}{sign}".encode() for i in range(size) for sign in ",|;"]


ALIGNED = "row long, doc_id long, chunk int, chunks int, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<int>"


def _aligned(path_a: str, path_b: str, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoder(path_a, False), _pieces(path_b)
        a.table.limit = KEPT_WORDS
        size_a = np.zeros(a.size, np.int64)
        for i, token in a.bytes_of.items():
            size_a[i] = len(token)
        size_b = np.array([len(x) for x in b.bytes_of])
        width, tables = len(b.bytes_of), _signed(max(a.size, len(b.bytes_of)))
        for batch in _words.slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            own, offsets = _words.buffers(batch.column("text"))
            # A space before each text.
            data = np.full(len(own) + n, 0x20, np.uint8)
            starts = offsets + np.arange(n + 1)
            behind = np.ones(len(data), bool)
            behind[starts[:-1]] = False
            data[behind] = own
            ids_a, bounds_a = a.encode(data, starts)
            ids_b, bounds_b, whole = b.encode(data, starts)
            ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
            ok = whole & (np.diff(offsets) > 0)
            keep_a, keep_b = np.repeat(ok, np.diff(bounds_a)), np.repeat(ok, np.diff(bounds_b))
            n_a, n_b = np.where(ok, np.diff(bounds_a), 0), np.where(ok, np.diff(bounds_b), 0)
            ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
            to_a, to_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
            i, j, shared_a, shared_b = merge_ends(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]), steps)
            n_groups = np.diff(np.concatenate([[0], np.cumsum(shared_a)])[to_a])
            n_links = n_a + n_b - n_groups
            signed = _groups(ids_a, ids_b, shared_a, shared_b, tables)
            to_text = (to_a + to_b).tolist()
            groups = [b"".join(signed[x:y])[:-1].decode() for x, y in zip(to_text[:-1], to_text[1:], strict=True)]
            # Distinct pairs of each text with the number of its links.
            text = np.repeat(np.arange(n), n_links)
            key = np.sort(text * (width * a.size) + ids_a[i] * width + ids_b[j])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(key)))
            bounds = np.searchsorted(key[first], np.arange(n + 1) * (width * a.size))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (pa.array(key[first] % (width * a.size), pa.int64()), pa.array(counts, pa.int32()))]
            empty = batch.column("chunks").to_numpy() == 1  # an empty text has no tokens
            ok = whole & ((np.diff(offsets) > 0) | ~empty)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "chunk", "chunks")), pa.array(ok), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), *lists],
                ["row", "doc_id", "chunk", "chunks", "ok", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"],
            )

    return run


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_chars: int = CHUNK_CHARS, steps: int = PIECE_STEPS) -> DataFrame:
    """A row for each part of a text of ``docs(doc_id, text)``: sizes, ``groups`` as ``a1,a2|b1;a3|b2``, and its distinct linked pairs with their ``counts``.

    A pair is ``A's id * B's number of ids + B's id``.  ``row`` tells texts apart and
    ``chunk`` orders the ``chunks`` parts of one; ``ok`` is false where B does not
    give the text back.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one, zero = F.lit(1).alias("chunks"), F.lit(0).alias("chunk")
    short = rows.filter(F.length("text") <= chunk_chars).select("row", "doc_id", zero, one, "text")
    # Places of spaces to cut at: the first in each window of the text, where there is one.
    # Lengths count characters; a place found by a regular expression would count a character beyond U+FFFF twice.
    cut = f"length(regexp_extract(substring(text, cast(k * {chunk_chars} + 1 as int), {chunk_chars}), '(?s)^(.*?[A-Za-z0-9]) [A-Za-z0-9]', 1))"
    cuts = f"filter(transform(sequence(1, cast(length(text) div {chunk_chars} as int)), k -> struct(k, {cut} as at)), x -> x.at > 0)"
    bounds = F.expr(f"concat(array(-1), transform({cuts}, x -> cast(x.k * {chunk_chars} + x.at as int)), array(length(text)))")
    long = rows.filter(F.length("text") > chunk_chars).withColumn("bounds", bounds).withColumn("chunks", F.size("bounds") - 1)
    long = long.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    long = long.select("row", "doc_id", "chunk", "chunks", F.expr("substring(text, bounds[chunk] + 2, bounds[chunk + 1] - bounds[chunk] - 1)").alias("text"))
    return short.unionByName(long.repartition("row", "chunk")).mapInArrow(_aligned(tokenizer_a, tokenizer_b, steps), ALIGNED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs over all rows of a task, passed on when too many are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> tuple[np.ndarray, np.ndarray]:
        pair, code = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, code, np.concatenate([x for _, x in held]))
        return pair, total

    for batch in batches:
        held.append((batch.column("pairs").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)))
        size += len(held[-1][0])
        if size > HELD_PAIRS:
            held = [combined()]
            size = len(held[0][0])
            if size > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in combined()], ["pair", "n"])


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: links of each pair over all rows, and whether it has the most among the pairs of its B id."""
    sums = stored(aligned.select("pairs", "counts").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod("pair", F.lit(width)).alias("b")
    most = sums.groupBy(b).agg(F.max("n").alias("most"))  # at most as many rows as B has ids
    return sums.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Sums over a row's links with heavy pairs; its other pairs follow as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            own, m = batch.column("pairs").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(row)), np.array(batch.column("pairs").value_lengths().to_pylist(), np.int64))
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            total, most = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(total, of[found], m[found] * n[at[found]])
            np.add.at(most, of[found], m[found] * best[at[found]])
            rest = ~found
            zeros = np.zeros(int(rest.sum()), np.int64)
            # A negative pair, another for each row, is no pair and spreads the rows.
            columns = [(row, row[of[rest]]), (-1 - row, own[rest]), (np.zeros(len(row), np.int64), m[rest]), (total, zeros), (most, zeros)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["row", "pair", "m", "count_sum", "n_best"])

    return run


def link_sums(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``row, count_sum, n_best``: over the links of a row, the counts of their pairs, and how many pairs are the best of their B id."""
    counts = stored(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * heavy >= F.lit(total)
    known = counts.filter(is_heavy).orderBy("pair").toPandas()  # at most ``heavy`` rows, as they share ``total``
    look_up = _looked_up(known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64))
    rows = aligned.select("row", "pairs", "counts").mapInArrow(look_up, "row long, pair long, m long, count_sum long, n_best long")
    joined = rows.join(counts.filter(~is_heavy), "pair", "left")
    own = F.col("m") * F.coalesce("n", F.lit(0))
    return joined.groupBy("row").agg(
        F.sum(F.col("count_sum") + own).alias("count_sum"), F.sum(F.col("n_best") + F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best")
    )


def align_corpus(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_chars: int = CHUNK_CHARS, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, count_sum, n_best`` for every row of ``docs``."""
    parts = align(docs, tokenizer_a, tokenizer_b, chunk_chars)
    # Of a whole text only the digest of its groups is kept; parts keep theirs to be joined.
    digest = F.when(F.col("chunks") == 1, F.sha2("groups", 256)).otherwise(F.col("groups")).alias("groups")
    parts = stored(parts.select(*(digest if c == "groups" else F.col(c) for c in parts.columns)))
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    short, long = parts.filter("chunks = 1"), parts.filter("chunks > 1")
    text = F.expr("array_join(transform(array_sort(collect_list(struct(chunk, groups))), x -> x.groups), ';')")
    joined = long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.min("ok").alias("ok"), *(F.sum(c).alias(c) for c in sizes), F.sha2(text, 256).alias("groups"))
    texts = short.select("row", "doc_id", "ok", *sizes, "groups").unionByName(joined)
    broken = long.filter("not ok").select("row").distinct()
    good = short.filter("ok").unionByName(long.join(broken, "row", "left_anti"))
    sums = link_sums(good, pair_counts(good, _width(tokenizer_b)), heavy)
    shown = texts.join(sums, "row", "left")
    if_ok = lambda c: F.when(F.col("ok"), F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long").alias(c)
    return shown.select("doc_id", *map(if_ok, sizes), if_ok("n_best"), if_ok("count_sum"), F.when(F.col("ok"), F.col("groups")).otherwise("").alias("groups_sha256"))


def _width(tokenizer_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50k byte-level BPE against the 32k piece model over all documents."""
    import public_tokenizers

    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
