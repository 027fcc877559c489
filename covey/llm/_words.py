"""Vectorised word splitting and hashing over Arrow string columns.

These helpers run inside Spark tasks on one bounded slice of an Arrow batch.
They work on UTF-8 bytes, so a word is a maximal run of bytes that are not in
``separators``; every separator is an ASCII byte, which never occurs inside a
multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

#: The six ASCII white-space bytes.
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte that is neither a digit nor a lower-case letter.
NOT_ALNUM = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))

#: Text bytes handled at once inside a task.
SLICE_BYTES = 3 << 20
#: Words up to this many bytes are hashed in lockstep, longer ones one by one.
_LOCKSTEP = 64

_FNV_BASIS = np.uint64(0xCBF29CE484222325)
_FNV_PRIME = np.uint64(0x100000001B3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """The words of some texts: byte spans in ``data`` and ``first[d]:first[d+1]`` per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, i: int, j: int) -> list[bytes]:
        """The bytes of words ``i`` to ``j`` (exclusive)."""
        return [self.data[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` and ``rows`` rows at most, at least one row each."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def split(column: pa.Array, separators: bytes = WHITESPACE, lower: bool = False) -> Words:
    """Words of each text with 64-bit hashes; ``lower`` folds A-Z first."""
    data, offsets = buffers(column)
    if lower:
        data = _LOWER[data]
    table = np.ones(256, bool)
    table[list(separators)] = False
    inside = table[data]
    begins = np.zeros(len(data) + 1, bool)  # a text starts here, so no word goes on
    begins[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~begins[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~begins[1:] if len(data) else inside
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, hash_spans(data, start, end))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    h = np.full(len(start), _FNV_BASIS)
    size = end - start
    live = np.arange(len(start))
    for k in range(_LOCKSTEP):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ data[start[live] + k]) * _FNV_PRIME
    for i in np.flatnonzero(size > _LOCKSTEP).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``n`` hashes; crosses text bounds, see :func:`inside`."""
    count = max(len(h) - n + 1, 0)
    out = np.full(count, n, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        out = (out ^ h[k : k + count]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words at each word lies in one text."""
    total = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[: max(total - n + 1, 0)] >= n


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column ``text`` compressed, for texts that are about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches, "text"):
        data, offsets = buffers(batch.column("text"))
        raw = data.tobytes()
        texts = pa.array([pack(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, with column ``text`` as it was."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = pa.array([unpack(x).decode() for x in part.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(c) for c in part.schema.names], part.schema.names)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, and where each group starts."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and all(kept[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            starts = _starts(batch, keys)
            if len(starts) == 1:
                kept.append(batch)
                continue
            cut = int(starts[-1])
        else:
            if kept:
                yield _with_starts(kept, keys)
                kept = []
            cut = int(_starts(batch, keys)[-1])
        if cut:
            yield _with_starts([*kept, batch.slice(0, cut)], keys)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield _with_starts(kept, keys)


def _starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = batch.column(k)
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _with_starts(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table, _starts(table, keys)


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words with a space after each, and where each word starts there; one more bound ends the last."""
    size = words.end - words.start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(place[-1], 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place[:-1], size) + within] = words.data[np.repeat(words.start, size) + within]
    return out, place


def codes(words: Words) -> np.ndarray:
    """A number for each word, the same for the same bytes only: hashes number them, and the bytes are compared."""
    _, first, code = np.unique(words.hash, return_index=True, return_inverse=True)
    like = first[code]
    size = words.end - words.start
    if (size == size[like]).all():
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if (words.data[np.repeat(words.start, size) + within] == words.data[np.repeat(words.start[like], size) + within]).all():
            return code
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words.text(0, len(words.hash))], np.int64)
