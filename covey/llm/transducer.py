"""A byte-level BPE tokenizer compiled, as it is used, into a deterministic transducer.

Two machines run one after the other:

* :func:`word_starts` is the pre-tokenizer.  Its states are character classes;
  all of its rules look at most one character ahead, so the starts of the words
  of a whole slice of texts are found with a few vectorised comparisons.
* :class:`Transducer` reads the bytes of a word.  A state stands for the longest
  suffix of the word that a longer token could still swallow, together with the
  last token before each point where such a token could begin.  Each transition
  carries the change in the number of tokens; it is negative where a byte lets
  tokens merge.  The number of states is finite because tokens have a longest
  length; they are built when first reached and kept in dense tables.

A correct BPE encoding is the only token sequence in which every neighbouring
pair is stable (encoding the pair's bytes gives the pair back), which is what a
transition checks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from ._words import hash_spans

LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)

#: The Unicode white-space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a word of their own.
SHORT_ENDINGS = ["s", "t", "m", "d"]
LONG_ENDINGS = ["re", "ve", "ll"]

#: States kept before a worker starts its tables anew, between two slices.
MAX_STATES = 300_000
#: Distinct words whose results a worker keeps.
MAX_WORDS = 1_500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            out[point] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start, and which of these words are the special token.

    ``data`` holds the texts back to back, ``offsets`` their bounds.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    kind = classes()[points]
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(lead, offsets)] = True
    specials = []
    if special:
        raw = data.tobytes()
        for m in re.finditer(re.escape(special), raw):
            text = np.searchsorted(offsets, m.start(), "right") - 1
            if m.end() <= offsets[text + 1]:
                specials.append(int(np.searchsorted(lead, m.start())))
                fresh[[specials[-1], int(np.searchsorted(lead, m.end()))]] = True
    fresh[n] = True
    inner = np.zeros(n, bool)
    for i in specials:
        inner[i + 1 : i + len(special)] = True
    white = (kind == SPACE) | (kind == WHITE)
    before = np.concatenate([[OTHER], kind[:-1]]).astype(np.uint8) if n else kind
    white_before = np.concatenate([[False], white[:-1]]) if n else white
    solid_after = np.concatenate([~white[1:], [False]]) & ~fresh[1:] if n else white
    start = np.where(white, ~white_before | solid_after, (before != kind) & (before != SPACE)) | fresh[:-1]
    quotes = np.flatnonzero((points == 0x27) & (fresh[:-1] | ((before != SPACE) & (before != OTHER))))
    if len(quotes):
        padded = np.concatenate([points, [0, 0, 0]])
        open_1 = ~fresh[np.minimum(quotes + 1, n)]
        open_2 = open_1 & ~fresh[np.minimum(quotes + 2, n)]
        short = open_1 & np.isin(padded[quotes + 1], [ord(x) for x in SHORT_ENDINGS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= open_2 & (padded[quotes + 1] == ord(a)) & (padded[quotes + 2] == ord(b))
        hit = short | long
        start[quotes[hit] + 1] = False
        after = quotes[hit] + np.where(short[hit], 2, 3)
        start[after[after < n]] = True
    at = lead[start & ~inner]
    is_special = np.zeros(len(at), bool)
    if specials:
        is_special[np.searchsorted(at, lead[specials])] = True
    return at, is_special


def byte_alphabet() -> dict[str, int]:
    """How the vocabulary file writes bytes: printable ones as themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Token counts of words under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE tokenizer")
        code = byte_alphabet()
        self.special, self.special_id = special_token(spec)
        ids = {bytes(code[c] for c in k): v for k, v in spec["model"]["vocab"].items() if v != self.special_id}
        self.bytes_of = {v: k for k, v in ids.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(code[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[ids[a], ids[b]] = (i, ids[a + b])
        self.ids = {k: v for k, v in ids.items() if self.merged(k) == [v]}
        self.open = {k[:i] for k in self.ids for i in range(len(k))}  # what can still become a token
        self.stable_pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states."""
        #: Of each state: the suffix, and for each cut in it: place << 40 | (tokens since + 2048) << 20 | last token before + 1.
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (2048 << 20,))]
        self.number = {self.states[0]: 0}
        #: state << 8 | byte -> next state << 8 | change in the number of tokens + 128
        self.transitions: dict[int, int] = {}

    def merged(self, word: bytes) -> list[int]:
        """The tokens of a word by merging the lowest-ranked pair again and again."""
        parts = [self.single[b] for b in word]
        while len(parts) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def _stable(self, a: int, b: int) -> bool:
        known = self.stable_pairs.get(a << 20 | b)
        if known is None:
            known = self.stable_pairs[a << 20 | b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _compile(self, state: int, byte: int) -> int:
        suffix, cuts = self.states[state]
        longer = suffix + bytes([byte])
        for cut in cuts:
            token = self.ids.get(longer[cut >> 40 :])
            if token is not None and (not cut & 0xFFFFF or self._stable((cut & 0xFFFFF) - 1, token)):
                change = 2049 - (cut >> 20 & 0xFFFFF)
                break
        else:
            raise AssertionError("no stable token")
        kept = [cut for cut in cuts if longer[cut >> 40 :] in self.open]
        first = kept[0] >> 40 if kept else len(longer)
        key = (longer[first:], (*(cut - (first << 40) + (change << 20) for cut in kept), len(longer) - first << 40 | 2048 << 20 | token + 1))
        found = self.number.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        self.transitions[state << 8 | byte] = out = found << 8 | change + 128
        return out

    def count(self, word: bytes) -> int:
        """Number of tokens of one word: the sum of what its transitions emit."""
        known, state, total = self.transitions.get, 0, 0
        for byte in word:
            step = known(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step >> 8
            total += (step & 0xFF) - 128
        return total


def special_token(spec: dict) -> tuple[bytes | None, int]:
    """The one added token of a vocabulary file, or none."""
    added = spec["added_tokens"]
    if len(added) > 1:
        raise ValueError("more than one added token")
    return (added[0]["content"].encode(), added[0]["id"]) if added else (None, -1)


class WordTable:
    """Keeps a result for every distinct word that a worker has met, found by the word's hash."""

    def __init__(self, limit: int = MAX_WORDS) -> None:
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.size = 0

    def rows_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row number for each word; and where the words start that have new rows, which follow the old ones."""
        if self.size > self.limit:
            self.__init__(self.limit)
        code, distinct = pd.factorize(hash_spans(data, start, end))
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        old = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        row = np.empty(len(distinct), np.int64)
        row[old] = self.rows[at[old]]
        fresh = np.flatnonzero(~old)
        row[fresh] = self.size + np.arange(len(fresh))
        self.size += len(fresh)
        keys, rows = np.concatenate([self.keys, distinct[fresh]]), np.concatenate([self.rows, row[fresh]])
        order = np.argsort(keys, kind="stable")  # the old ones are in order already
        self.keys, self.rows = keys[order], rows[order]
        place = np.zeros(len(distinct), np.int64)
        place[code[::-1]] = np.arange(len(code))[::-1]
        return row[code], place[fresh]


class TokenCounter:
    """Token counts of whole texts by the transducer."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.table = WordTable()
        self.known = np.zeros(0, np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text.

        A word starts in the machine's first state whatever came before, so the
        state maps of the words are constant there and compose by a prefix sum.
        """
        if len(self.machine.states) > MAX_STATES:
            self.machine.clear()
        start, special = word_starts(data, offsets, self.machine.special)
        end = np.append(start[1:], len(data))
        row, fresh = self.table.rows_of(data, start, end)
        raw = data.tobytes()
        new = [self.machine.count(raw[a:b]) for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
        self.known = np.concatenate([self.known[: self.table.size - len(new)], np.array(new, np.int64)])
        each = self.known[row]
        each[special] = 1
        total = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(start, offsets)]
        return np.diff(total)


class TokenEncoder:
    """Token ids of whole texts, by the library, one call for each distinct word that a worker meets."""

    def __init__(self, path: str, special: bool = True):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = byte_alphabet()
        self.special, self.special_id = special_token(spec)
        ranks = {bytes(code[c] for c in k): v for k, v in spec["model"]["vocab"].items() if v != self.special_id}
        merged = [ranks[bytes(code[c] for c in (x.replace(" ", "") if isinstance(x, str) else "".join(x)))] for x in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("token ids do not follow the order of the merges")
        self.bytes_of = {v: k for k, v in ranks.items()}
        if not special:  # its string in a text is plain text
            self.special = None
        self.library = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), self.special_id]) + 1
        self.table = WordTable()
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and the bounds of each text among them."""
        start, special = word_starts(data, offsets, self.special)
        end = np.append(start[1:], len(data))
        row, fresh = self.table.rows_of(data, start, end)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
        new = [[self.special_id] if s else self.library.encode_ordinary(w) for w, s in zip(words, special[fresh].tolist(), strict=True)]
        old = self.table.size - len(new)
        if not old:
            self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in new], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter((t for x in new for t in x), np.uint32)])
        first, size = self.bounds[row], self.bounds[row + 1] - self.bounds[row]
        place = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(first - place[:-1], size) + np.arange(place[-1])]
        return out, place[np.searchsorted(start, offsets)]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One for each Python worker and vocabulary file."""
    return TokenCounter(path)


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> TokenEncoder:
    """One for each Python worker and vocabulary file; without ``special`` the added token's string is plain text."""
    return TokenEncoder(path, special)
