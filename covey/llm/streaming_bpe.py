"""A BPE tokenizer with word ends as a transducer with bounded lookahead.

Three machines run one after the other:

* :class:`WordCutter` normalises a slice of texts and finds its words with a few
  vectorised comparisons of character classes.
* :class:`StreamEncoder` reads the symbols of a word and emits tokens once they
  are stable.  It holds at most ``block + lookahead`` symbols and a longest token.
* :class:`StreamDecoder` reads token ids and writes text: their bytes go through
  an incremental UTF-8 machine, block by block.

**Lookahead.**  Two encodings of a common prefix that go on differently part at
its end.  The last common boundary moves left only if one of them merges the
token before it, ``t``, with the token after it, ``u``, which the other does not
have.  Then ``t`` is what both see on the left of the next boundary, and the next
such merge has a higher rank and a right side that begins with ``t``, so a
right side on whose left spine (the chain of first operands) ``t`` lies.  The
longest way that a boundary can move is the longest sum of left sides along such
a chain of merges with rising ranks; one pass over the merge list finds it.  All
tokens that end further back than that stay as they are whatever follows.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from .transducer import LETTER, LONG_ENDINGS, NUMBER, OTHER, SHORT_ENDINGS, SPACE, WHITE, WordTable, byte_alphabet, classes

#: Symbols read between two emissions inside a long word.
BLOCK = 256
#: Parts up to which the pair to merge is found by looking at all of them.
SHORT = 24
#: Token ids decoded at once.
DECODE_BLOCK = 1 << 16
#: The one character whose lower case has two; fixed value of Unicode.
DOTTED_I, DOTTED_I_LOWER = "İ", "i̇"


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The lower case of every code point, taken alone."""
    out = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        low = chr(point).lower()
        if len(low) == 1:
            out[point] = ord(low)
    return out


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Code points that this Python does not know; the tokenizer's library may know some."""
    return np.array([unicodedata.category(chr(p)) == "Cn" for p in range(0x110000)])


def sufficient_lookahead(merges: list[tuple[str, str]], size) -> int:
    """Symbols after a token's end that settle it, whatever follows; ``size`` gives a token's number of symbols."""
    first: dict[str, str] = {}  # the first operand of each merged token
    reach: dict[str, int] = {}  # the longest chain so far whose last merge has this left side
    longest = 0
    for a, b in merges:
        chain, spine = 0, b
        while spine is not None:
            chain = max(chain, reach.get(spine, 0))
            spine = first.get(spine)
        moved = size(a) + chain
        reach[a] = max(reach.get(a, 0), moved)
        longest = max(longest, moved)
        first[a + b] = a
    return longest


class StreamEncoder:
    """Token ids of words, emitted as soon as they are stable."""

    def __init__(self, spec: dict, block: int = BLOCK):
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["unk_token"]:
            raise ValueError("not a plain BPE model")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        code = {b: c for c, b in byte_alphabet().items()}
        self.single = [vocab[code[b]] for b in range(256)]
        self.last = [vocab[code[b] + self.end] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made = {*self.single, *self.last}
        for i, (a, b) in enumerate(merges):
            if vocab[a] not in made or vocab[b] not in made:
                raise ValueError("a merge uses a token that no earlier merge has made")
            if vocab[a + b] in made:
                raise ValueError("two merges make one token")
            made.add(vocab[a + b])
            self.rank[vocab[a], vocab[b]] = (i, vocab[a + b])
        size = lambda token: len(token.removesuffix(self.end)) if self.end else len(token)
        self.size = {i: size(t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges, size)
        self.block = block

    def merged(self, parts: list[int]) -> list[int]:
        """What is left after merging the lowest-ranked pair, the leftmost of equal ones, again and again."""
        rank = self.rank
        if len(parts) > SHORT:
            return self._merged_long(parts)
        while len(parts) > 1:
            best = min(((found[0], i) for i, pair in enumerate(zip(parts, parts[1:])) if (found := rank.get(pair)) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [rank[parts[i], parts[i + 1]][1]]
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs and links between the parts that are left."""
        rank, n = self.rank, len(parts)
        after, before, size = [*range(1, n), -1], [*range(-1, n - 1)], [1] * n
        heap = [(found[0], i, 1, 1) for i, pair in enumerate(zip(parts, parts[1:])) if (found := rank.get(pair)) is not None]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i] if size[i] == left else -1
            if j < 0 or size[j] != right:  # one of the two has been merged since
                continue
            parts[i] = rank[parts[i], parts[j]][1]
            size[i], size[j] = left + right, 0
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := rank.get((parts[a], parts[b]))) is not None:
                    heappush(heap, (found[0], a, size[a], size[b]))
        return [p for p, k in zip(parts, size, strict=True) if k]

    def stream(self, word: bytes):
        """Yields the tokens of a word in order, holding the unstable end only."""
        kept: list[int] = []
        for at in range(0, len(word), self.block):
            kept += [self.single[b] for b in word[at : at + self.block]]
            if at + self.block >= len(word):
                kept[-1] = self.last[word[-1]]
                yield from self.merged(kept)
                return
            settled, tokens = len(kept) - self.lookahead, self.merged(kept[:])
            end = 0
            for token in tokens:
                if end + self.size[token] > settled:
                    break
                end += self.size[token]
                yield token
            kept = kept[end:]


class WordCutter:
    """Normalisation and words of a tokenizer file: NFC, lower case, white space dropped; letters, single numbers, the rest."""

    #: The parts of the tokenizer file that this class stands for.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, spec: dict, path: str):
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if spec["normalizer"] != self.NORMALIZER or steps[0].get("pattern", {}).get("Regex") != self.PATTERN or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a lower-casing tokenizer with word ends")
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = None

    def sections(self, text: str) -> list[str]:
        """The text around and of special tokens, which are found before anything is normalised."""
        return self.split.split(text) if self.split and any(s in text for s in self.special) else [text]

    def known(self, text: str) -> bool:
        """Whether all characters are known here; others are left to :meth:`library_words`."""
        return text.isascii() or not _unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any()

    def library_words(self, section: str) -> list[bytes]:
        """Words of a section by the library's own normaliser and splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        code = byte_alphabet()
        return [bytes(code[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(section))]

    def words(self, sections: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all normalised sections, starts and ends of their words there, and how many words each section has."""
        plain = [s if s.isascii() else unicodedata.normalize("NFC", s).replace(DOTTED_I, DOTTED_I_LOWER) for s in sections]
        points = _lower()[np.frombuffer("\n".join(plain).encode("utf-32-le"), "<u4")]
        bounds = np.concatenate([[0], np.cumsum([len(s) + 1 for s in plain])])
        kind = classes()[points]
        n = len(points)
        white = (kind == SPACE) | (kind == WHITE)
        before = np.concatenate([[WHITE], kind[:-1]]).astype(np.uint8) if n else kind
        start = ~white & ((kind != before) | (kind == NUMBER))
        quotes = np.flatnonzero((points == 0x27) & start)
        if len(quotes):
            padded = np.concatenate([points, [0, 0, 0]])
            short = np.isin(padded[quotes + 1], [ord(x) for x in SHORT_ENDINGS])
            long = np.zeros(len(quotes), bool)
            for a, b in LONG_ENDINGS:
                long |= (padded[quotes + 1] == ord(a)) & (padded[quotes + 2] == ord(b))
            hit = short | long
            start[quotes[hit] + 1] = False
            after = quotes[hit] + np.where(short[hit], 2, 3)
            after = after[after < n]
            start[after[~white[after]]] = True
        first = np.flatnonzero(start)
        stops = np.append(np.flatnonzero(start | white), n)
        last = stops[np.searchsorted(stops, first, "right")]
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return data, lead[first], lead[last], np.diff(np.searchsorted(first, bounds))


class StreamDecoder:
    """Text of token ids, as the file's decoder gives it; ids without a token have no text."""

    def __init__(self, spec: dict):
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        decoder = spec["decoder"]
        if decoder is None:  # the tokens themselves, joined by one space
            self.between, own = b" ", {i: t.encode() for i, t in tokens.items()}
        elif decoder["type"] == "ByteLevel":
            code = byte_alphabet()
            self.between, own = b"", {i: bytes(code[c] for c in t) for i, t in tokens.items()}
        else:
            raise ValueError(f"no decoder {decoder['type']}")
        self.bytes_of = own | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of a block of tokens go through the machine, which keeps an open character for the next block."""
        machine, out, begun = codecs.getincrementaldecoder("utf-8")("replace"), [], False
        for at in range(0, len(ids), DECODE_BLOCK):
            known = [x for x in map(self.bytes_of.get, ids[at : at + DECODE_BLOCK].tolist()) if x is not None]
            if known:
                out.append(machine.decode((self.between if begun else b"") + self.between.join(known)))
                begun = True
        out.append(machine.decode(b"", True))
        return "".join(out)


class Codec:
    """Encoder and decoder of one tokenizer file; keeps the ids of every distinct word that a worker has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cutter, self.encoder, self.decoder = WordCutter(spec, path), StreamEncoder(spec), StreamDecoder(spec)
        self.table = WordTable()
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of the word table for each word; new words are encoded."""
        row, fresh = self.table.rows_of(data, start, end)
        raw = data.tobytes()
        new = [list(self.encoder.stream(raw[a:b])) for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
        if self.table.size == len(new):
            self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in new], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter((t for x in new for t in x), np.int32)])
        return row

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the bounds of each text among them."""
        sections, special, odd, of = [], {}, {}, []
        for text in texts:
            known = self.cutter.known(text)
            for section in self.cutter.sections(text):
                of.append(len(sections))
                if section in self.cutter.special:
                    special[len(sections)] = self.cutter.special[section]
                elif not known:
                    odd[len(sections)] = self.cutter.library_words(section)
                sections.append("" if len(sections) in special or len(sections) in odd else section)
            of.append(-1)
        data, start, end, count = self.cutter.words(sections)
        row = self._rows(data, start, end)
        size = self.bounds[row + 1] - self.bounds[row]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.bounds[row] - place[:-1], size) + np.arange(place[-1])]
        ends = place[np.concatenate([[0], np.cumsum(count)])]  # of each section among the ids
        if special or odd:
            parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            parts = parts[: len(sections)]
            for i, token in special.items():
                parts[i] = np.array([token], np.int32)
            for i, words in odd.items():
                parts[i] = np.array([t for w in words for t in self.encoder.stream(w)], np.int32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        stops = np.flatnonzero(np.array(of) == -1) - np.arange(len(texts))  # sections before the end of each text
        return ids, np.concatenate([[0], ends[stops]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and tokenizer file."""
    return Codec(path)


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """An Arrow list of ids for each text."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
