"""Operators 11 to 13 against the tokenizer libraries and plain readings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from covey.llm import op11_bpe_codec, op12_periodic_runs, op13_token_alignment
from covey.llm.streaming_bpe import codec, sufficient_lookahead
from covey.llm.transducer import byte_alphabet

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = "abcdeéABCSΣİ''st  \n\t.,!<|>019ß日本́̈ﬁ½²\x85\xa0😀\x00Ᲊ"
CLASHING = "doc_id long, text string, row long, runs string, pairs int, ids string, n long, q long, start long"


def clashing(spark, docs):
    return spark.createDataFrame([(i, t, 1, "r", 2, "x", 3, 4, 5) for i, t in docs], CLASHING)


def some_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


# Operator 11


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab'st re", max_size=80), st.sampled_from(["<|endoftext|>", "x<|startoftext|>É", "don't'll", "''s"])), max_size=8))
def test_ids_and_text_are_the_library_s(texts):
    library = Tokenizer.from_file(WORDS)
    ids, bounds = codec(WORDS).encode(texts)
    for i, t in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == library.encode(t, add_special_tokens=False).ids
        assert codec(WORDS).decoder.decode(np.array(own, np.int64)) == library.decode(own, skip_special_tokens=False)


def test_emission_with_the_lookahead_gives_the_encoding_of_whole_words():
    encoder, rng = codec(WORDS).encoder, random.Random(4)
    whole = encoder.block
    parts = ["in", "the", "re", "an", "tion", "ing", "er", "st", "o", "a", "zz"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 900))).encode() for _ in range(40)] + [b"a" * 4000, b"ab" * 2000]
    for word in words:
        encoder.block = len(word)
        expected = list(encoder.stream(word))
        for block in (1, 3, 50) if len(word) < 1500 else (97,):
            encoder.block = block
            assert list(encoder.stream(word)) == expected
    encoder.block = whole
    assert encoder.lookahead == 667


def test_lookahead_of_a_short_merge_list():
    # ab|c may take b from ab only by merging bc first; what is before a is never touched.
    assert sufficient_lookahead([("b", "c"), ("a", "b")], len) == 2
    assert sufficient_lookahead([("a", "b")], len) == 1


def test_every_prefix_is_settled_behind_the_lookahead():
    encoder = codec(WORDS).encoder
    encode = lambda w: encoder.merged([encoder.single[b] for b in w])
    rng = random.Random(8)
    for _ in range(200):
        word = "".join(rng.choice(["in", "g", "an", "d", "the", "re", "s", "tion"]) for _ in range(400)).encode()
        at = rng.randint(700, len(word)) if len(word) > 700 else len(word)
        for ids, whole in ((encode(word[:at]), encode(word)),):
            end = 0
            for a, b in zip(ids, whole):
                end += encoder.size[a]
                assert a == b or end > at - encoder.lookahead


def test_byte_level_decoder_keeps_open_characters_between_blocks(monkeypatch):
    import json

    from covey.llm import streaming_bpe

    monkeypatch.setattr(streaming_bpe, "DECODE_BLOCK", 1)
    with open(BYTES, encoding="utf-8") as f:
        decoder = streaming_bpe.StreamDecoder(json.load(f))
    library = Tokenizer.from_file(BYTES)
    for ids in (library.encode("日本 😀 x").ids, [0, 224, 235, 50256, 168, 9_999_999], [], [235]):
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_codec_over_tables(spark):
    docs = [(1, "Hello World"), (1, "Hello World"), (None, None), (2, ""), (3, " \n"), (4, "x" * 3000 + " don't <|endoftext|>" * 200), *((9, t) for t in some_texts(1, 50))]
    df = clashing(spark, docs)
    library = Tokenizer.from_file(WORDS)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in docs]
    want = sorted(((i, x, library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(docs, ids)), key=str)
    got = op11_bpe_codec.encode_and_decode(df, WORDS, window=100).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == want
    back = op11_bpe_codec.decode(op11_bpe_codec.encode(df, WORDS), WORDS).collect()
    assert sorted((r.text for r in back)) == sorted(d for _, _, d in want)
    assert op11_bpe_codec.encode_and_decode(df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        codec(BYTES)


def test_op11_digests(spark, sf):
    rows = {r.doc_id: r for r in op11_bpe_codec.op11_bpe_codec(spark, sf).collect()}
    library = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


# Operator 12


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            root = w[i : i + q]
            if j - i + q >= max(6, 4 * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list, runs: list) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runny_texts(seed: int, n: int) -> list[list[str]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]
        w = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 400]))]
        for _ in range(rng.randint(0, 3) if len(w) > 8 else 0):
            at = rng.randint(0, len(w))
            w[at:at] = w[: rng.randint(1, max(1, len(w) // 5))] * rng.randint(3, 7)
        out.append(w)
    return out


def test_runs_equal_a_plain_reading_whole_and_in_tiles(spark):
    texts = [*runny_texts(3, 250), list("ab") * 300, ["x"] * 700, ["word"] * 5]
    docs = [*((i, " ".join(w)) for i, w in enumerate(texts)), (7, None), (None, " \t a\x0ba a a a a \n"), (7, "")]
    df = clashing(spark, docs)
    want = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(w)
        want.append((i, runs, collapsed(w, runs)))
    want.sort(key=str)
    for long_chars, tile in ((1 << 16, 1 << 15), (0, 16), (100, 64)):
        got = op12_periodic_runs.find_runs(df, long_chars, tile).collect()
        assert sorted(((r.doc_id, [(x.start, x.length, x.period) for x in r.runs or []], r.kept) for r in got), key=str) == want
    assert op12_periodic_runs.find_runs(df.limit(0)).count() == 0


def test_tiles_cover_all_octaves_and_overlap():
    for n in (0, 5, 6, 100, 5000, 70_000):
        plan = op12_periodic_runs.tile_plan(n, 64)
        for octave in op12_periodic_runs.octaves(n):
            own = sorted((a, b) for low, high, a, b in plan if low <= octave <= high)
            assert own[0][0] == 0 and own[-1][1] == n
            assert all(b - c >= 8 * octave for (_, b), (c, _) in zip(own, own[1:]))


def test_equal_hashes_of_other_words_are_found_out():
    tiles = op12_periodic_runs.Segments(np.array([1, 2, 3] * 6 + [9], np.uint64), np.array([0, 19]))
    assert tiles._checked(0, 0, 16, 3) == [(0, 0, 15, 3)]  # one word too many


def test_op12_equals_a_plain_reading(spark, sf):
    rows = {r.doc_id: r for r in op12_periodic_runs.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if n > 2500:
            continue  # the plain reading is too slow
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want = (d.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
        assert tuple(rows[d.doc_id]) == want


# Operator 13


def plain_alignment(docs: list) -> list[tuple]:
    a, b, code = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_alphabet()
    a.encode_special_tokens = True
    bytes_a = {v: bytes(code[c] for c in k) for k, v in a.get_vocab().items() if v != 50256}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    found, counts = [], Counter()
    for i, t in docs:
        ids_a, ids_b = a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t or "")
        links, groups = [], []
        if t and b"".join(bytes_b[x] for x in ids_b) == f" {t}".encode():
            x = y = end_a = end_b = 0
            own_a, own_b = [], []
            end_a, end_b = len(bytes_a[ids_a[0]]), len(bytes_b[ids_b[0]])
            while True:
                links.append((ids_a[x], ids_b[y]))
                to_a, to_b = end_a <= end_b, end_b <= end_a
                if to_a:
                    own_a.append(ids_a[x])
                    x += 1
                if to_b:
                    own_b.append(ids_b[y])
                    y += 1
                if to_a and to_b:
                    groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                    own_a, own_b = [], []
                    if x == len(ids_a):
                        break
                end_a += len(bytes_a[ids_a[x]]) if to_a else 0
                end_b += len(bytes_b[ids_b[y]]) if to_b else 0
        counts.update(links)
        found.append((i, len(ids_a) if links else 0, len(ids_b) if links else 0, groups, links))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((i, n, m, len(g), len(k), sum(counts[e] == most[e[1]] for e in k), sum(counts[e] for e in k), digest(g)) for i, n, m, g, k in found), key=str)


def test_alignment_over_tables(spark):
    docs = [*((i, t) for i, t in enumerate(some_texts(5, 300))), (1, None), (None, "x"), (None, None), (1, "<|endoftext|> <s> </s><unk>"), (5, " "), (5, "  "), (6, "a "), (6, "a ▁b"), (6, "word after word " * 60), (6, "word after word " * 60)]
    df, want = clashing(spark, docs), plain_alignment(docs)
    for chunk, heavy in ((1 << 20, 1 << 17), (50, 16), (200, 1)):
        got = op13_token_alignment.align_corpus(df, BYTES, PIECES, chunk, heavy).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert op13_token_alignment.align_corpus(df.limit(0), BYTES, PIECES).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(1, 9))
def test_pieces_of_the_merge_path(sizes_a, sizes_b, steps):
    a, b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total = max(a[-1], b[-1])  # both lists end at the same byte
    a, b = np.unique(np.append(a, total)), np.unique(np.append(b, total))
    i, j, shared_a, shared_b = op13_token_alignment.merge_ends(a, b, steps)
    ends = np.union1d(a, b)
    assert list(zip(i, j)) == list(zip(np.searchsorted(a, ends), np.searchsorted(b, ends)))
    assert shared_a.tolist() == np.isin(a, b).tolist() and shared_b.tolist() == np.isin(b, a).tolist()


def test_op13_equals_a_plain_reading(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op13_token_alignment.op13_token_alignment(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain_alignment(docs)
