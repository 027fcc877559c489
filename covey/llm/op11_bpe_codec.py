"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Every text is normalised, cut into words and encoded in the task that reads it;
nothing is shuffled.  See :mod:`covey.llm.streaming_bpe` for the machines.  A
text is handled in windows that end at white space, so what a worker holds does
not grow with a text, but for its ids and for stretches without white space.

A null or empty text, or one of white space only, has no ids and decodes to the
empty text.  Repeated rows, repeated and null ids stay as they are, one row each;
an empty table gives an empty one.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from .streaming_bpe import codec, id_lists

#: Characters encoded at once inside a task.
WINDOW_CHARS = 1 << 20


def windows(text: str, size: int = WINDOW_CHARS) -> Iterator[str]:
    """A text in windows of about ``size`` characters; words, characters and special tokens never cross white space."""
    at = 0
    while len(text) - at > size:
        to = next((i for i in range(at + size, len(text)) if text[i] in " \t\n\r"), len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def _encoded(path: str, batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    machine = codec(path)
    for batch in _words.slices(batches, "text"):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        if len(texts) == 1 and len(texts[0]) > window:
            ids = np.concatenate([machine.encode([part])[0] for part in windows(texts[0], window)])
            bounds = np.array([0, len(ids)])
        else:
            ids, bounds = machine.encode(texts)
        yield batch.column("doc_id"), ids, bounds


def _named(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column)


def encode(docs: DataFrame, tokenizer: str, window: int = WINDOW_CHARS) -> DataFrame:
    """``doc_id, ids`` of ``docs(doc_id, text)``; ``tokenizer`` is the path of a BPE file with word ends, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, bounds in _encoded(tokenizer, batches, window):
            yield pa.RecordBatch.from_arrays([doc_id, id_lists(ids, bounds)], ["doc_id", "ids"])

    return _named(docs, "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of ``rows(doc_id, ids)``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(tokenizer).decoder
        for batch in batches:
            texts = [machine.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _named(rows, "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, tokenizer: str, window: int = WINDOW_CHARS) -> DataFrame:
    """``doc_id, ids, decoded``: :func:`encode` and :func:`decode` of its ids in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(tokenizer).decoder
        for doc_id, ids, bounds in _encoded(tokenizer, batches, window):
            texts = [machine.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, id_lists(ids, bounds), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return _named(docs, "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the vocabulary with word ends and back."""
    import public_tokenizers

    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
