"""Token counts by finite-state tokenizer compilation.

A text is cut into chunks.  Each chunk is summarised by the map from what comes
before it to what comes after it: the text up to its first synchronising point
(white space after something else starts a word whatever surrounds it), the
tokens between the first and the last such point, and the text from there on.
These maps are associative; a prefix scan over a text's chunks joins each open
end with the next open start, and only those short seams are tokenised again.

Rows keep their own count: repeated rows, repeated ids, null ids and extra
columns change nothing.  A null or empty text has no bytes and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from .transducer import counter

#: Characters in a chunk of a long text.
CHUNK_CHARS = 1 << 20


def _summaries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in _words.slices(batches, "text"):
            data, offsets = _words.buffers(batch.column("text"))
            whole = batch.column("chunks").to_numpy() == 1
            low, high = offsets[:-1].copy(), offsets[1:].copy()
            heads, tails = [""] * batch.num_rows, [None] * batch.num_rows
            for i in np.flatnonzero(~whole).tolist():
                text = data[low[i] : high[i]]
                white = np.isin(text, list(_words.WHITESPACE))
                sync = np.flatnonzero(white[1:] & ~white[:-1]) + 1
                if len(sync):
                    a, b = sync[0], sync[-1]
                    heads[i], tails[i] = text[:a].tobytes().decode(), text[b:].tobytes().decode()
                    low[i], high[i] = low[i] + a, low[i] + b
                else:
                    heads[i], high[i] = text.tobytes().decode(), low[i]
            if whole.all():
                tokens = machine.counts(data, offsets)
            else:
                middle = np.concatenate([data[a:b] for a, b in zip(low, high, strict=True)])
                tokens = machine.counts(middle, np.concatenate([[0], np.cumsum(high - low)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("chunk"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(heads, pa.string()), pa.array(tails, pa.string())],
                ["row", "doc_id", "chunk", "n_bytes", "tokens", "head", "tail"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary file, readable on
    every executor.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = (
        rows.withColumn("chunks", F.expr(f"cast(greatest(1, ceil(length(text) / {chunk_chars})) as int)"))
        .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("text", F.expr(f"if(chunks = 1, text, substring(text, chunk * {chunk_chars} + 1, {chunk_chars}))"))
        .select("row", "doc_id", "chunk", "chunks", "text")
    )
    maps = chunks.mapInArrow(_summaries(tokenizer), "row long, doc_id long, chunk int, n_bytes long, tokens long, head string, tail string")
    # The scan: an open end takes the next chunk's head; a chunk without a synchronising point is all head.
    scan = """
        aggregate(
          array_sort(ends),
          named_struct('open', '', 'seams', cast(array() as array<string>)),
          (acc, x) -> if(x.tail is null,
            named_struct('open', acc.open || x.head, 'seams', acc.seams),
            named_struct('open', x.tail, 'seams', array_append(acc.seams, acc.open || x.head))),
          acc -> filter(array_append(acc.seams, acc.open), s -> s <> ''))"""
    totals = maps.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("tokens").alias("tokens"),
        F.collect_list(F.when(F.col("tail").isNotNull() | (F.col("head") != ""), F.struct("chunk", "head", "tail"))).alias("ends"),
    )
    joined = totals.select("row", "doc_id", "n_bytes", "tokens", F.expr(scan).alias("seams"))
    # Every row goes on with its own count; only rows with seams have more texts to count.
    parts = joined.select("row", "doc_id", "n_bytes", "tokens", F.explode_outer("seams").alias("seam"))
    counted = parts.mapInArrow(_seam_counts(tokenizer), "row long, doc_id long, n_bytes long, tokens long, seam_tokens long")
    out = counted.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), (F.first("tokens") + F.sum("seam_tokens")).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _seam_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "seam"):
            data, offsets = _words.buffers(batch.column("seam"))
            tokens = counter(path).counts(data, offsets) if len(data) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_bytes", "tokens")), pa.array(tokens)], ["row", "doc_id", "n_bytes", "tokens", "seam_tokens"])

    return run


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
