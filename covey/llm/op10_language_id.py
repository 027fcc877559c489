"""Language identification in two steps: the family, then the language in it.

Features are byte n-grams of the lower-cased text, hashed into a vector of fixed
length with logarithmic counts and unit norm.  Linear support vector machines
separate every two families, and every two languages of one family; votes, then
margins, decide.  The score is the logistic of the margins of both steps.

Learning takes ``TRAIN_PER_LANGUAGE`` rows of each language at most, and
``TRAIN_ROWS`` of all; those with the smallest hashes of id and text, equal rows once.  Nulls and
texts without a letter are ``und`` with score 0.  Null languages teach nothing, an
empty one is a language like others.  With nothing to learn from all are ``und``; a
single language is predicted for all other texts.  Repeated rows are judged one by
one.  A text of any length is read whole.  An empty table gives no rows; other
columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _words

#: Rows to learn from, of each language and of all, at most: their features come to the driver.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 1_000, 16_000
#: Texts whose features are computed at once.
SLICE_ROWS = 1_000
#: Length of the feature vector.
SLOTS = 2048
#: Lengths of the byte n-grams.
GRAMS = [1, 2, 3]

#: Families of languages; a language in none of them is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"],
    "uralic": ["fi", "et", "hu"],
    "indo-aryan": ["hi", "mr", "ne", "bn", "pa", "gu", "ur"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "semitic": ["ar", "he", "am", "mt"],
}


def family(language: str) -> str:
    """The family of a language."""
    return next((name for name, members in FAMILIES.items() if language in members), language)


def features(column: pa.Array) -> np.ndarray:
    """One row of hashed n-gram features per text."""
    data, offsets = _words.buffers(column)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint64)
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    out = np.zeros(len(column) * SLOTS)
    for n in GRAMS:
        count = len(data) - n + 1
        if count < 1:
            continue
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> np.uint64(48)).astype(np.int64) % SLOTS
        whole = owner[:count] == owner[n - 1 :]
        out += np.bincount((owner[:count] * SLOTS + slot)[whole], minlength=len(out))
    out = np.log1p(out.reshape(len(column), SLOTS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words.slices(batches, "text", 1 << 19, SLICE_ROWS):
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(features(batch.column("text")).astype(np.float32)), pa.list_(pa.float32()))], ["lang", "x"])


def train_ids(docs: DataFrame, eligible) -> DataFrame:
    """``doc_id, lang, text`` of at most TRAIN_PER_LANGUAGE eligible rows of each language and TRAIN_ROWS of all."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & eligible)
    known = known.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = {r.lang: r["count"] for r in known.select("lang", "h").distinct().groupBy("lang").count().collect()}  # a row for each language
    each = min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // max(len(sizes), 1))
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, (1.3 * each + 50) / n)).otherwise(share)
    # The hash thins each language to a few more rows than are wanted, the rest is cut by rank.
    some = known.filter(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    return some.withColumn("place", place).filter(F.col("place") <= each).select("doc_id", "lang", "text")


class Machines:
    """Pairwise linear machines between families and within them."""

    def __init__(self, languages: list[str], planes: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.members: dict[str, list[str]] = {}
        for lang in languages:
            self.members.setdefault(family(lang), []).append(lang)
        self.planes = planes

    def _decide(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner of every row by votes, then margins, and its smallest margin."""
        votes, margin, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            weights, bias = self.planes[a, b]
            m = x @ weights + bias  # positive: b
            for k, own in ((i, -m), (j, m)):
                votes[:, k] += own > 0
                margin[:, k] += own
                least[:, k] = np.minimum(least[:, k], own)
        best = np.array([int(np.lexsort((-margin[r], -votes[r]))[0]) for r in range(len(x))], np.int64)
        return best, least[np.arange(len(x)), best] if len(x) else np.zeros(0)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every row."""
        names = sorted(self.members)
        which, sure = self._decide(x, names)
        out, score = np.empty(len(x), object), 1 / (1 + np.exp(-4 * np.clip(sure, -10, 10)))
        for i, name in enumerate(names):
            rows = np.flatnonzero(which == i)
            own = sorted(self.members[name])
            best, margin = self._decide(x[rows], own)
            out[rows] = np.array(own, object)[best]
            score[rows] *= 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))
        return out, score


def plane(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent; positive for ``y`` = 1."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    rng, alpha, w = np.random.default_rng(0), np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x**2).sum(1) + 0.5 / cost
    for _ in range(rounds):
        for i in rng.permutation(len(x)).tolist():
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost) / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w[:-1], float(w[-1])


def fit(train: DataFrame) -> Machines | None:
    """The machines for ``train(lang, text)``, a bounded sample."""
    rows = train.select("lang", "text").mapInArrow(_feature_rows, "lang string, x array<float>").toArrow()  # a bounded sample
    known = np.array(rows["lang"].to_pylist(), str)
    languages = sorted(set(known.tolist()))
    if not languages:
        return None
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, SLOTS)
    groups: dict[str, list[str]] = {}
    for lang in languages:
        groups.setdefault(family(lang), []).append(lang)
    pairs = [((a, b), groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    pairs += [((a, b), [a], [b]) for members in groups.values() for a, b in combinations(sorted(members), 2)]
    planes = {}
    for key, left, right in pairs:
        own = np.flatnonzero(np.isin(known, left + right))
        planes[key] = plane(x[own], np.where(np.isin(known[own], right), 1.0, -1.0))
    return Machines(languages, planes)


def _predictions(machines: Machines | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "text", rows=SLICE_ROWS):
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            rows = np.flatnonzero(batch.column("letters").to_numpy(zero_copy_only=False)) if machines else []
            if len(rows):
                lang[rows], score[rows] = machines.predict(features(batch.column("text").take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, machines: Machines | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(_predictions(machines), "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = identify(docs, fit(train_ids(docs, fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
