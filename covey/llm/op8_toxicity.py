"""Toxicity by a weighted finite-state pattern grammar.

The lexical transducer maps words to symbols: INSULT with a weight, THREAT, TARGET,
NEGATION, REPORT or nothing.  Its insults, words and word beginnings, are learned
from labelled texts.  Three transducers read the symbols of a clause:

* the target machine tells whether a person was addressed a few words back,
* the negation machine whether something was negated a few words back,
* the reporting machine whether a verb of saying came before in the clause.

They are composed into one machine whose states are the pairs that can be reached
and whose outputs add up.  Each insult or threat becomes a matched pattern by the
output of the state it is read in: plain or aimed at somebody, negated or not,
reported or not.  A text's features are the weights of its matched clauses by
pattern, and a logistic regression weighs the patterns.

Learning takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hashes of their ids, and the lexicon the ``LEXICON`` most telling terms of at least
``LEAST_TOXIC`` toxic texts.  A labelled text's features leave out what it adds to
the lexicon itself.  Repeated label rows of an id count once (toxic if any is), null
ids and labels not at all; of documents with one id the first text in order teaches,
and all are scored.  Null and empty texts have no clauses and get the score of that;
a text of any length is read whole.  Without labels of both kinds every score is 0.
An empty table gives no rows.  Other columns are carried along; one called ``score``
is replaced by the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import _words

#: Labelled rows to learn from, and entries of the lexicon, at most.
TRAIN_ROWS, LEXICON = 20_000, 5_000
#: Toxic texts that a term of the lexicon occurs in, at least.
LEAST_TOXIC = 3
#: Bytes of the word beginnings that are candidates for the lexicon.
BEGINNINGS = [4, 5, 6, 7]
#: How many words after it a target or negation still counts.
TARGET_REACH, NEGATION_REACH = 4, 3

#: Words of the other machines, in English, German, French and Spanish.
TARGETS = ["you", "your", "yourself", "he", "she", "they", "them", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "te", "vous", "ils", "elles", "usted", "ustedes", "vosotros", "ellos"]
NEGATIONS = ["not", "no", "never", "nobody", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "tampoco"]
REPORTS = ["said", "says", "say", "called", "wrote", "reported", "claimed", "sagte", "sagt", "nannte", "schrieb", "dit", "disait", "dijo", "dice", "llamó"]
THREATS = ["kill", "hurt", "destroy", "shoot", "stab", "beat", "burn", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"]

CLAUSE_ENDS = b".,;:!?\n"
NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6
#: plain or aimed, asserted or negated, direct or reported; then how many matched, the largest weight, and threats.
N_FEATURES = 11


def _train_ids(labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _words.slices(batches, "text"):
        words = _words.split(batch.column("text"), _words.NOT_ALNUM, lower=True)
        counts = (Counter(), Counter())
        for d, toxic in enumerate(batch.column("toxic").to_pylist()):
            own = set(words.text(words.first[d], words.first[d + 1]))
            own |= {w[:n] + b"*" for w in own for n in BEGINNINGS if len(w) > n}
            counts[toxic > 0].update(own)
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """A cautious logarithm of how much more frequent a term is in toxic texts."""
    toxic, clean = np.maximum(toxic, 0) + 0.5, np.maximum(clean, 0) + 0.5
    return np.log(toxic / (n_toxic + 1)) - np.log(clean / (n_clean + 1)) - 1.5 * np.sqrt(1 / toxic + 1 / clean)


class Machine:
    """A deterministic transducer over symbols: ``step[state, symbol]`` is the next state, ``mark[state]`` what it puts out there."""

    def __init__(self, step: np.ndarray, mark: np.ndarray):
        self.step, self.mark = step, mark

    @classmethod
    def recent(cls, symbol: int, reach: int, mark: int) -> Machine:
        """Puts out ``mark`` while ``symbol`` was at most ``reach`` symbols back; state ``k`` above 0 has it ``reach - k`` symbols behind the last."""
        step = np.repeat(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], SYMBOLS, 1)
        step[:, symbol] = reach
        return cls(step, np.where(np.arange(reach + 1) > 0, mark, 0))

    @classmethod
    def seen(cls, symbol: int, mark: int) -> Machine:
        """Puts out ``mark`` once ``symbol`` has occurred."""
        step = np.repeat(np.arange(2)[:, None], SYMBOLS, 1)
        step[:, symbol] = 1
        return cls(step, np.array([0, mark]))

    def composed(self, other: Machine) -> Machine:
        """Both machines side by side, in the states that are reached; their outputs add up."""
        number, pairs, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in pairs:
            row = []
            for symbol in range(SYMBOLS):
                to = int(self.step[a, symbol]), int(other.step[b, symbol])
                if to not in number:
                    number[to] = len(pairs)
                    pairs.append(to)
                row.append(number[to])
            step.append(row)
        return Machine(np.array(step), np.array([self.mark[a] + other.mark[b] for a, b in pairs]))

    def idle(self, longest: int) -> np.ndarray:
        """The state after so many words without a symbol, up to ``longest``, from each state."""
        out = [np.arange(len(self.step))]
        for _ in range(longest):
            out.append(self.step[out[-1], NOTHING])
        return np.stack(out, 1)


def clause_machine() -> Machine:
    """Bit 1: aimed at somebody, bit 2: negated, bit 4: reported."""
    return Machine.recent(TARGET, TARGET_REACH, 1).composed(Machine.recent(NEGATION, NEGATION_REACH, 2)).composed(Machine.seen(REPORT, 4))


class Grammar:
    """The compiled machines; ``weights`` by term as learned, and without one toxic or clean text."""

    def __init__(self, terms: list[bytes], weights: np.ndarray):
        def hashes(words: list[bytes]) -> np.ndarray:
            data = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            return _words.hash_spans(data, ends - [len(w) for w in words], ends) if words else np.zeros(0, np.uint64)

        self.machine = clause_machine()
        self.idle = self.machine.idle(max(TARGET_REACH, NEGATION_REACH))  # later words without a symbol change nothing
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in (0, *BEGINNINGS):  # 0: whole words
            own = [i for i, t in enumerate(terms) if (t.endswith(b"*") and len(t) == n + 1 if n else not t.endswith(b"*"))]
            h = hashes([terms[i].removesuffix(b"*") for i in own])
            order = np.argsort(h)
            self.by_length.append((n, h[order], weights[:, own][:, order]))
        fixed = [(hashes([w.encode() for w in words]), code) for words, code in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))]
        self.fixed = np.concatenate([h for h, _ in fixed])
        self.codes = np.concatenate([np.full(len(h), code) for h, code in fixed])
        order = np.argsort(self.fixed)
        self.fixed, self.codes = self.fixed[order], self.codes[order]

    def symbols(self, words: _words.Words) -> tuple[np.ndarray, np.ndarray]:
        """The lexical transducer: a class for each word, and for insults a weight per variant."""
        n = len(words.hash)
        code, weight = np.zeros(n, np.int8), np.zeros((3, n))
        for size, known, weights in self.by_length:
            if not len(known):
                continue
            at = np.flatnonzero(words.end - words.start > size)
            h = _words.hash_spans(words.data, words.start[at], words.start[at] + size) if size else words.hash[at]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            code[at[hit]] = INSULT
            weight[:, at[hit]] = np.maximum(weight[:, at[hit]], weights[:, place[hit]])
        place = np.minimum(np.searchsorted(self.fixed, words.hash), len(self.fixed) - 1)
        hit = (self.fixed[place] == words.hash) & (code == 0)
        code[hit] = self.codes[place[hit]]
        weight[:, code == THREAT] = 1.0
        return code, weight

    def features(self, column: pa.Array, variant: np.ndarray) -> np.ndarray:
        """One row of features per text; ``variant`` picks the weights of each text."""
        words = _words.split(column, _words.NOT_ALNUM, lower=True)
        out = np.zeros((len(column), N_FEATURES))
        code, weight = self.symbols(words)
        ends = np.concatenate([[0], np.cumsum(np.isin(words.data, list(CLAUSE_ENDS)))])
        clause = ends[words.start]
        doc_of = np.repeat(np.arange(len(column)), np.diff(words.first))
        live = np.flatnonzero(code)
        step, mark, idle = self.machine.step.tolist(), self.machine.mark.tolist(), self.idle.tolist()
        longest = len(idle[0]) - 1
        before, last, state = (-1, -1), 0, 0
        for i, c, d, k in zip(live.tolist(), code[live].tolist(), doc_of[live].tolist(), clause[live].tolist(), strict=True):
            if (d, k) != before:  # a clause begins in the first state
                before, state = (d, k), 0
            else:
                state = idle[state][min(i - last - 1, longest)]
            pattern, last, state = mark[state], i, step[state][c]
            if c in (INSULT, THREAT):
                w = max(weight[variant[d], i], 0.0)
                out[d, pattern] += w
                out[d, 8] += w > 0
                out[d, 9] = max(out[d, 9], w)
                out[d, 10] += c == THREAT
        out[:, :9] = np.log1p(out[:, :9])
        return out


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "text"):
            toxic = batch.column("toxic").to_numpy()
            x = grammar.features(batch.column("text"), np.where(toxic > 0, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array((toxic > 0).astype(np.float64)), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    return run


def _scores(grammar: Grammar | None, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.slices(batches, "text"):
            if grammar is None:
                score = np.zeros(batch.num_rows)
            else:
                x = grammar.features(batch.column("text"), np.zeros(batch.num_rows, np.int64))
                score = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -50, 50)))
            rest = [c for c in batch.schema.names if c != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score)], [*rest, "score"])

    return run


def score_toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the column ``score``, in place of one of that name, learned from ``labels(doc_id, toxic)`` and the texts of ``train_docs(doc_id, text)``."""
    ids = F.broadcast(_train_ids(labels))  # no more than TRAIN_ROWS
    train = stored(train_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    by_label = {bool(r.toxic): r["count"] for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_toxic, n_clean = by_label.get(True, 0), by_label.get(False, 0)
    columns = [c for c in docs.columns if c != "score"]
    texts = docs.select(*columns)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in texts.schema) + ", score double"
    if not n_toxic or not n_clean:
        return texts.mapInArrow(_scores(None, np.zeros(0), 0.0), schema)
    counts = train.select("text", "toxic").mapInArrow(_term_counts, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= LEAST_TOXIC)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) - 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = counts.withColumn("odds", odds).filter("odds >= 1").orderBy(F.desc("odds"), "term").limit(LEXICON).collect()
    toxic, clean = (np.array([r[c] for r in chosen], np.float64) for c in ("toxic", "clean"))
    weights = np.stack([_odds(toxic, clean, n_toxic, n_clean), _odds(toxic - 1, clean, n_toxic, n_clean), _odds(toxic, clean - 1, n_toxic, n_clean)])
    grammar = Grammar([bytes(r.term) for r in chosen], weights)
    rows = train.select("text", "toxic").mapInArrow(_feature_rows(grammar), "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    model = LogisticRegression(maxIter=50, regParam=1e-3, standardization=True).fit(rows)
    return texts.mapInArrow(_scores(grammar, model.coefficients.toArray(), model.intercept), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from two thirds of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
