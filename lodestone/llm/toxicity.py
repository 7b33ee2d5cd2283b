"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. A sentence's probability is logistic in the words and word beginnings that
it has, and the document's is their noisy-or, 1 - prod(1 - p). The weights are trained from document labels alone, so the
sentences at fault are found without labels of their own.

The model is fitted on at most ``max_docs`` labelled documents, those with the smallest hash of the id;
word statistics of that sample are counted on the executors. Scoring covers every row.

Defined results: a null or empty text, or one without a sentence, counts as one sentence without words.
Labels that are null are left out; of several labels of a document the largest holds. Without any label
the model has no words and calls nothing toxic. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, remainder, scratch, ship, slices, table

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n\r]+")


BEGINNINGS = range(4, 9)
CACHE_ENTRIES = 200_000


def traits(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, so that all words on one stem share what is learned."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def softplus(z):
    return np.logaddexp(0.0, z)


@dataclass
class NoisyOr:
    bias: float = math.log(0.01 / 0.99)
    weights: dict[str, float] = field(default_factory=dict)
    held: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)  # a word's known features

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "held": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        if len(self.held) > CACHE_ENTRIES:
            self.held.clear()
        found = self.held[word] = tuple(t for t in traits(word) if t in self.weights)
        return found

    def _logit(self, sentence: str) -> float | None:
        """The logit of a lower-case sentence; None if it has no known feature."""
        get, own = self.held.get, set()
        for w in WORD.findall(sentence):
            found = get(w)
            if found is None:
                found = self._known(w)
            if found:
                own.update(found)
        return self.bias + math.fsum(sorted(self.weights[t] for t in own)) if own else None

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(begin, end, logit) of each sentence, in code points."""
        found = ((m, self._logit(m[0].lower())) for m in SENTENCE.finditer(text or ""))
        return [(m.start(), m.end(), self.bias if z is None else z) for m, z in found]

    def score(self, text: str | None) -> float:
        """The noisy-or over the sentences; sentences without a known feature count by their number."""
        plain, log_none, logit = 0, 0.0, self._logit
        for s in SENTENCE.findall((text or "").lower()):
            z = logit(s)
            if z is None:
                plain += 1
            else:
                log_none -= _softplus(z)
        if not plain and not log_none:
            plain = 1
        return -math.expm1(log_none - plain * _softplus(self.bias))


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def fit(bags: list[tuple[int, int, list[list[int]]]], words: list[str], steps: int = 600, rate: float = 0.1, decay: float = 1e-4) -> NoisyOr:
    """Maximum likelihood of the noisy-or by Adam. bags: (label, sentences, word numbers of those that have any)."""
    if not bags:
        return NoisyOr()
    y = np.array([b[0] for b in bags], float)
    owner, rows, cols, plain = [], [], [], np.zeros(len(bags))
    for d, (_, n, hits) in enumerate(bags):
        plain[d] = max(n, 1) - len(hits)
        for h in hits:
            rows += [len(owner)] * len(h)
            cols += h
            owner.append(d)
    owner, rows, cols = (np.array(x, np.int64) for x in (owner, rows, cols))
    theta = np.zeros(len(words) + 1)
    theta[-1] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) - math.log(max(1.0, (plain + 1).mean()))
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, theta[cols], minlength=len(owner))
        none = -plain * softplus(theta[-1]) - np.bincount(owner, softplus(z), minlength=len(bags))
        none = np.minimum(none, -1e-9)
        #: derivative of the log likelihood by the log of "no sentence is toxic"
        pull = np.where(y == 1, np.exp(none) / np.expm1(none), 1.0)
        p = 1 / (1 + np.exp(-z))
        dz = -p * pull[owner]
        grad = np.append(np.bincount(cols, dz[rows], minlength=len(words)), (dz.sum() - (plain * pull).sum() / (1 + math.exp(-theta[-1]))))
        grad = grad / len(bags)
        grad[:-1] -= decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return NoisyOr(float(theta[-1]), {w: float(x) for w, x in zip(words, theta) if abs(x) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_words: int = 512, min_docs: int = 6, min_z: float = 5.0) -> NoisyOr:
    """Fit on a bounded sample. docs: doc_id, text. labels: doc_id, toxic."""
    ship(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_docs rows of two numbers are broadcast.
    sample = scratch(text.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")
    word_schema = pa.schema([("word", pa.string()), ("toxic", pa.int32())])

    def words_of(batches):
        for b in slices(batches):
            w, y = [], []
            for t, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                own = {x for word in set(WORD.findall(t.lower())) for x in traits(word)}
                w += own
                y += [label] * len(own)
            yield batch({"word": w, "toxic": y}, word_schema)

    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not pos or pos == n:
        discard(sample)
        return NoisyOr() if not pos else NoisyOr(bias=2.0)
    rate = pos / n
    table_of = sample.select("text", "toxic").mapInArrow(words_of, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    z = (F.col("k") - F.col("n") * F.lit(rate)) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    chosen_words = [r["word"] for r in table_of.filter(F.col("n") >= min_docs).withColumn("z", z).filter(F.abs("z") >= min_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words).collect()]
    number = {w: i for i, w in enumerate(chosen_words)}
    bag_schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("n", pa.int32()), ("hits", pa.list_(pa.list_(pa.int32())))])

    def bags_of(batches):
        for b in slices(batches):
            count, hits = [], []
            for t in b.column("text").to_pylist():
                found = SENTENCE.findall(t.lower())
                count.append(len(found))
                own = [sorted({number[t] for w in WORD.findall(s) for t in traits(w) if t in number}) for s in found]
                hits.append([h for h in own if h])
            yield batch({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "n": count, "hits": hits}, bag_schema)

    bags = sample.mapInArrow(bags_of, "doc_id long, toxic int, n int, hits array<array<int>>").collect()
    discard(sample)
    return fit([(r["toxic"], r["n"], r["hits"]) for r in sorted(bags)], chosen_words)


def score_documents(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            yield batch({"doc_id": b.column(0), "score": [model.score(t) for t in b.column(1).to_pylist()]}, schema)

    return src.mapInArrow(run, "doc_id long, score double")


def locate_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """(doc_id, begin, end, score): the sentences at or above the threshold, in code points."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            rows = [(d, x, y, 1 / (1 + math.exp(-z))) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x, y, z in model.sentences(t)]
            rows = [r for r in rows if r[3] >= threshold]
            yield batch({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema)

    return src.mapInArrow(run, "doc_id long, begin int, end int, score double")


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array([model.score(t) < threshold for t in pc.cast(b.column(at), pa.string()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
