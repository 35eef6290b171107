"""Toxicity by multiple-instance learning: a document is toxic if one sentence is.

A sentence has a logistic score, the document's score is their noisy-or, and only the
documents' labels are learned from. The sentence scores then locate the offence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, fold_of, hashed_sample, keep_rows, rows_of

FOLDS, HELD_OUT = 5, 0
# The sample that is learned from: documents per label, and the longest one taken.
SAMPLE_PER_LABEL, SAMPLE_CHARS = {1: 1500, 0: 3000}, 10_000
BUCKETS, ROUNDS, RATE = 1 << 18, 80, 0.5
# The logit of a sentence without a telling word, low so that texts of thousands of them stay clean.
BIAS = -11.0
# Features whose presence in a document has at least this chi-square with the label are learned from.
ASSOCIATION = 30.0
KEPT_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Buckets of the word, its beginnings and its end."""
    parts = {f"={word}", *(f"{n}<{word[:n]}" for n in (3, 4, 5) if len(word) > n), f">{word[-4:]}"}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in sorted(parts)]


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def scorer(self):
        return SentenceScorer(self)


class SentenceScorer(dict):
    """From a word to the sum of its features' weights; a word counts once in a sentence."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        value = float(self.model.weights[word_features(word)].sum())
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences with a word, and their scores."""
        spans, sums = [], []
        for m in _SENTENCE.finditer(text or ""):
            words = set(_WORD.findall(m[0].lower()))
            if words:
                spans.append(m.span())
                sums.append(sum(map(self.__getitem__, sorted(words))))
        z = np.clip(np.array(sums, float) + self.model.bias, -40, 40)
        return spans, 1 / (1 + np.exp(-z))


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-15)).sum()))


def _association(having: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By feature: chi-square of a document having it and being toxic, from how many documents and toxic ones have it."""
    n, share = len(y), y.mean()
    spread = having * share * (1 - share) * (1 - having / n)
    return np.where(having > 0, (toxic - having * share) ** 2 / np.maximum(spread, 1e-9), 0)


def train(texts: list[str], labels: list[int]) -> Model:
    """Gradient steps on the likelihood of the documents' labels under noisy-or."""
    known: dict[str, array] = {}
    features, feature_counts, sentence_doc = array("i"), array("i"), array("i")
    having, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for doc, text in enumerate(texts):
        begin = len(features)
        for m in _SENTENCE.finditer(text):
            before = len(features)
            for word in set(_WORD.findall(m[0].lower())):
                if word not in known:
                    known[word] = array("i", word_features(word))
                features += known[word]
            if len(features) > before:
                feature_counts.append(len(features) - before)
                sentence_doc.append(doc)
        has = np.unique(np.array(features[begin:], np.int32))
        having[has] += 1
        toxic[has] += labels[doc]
    known.clear()
    model = Model(BIAS, np.zeros(BUCKETS, np.float32))
    y = np.array(labels, float)
    if not features or len(set(labels)) < 2:
        model.bias = -40.0
        return model
    feature, doc = np.frombuffer(features, np.int32), np.array(sentence_doc)
    telling = (_association(having, toxic, y) >= ASSOCIATION)[feature]
    feature, sentence = feature[telling], np.repeat(np.arange(len(doc), dtype=np.int32), feature_counts)[telling]
    del features, telling
    n, seen = len(doc), np.ones(BUCKETS)
    for _ in range(ROUNDS):
        z = np.clip(np.bincount(sentence, model.weights[feature], n) + model.bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(doc, np.log1p(-p), len(y)))  # probability that no sentence offends
        blame = np.where(y == 1, clean / np.maximum(1 - clean, 1e-12), -1.0)
        step = p * np.minimum(blame, 1e3)[doc]
        slope = np.bincount(feature, step[sentence], BUCKETS)
        seen += slope ** 2
        model.weights += (RATE * slope / np.sqrt(seen)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample, chosen by a hash, of labelled rows not held out."""
    known = (labels.where(F.col("toxic").isin(*SAMPLE_PER_LABEL) & F.col("doc_id").isNotNull())
             .where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in SAMPLE_PER_LABEL}
    parts = [hashed_sample(known.where(F.col("toxic") == label), "doc_id", size, total.get(label, 0))
             for label, size in SAMPLE_PER_LABEL.items()]
    sample = parts[0].union(parts[1])
    rows = (docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
            .join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").toArrow())
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for every row of ``docs``.

    ``offending`` are the spans (code points) of sentences that score 0.5 or more, with
    their scores. A null text, or one without a word, scores 0. Other columns of
    ``docs`` are left out, repeated rows stay, an empty table gives no rows.
    """
    def start():
        scorer = model.scorer()

        def work(batch):
            ids, texts, held = rows_of(batch, "doc_id", "text", "held_out")
            scores, spans = [], []
            for text in texts:
                where, p = scorer.sentences(text)
                scores.append(noisy_or(p))
                spans.append([{"start": a, "end": b, "score": float(s)} for (a, b), s in zip(where, p) if s >= 0.5])
            return {"doc_id": ids, "held_out": held, "score": scores,
                    "predicted": [int(s >= 0.5) for s in scores], "offending": spans}

        return work

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return arrow_map(given, start, "doc_id long, held_out boolean, score double, predicted int, "
                                   "offending array<struct<start: int, end: int, score: double>>")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted not to be toxic."""
    model = fit(docs, labels)

    def start():
        scorer = model.scorer()

        def work(batch: pa.RecordBatch) -> list[bool]:
            return [noisy_or(scorer.sentences(t)[1]) < 0.5 for t in batch.column("text").to_pylist()]

        return work

    return keep_rows(docs, start)
