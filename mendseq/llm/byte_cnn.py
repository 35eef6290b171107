"""Language identification with a small convolutional network over bytes.

Filters of several widths slide over embedded bytes; each filter's largest value in a
window goes to a softmax over the languages. Trained in numpy on labelled texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, fold_of, keep_rows, rows_of
from mendseq.session import materialize

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# The sample that is learned from: documents per language, the longest one taken, windows per document.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, SAMPLE_WINDOWS = 800, 20_000, 4
THINNED = 2
# Languages whose counts are broadcast.
FEW_LANGUAGES = 10_000
WINDOW, EMBEDDING, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 4, 64, 0.003
# Windows that one product takes.
AT_ONCE = 256
# A document below this score is in no language for the pipeline.
LEAST_SCORE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
_SPAN = max(WIDTHS)
_NAMES = ("embedding", "filters", "bias", "dense", "offset")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased text's bytes in rows of WINDOW, padded with 0, and the bytes in each row."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, WINDOW), np.minimum(len(data) - WINDOW * np.arange(n), WINDOW)


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, rng: np.random.Generator) -> None:
        total = len(WIDTHS) * FILTERS
        mask = np.zeros((_SPAN, EMBEDDING, total))
        for k, width in enumerate(WIDTHS):
            mask[:width, :, k * FILTERS:(k + 1) * FILTERS] = 1
        shapes = {"embedding": (256, EMBEDDING), "filters": (_SPAN, EMBEDDING, total), "dense": (total, len(self.languages))}
        self.weights = {n: rng.normal(0, 0.3, s).astype(np.float32) for n, s in shapes.items()}
        self.weights["filters"] *= mask.astype(np.float32)
        self.weights |= {"bias": np.zeros(total, np.float32), "offset": np.zeros(len(self.languages), np.float32),
                         "mask": mask.astype(np.float32)}

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Largest filter values of each window, and on demand where they are."""
        w = self.weights
        padded = np.pad(rows, ((0, 0), (0, _SPAN - 1)))
        spans = np.lib.stride_tricks.sliding_window_view(padded, _SPAN, axis=1)
        x = w["embedding"][spans].reshape(len(rows) * WINDOW, _SPAN * EMBEDDING)
        values = (x @ w["filters"].reshape(_SPAN * EMBEDDING, -1)).reshape(len(rows), WINDOW, -1)
        if not where:
            return np.maximum(values.max(1) + w["bias"], 0), None, None
        at = values.argmax(1)
        best = np.take_along_axis(values, at[:, None], 1)[:, 0] + w["bias"]
        return np.maximum(best, 0), at, padded

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows)[0] @ self.weights["dense"] + self.weights["offset"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def slopes(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(rows)
        top, at, padded = self.pooled(rows, where=True)
        z = top @ w["dense"] + w["offset"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ w["dense"].T) * (top > 0)
        spans = at[:, :, None] + np.arange(_SPAN)  # window, filter, place
        letters = padded[np.arange(n)[:, None, None], spans]
        x = w["embedding"][letters]
        filters = np.einsum("nf,nfse->sef", back, x) * w["mask"]
        into = np.einsum("nf,sef->nfse", back, w["filters"])
        embedding = np.zeros_like(w["embedding"])
        np.add.at(embedding, letters.ravel(), into.reshape(-1, EMBEDDING))
        return {"dense": top.T @ p, "offset": p.sum(0), "bias": back.sum(0), "filters": filters, "embedding": embedding}

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): the mean over a text's windows, each by its bytes."""
        judged: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts))
        rows: list[np.ndarray] = []
        weight: list[np.ndarray] = []
        owner: list[int] = []

        def take() -> None:
            if rows:
                all_rows, shares = np.concatenate(rows), np.concatenate(weight)
                own = np.repeat(owner, [len(r) for r in rows])
                for s in range(0, len(all_rows), AT_ONCE):
                    part = slice(s, s + AT_ONCE)
                    np.add.at(sums, own[part], self.probabilities(all_rows[part]) * shares[part, None])
                np.add.at(sizes, own, shares)
                rows.clear(), weight.clear(), owner.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if text and self.languages and _LETTER.search(text):
                cut, n = windows(text)
                rows.append(cut), weight.append(n), owner.append(i)
                waiting += len(cut)
                if waiting > 4096:
                    take()
                    waiting = 0
        take()
        for i in np.flatnonzero(sizes):
            best = int(sums[i].argmax())
            judged[i] = (self.languages[best], float(min(1.0, sums[i, best] / sizes[i])))
        return judged


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """Adam steps over windows of the texts; the same texts give the same model."""
    model = Model(sorted(set(languages)))
    if not model.languages:
        return model
    rng = np.random.default_rng(seed)
    model.start(rng)
    number = {name: i for i, name in enumerate(model.languages)}
    rows, labels = [], []
    for text, name in zip(texts, languages):
        cut, n = windows(text)
        cut = cut[n >= min(WINDOW // 4, n[0])]
        cut = cut[np.linspace(0, len(cut) - 1, min(len(cut), SAMPLE_WINDOWS)).astype(int)]
        rows.append(cut)
        labels += [number[name]] * len(cut)
    x, y = np.concatenate(rows), np.array(labels)
    first = {n: np.zeros_like(model.weights[n]) for n in _NAMES}
    second = {n: np.zeros_like(model.weights[n]) for n in _NAMES}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(x), BATCH):
            step += 1
            part = order[s:s + BATCH]
            for n, g in model.slopes(x[part], y[part]).items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                model.weights[n] -= (rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame) -> Model:
    """Learns from a bounded sample, chosen by a hash, of rows that name their language and aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS)) \
        .where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    # A language's rows are thinned by their hash before they meet, to twice the sample.
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() <= FEW_LANGUAGES:
        counts = F.broadcast(counts)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (known.select("lang", "doc_id").join(counts, "lang").where(chance * F.col("n") < THINNED * SAMPLE_PER_LANGUAGE)
           .withColumn("place", F.row_number().over(by_hash))
           .where(F.col("place") <= SAMPLE_PER_LANGUAGE).select("doc_id").distinct())
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "lang", "text")])
    return train(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    no labelled row was learned from. Other columns are left out, repeated rows stay,
    an empty table gives no rows.
    """
    def start():
        def work(batch):
            ids, texts, held = rows_of(batch, "doc_id", "text", "held_out")
            found = model.judge(texts)
            return {"doc_id": ids, "held_out": held, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return arrow_map(given, start, "doc_id long, held_out boolean, lang_pred string, score double")


def in_a_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in one of the languages learned; all are kept if none was."""
    model = fit(docs)

    def start():
        def work(batch: pa.RecordBatch) -> list[bool]:
            if not model.languages:
                return [True] * batch.num_rows
            return [name != UNKNOWN and p >= LEAST_SCORE for name, p in model.judge(batch.column("text").to_pylist())]

        return work

    return keep_rows(docs, start)
