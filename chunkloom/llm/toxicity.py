"""Toxicity by multiple-instance learning.

Only documents have labels, sentences none. A sentence's score is a logistic function of the words
in it that the model knows; a document's is the noisy-or of its sentences' scores and a leak:
``1 - (1 - leak) * product(1 - sentence)``. The words' weights, the bias and the leak are fitted to
document labels by gradient steps through the noisy-or. Sentences without a known word score 0, so a
long document is no likelier toxic for its length. The highest sentence locates the offence.

The model is fitted on the driver to a bounded sample of labelled rows, the smallest hashes of
doc_id first: MAX_ROWS rows and MAX_CHARS characters at most. Words are admitted that far more toxic
documents hold than chance would have it. Scores read the text only, and all of it.

Defined results: a null or empty text scores the leak, with no sentence located; labels other than
0 and 1, or null ones, are not learnt from; a doc_id labelled twice counts as toxic if any label
says so; without labels of both kinds every document scores the share of toxic labels; repeated rows
stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of as _kind
from .common import small as _small
from .common import numbered, tidy, trim

MAX_ROWS, MAX_CHARS, MAX_WORDS = 12_000, 40_000_000, 20_000
STEPS, RATE, DECAY = 300, 0.1, 1e-3
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?|\n]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    leak: float = 0.0

    def sentence(self, words: set[str]) -> float:
        known = words & self.weights.keys()
        return 1 / (1 + math.exp(-self.bias - math.fsum(self.weights[w] for w in sorted(known)))) if known else 0.0

    def score(self, text: str) -> tuple[float, int | None, int | None, float | None]:
        """The document's score; start, end (code points) and score of its worst sentence."""
        lowered = text.lower()
        if self.weights.keys().isdisjoint(WORDS.findall(lowered)):
            return self.leak, None, None, None
        # lower() may lengthen a text; sentences are cut in the text itself
        clean, worst = 0.0, (0.0, None, None)
        for m in SENTENCES.finditer(text):
            p = self.sentence(set(WORDS.findall(m[0].lower())))
            if p:
                clean += math.log1p(-min(p, 1 - 1e-12))
                if p > worst[0]:
                    worst = (p, m.start(), m.end())
        return 1 - (1 - self.leak) * math.exp(clean), worst[1], worst[2], worst[0] or None


def _tail(k: int, n: int, p: float) -> float:
    """An upper bound (Chernoff) of the chance of k or more of n at rate p; as a logarithm."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def objective(theta: np.ndarray, labels: np.ndarray, doc: np.ndarray, inst: np.ndarray, word: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log loss of documents' noisy-or scores, with a pull of weights to 0, and its gradient. theta: a weight
    for each word, the bias, the leak's log odds; doc: the document of each sentence; inst, word: the
    words of each sentence."""
    n, m = len(labels), len(theta) - 2
    z = theta[m] + np.bincount(inst, theta[:m][word], len(doc)) if len(doc) else np.zeros(0)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    leak = 1 / (1 + math.exp(-theta[m + 1]))
    clean = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
    score = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    loss = -float(np.where(labels > 0, np.log(score), np.log1p(-score)).mean()) + DECAY / (2 * n) * float((theta[:m] ** 2).sum())
    # d loss / d log(1 - score), by document; d log(1 - p) / dz = -p
    pull = np.where(labels > 0, (1 - score) / score, -1.0) / n
    back = -pull[doc] * p if len(doc) else np.zeros(0)
    return loss, np.concatenate([np.bincount(word, back[inst], m) + DECAY * theta[:m] / n, [back.sum(), -pull.sum() * leak]])


def descend(theta: np.ndarray, *data: np.ndarray) -> np.ndarray:
    g1, g2 = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        _, grad = objective(theta, *data)
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        theta = theta - RATE * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
    return theta


def fit(rows: list[tuple[str, int]], max_words: int = MAX_WORDS) -> Model:
    """rows: text, label 0 or 1. Of the words that toxic documents hold more often than chance allows, the
    max_words most significant ones get weights; all stay, those below 0 too, so the model that scores is
    the one that was fitted."""
    labels = np.array([y for _, y in rows], float)
    rate = float(labels.mean()) if len(rows) else 0.0
    if not 0 < rate < 1:
        return Model(leak=rate)
    held, toxic = Counter(), Counter()
    for text, y in rows:
        words = set(WORDS.findall(text.lower()))
        held.update(words)
        if y:
            toxic.update(words)
    bar = -math.log(20.0 * max(1, len(held)))
    found = sorted((_tail(k, held[w], rate), w) for w, k in toxic.items() if k >= 3)
    names = [w for t, w in found if t < bar][:max_words]
    place = {w: i for i, w in enumerate(names)}
    # one instance for each sentence with a known word
    doc, inst, word = [], [], []
    for d, (text, _) in enumerate(rows):
        if place.keys().isdisjoint(WORDS.findall(text.lower())):
            continue
        for s in SENTENCES.findall(text):
            if known := place.keys() & WORDS.findall(s.lower()):
                word += [place[w] for w in sorted(known)]
                inst += [len(doc)] * len(known)
                doc.append(d)
    doc, inst, word = (np.array(x, np.int64) for x in (doc, inst, word))
    weights = np.array([min(4.0, math.log((toxic[x] + 0.5) / (held[x] - toxic[x] + 0.5)) - math.log(rate / (1 - rate))) for x in names])
    theta = descend(np.concatenate([weights, [-1.0, math.log(0.02 / 0.98)]]), labels, doc, inst, word)
    m = len(names)
    return Model({x: float(v) for x, v in zip(names, theta)}, float(theta[m]), float(1 / (1 + math.exp(-theta[m + 1]))))


def held_out(c: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where(F.length("text") <= max_chars // 16)
    got, chars = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "text").limit(max_rows).toLocalIterator():
        chars += len(r["text"])
        if chars > max_chars:
            break
        got.append((r["text"], int(r["toxic"])))
    model = fit(got)
    got.clear()
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, worst_start, worst_end, worst_score."""
    names = ["doc_id", "score", "worst_start", "worst_end", "worst_score"]
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            rows = [model.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, score double, worst_start long, worst_end long, worst_score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; all columns stay."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            yield b.filter(pa.array([model.score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    docs = numbered(docs)
    return docs.mapInArrow(tidy(run), docs.schema).toDF(*names)


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
