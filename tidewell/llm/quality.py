"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a vector of transformed statistics (logs of counts, logits of shares, from all its bytes,
words and lines). The model has a mean and a shrinkage covariance for each class: the class's own covariance is
drawn towards the pooled one and that towards a scaled identity. Cholesky factors are taken once and cached in
the model; a score is the logistic of the difference of the two log densities (Mahalanobis terms and
determinants) plus the log prior odds.

Labels are learned from at most ``FIT_ROWS`` labelled rows, those of the smallest id hashes, and only from rows
whose crc32 of the id is not divisible by 5; label, language, source and id are never inputs of a score.

Defined results: null and empty texts have no evidence and score the prior; with labels of fewer than two
classes every score is the share of label 1 (0.5 without labels); repeated rows give equal rows; a null id is held
out of nothing (its remainder is null, so ``held_out`` is false); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import each, small_batches, table, trims

FIT_ROWS = 20_000
FOLDS = 5
ACCEPT = 0.3
TO_POOLED, TO_IDENTITY = 0.3, 0.05
SOFTEN = 4.0  # statistics of one text are dependent: log densities count as so many times fewer
SHORT = 120  # bytes, without white space, at which a text's evidence counts half, for a short text says little
FEATURES = 17

_CLASS = np.zeros(256, np.int64)
for _low, _high, _k in ((0x30, 0x39, 1), (0x41, 0x5A, 2), (0x61, 0x7A, 3), (0x80, 0xFF, 4)):
    _CLASS[_low : _high + 1] = _k
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 5
_SENTENCE = np.frombuffer(b".,;:?'\"-", np.uint8)


def _logit(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    other, digits, upper, lower, high, space = np.bincount(_CLASS, weights=bytes_, minlength=6)
    sentence = float(bytes_[_SENTENCE].sum())
    symbols = other - sentence
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:10]
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = raw.split(b"\n")
    repeated = len(lines) - len(set(lines))
    visible = len(raw) - space
    p = bytes_[bytes_ > 0] / max(1, len(raw))
    tailed = sum(1 for w in words if not (w[-1] in b".,;:?'\")" or w[-1:].isalnum() or w[-1] >= 0x80))
    capital = sum(1 for w in words if w[0] in range(0x41, 0x5B))
    return [
        math.log1p(n),
        math.log1p(lengths.mean() if n else 0.0),
        math.log1p(lengths.std() if n else 0.0),
        _logit(symbols, visible),
        _logit(sentence, visible),
        _logit(digits, visible),
        _logit(upper, upper + lower + high),
        _logit(high, visible),
        _logit(space, len(raw)),
        _logit(tailed, n),
        _logit(capital, n),
        _logit(len(counts), n),
        _logit(sum(top), n),
        _logit(top[0] if top else 0, n),
        _logit(repeated, len(lines)),
        math.log1p(n / len(lines)),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list | None = None
    factors: list | None = None  # inverses of the Cholesky factors
    logdets: list | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        length = np.expm1(x[:, 0]) * np.expm1(x[:, 1])  # words times their mean bytes
        odds = (density[1] - density[0]) / SOFTEN * length / (length + SHORT) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - centre) / scale
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    scatter = [(g - m).T @ (g - m) for g, m in zip(groups, means, strict=True)]
    pooled = sum(scatter) / len(z)
    factors, logdets = [], []
    for g, s in zip(groups, scatter, strict=True):
        cov = (1 - TO_POOLED) * s / len(g) + TO_POOLED * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.eye(x.shape[1]) * np.trace(cov) / x.shape[1]
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(x.shape[1]))
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Model(float(y.mean()), centre, scale, means, factors, logdets)


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    sample = labels.filter(F.col("quality").isin(0, 1) & (_remainder() != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    @trims
    def run(batches):
        for batch in batches:
            x = pa.array([statistics(t) for t in each(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), x], names=["doc_id", "quality", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("text").cast("string").alias("text"))
    # repeated ids are rows of their own: the bound is on rows
    with small_batches(docs.sparkSession):
        rows = joined.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(FIT_ROWS).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(np.asarray(x, float).reshape(-1, FEATURES), np.asarray(rows.column("quality").to_numpy(), int))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @trims
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in each(batch.column("text"))], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @trims
    def run(batches):  # the columns pass as they are, whatever their types
        for batch in batches:
            x = np.array([statistics(t) for t in each(batch.column("text"))], float).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.value.score(x) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
