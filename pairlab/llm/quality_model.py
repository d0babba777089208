"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1 outside the held-out fold; unlabelled text is a hash sample of
the documents outside it.  With class prior p the non-negative unbiased risk of a score g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

with logistic loss; where the bracket falls below zero, its gradient is followed upwards instead, so that
the model cannot fit the unlabelled sample as all-negative.  The prior is estimated from the labels outside
the held-out fold (share of 1, smoothed).  The model is linear in binned text statistics: language, source,
ids and labels are no inputs.  It is fitted on the driver from at most ``positives`` + ``unlabelled`` rows of
features (about fifty numbers each); every document is then scored in one pass without a shuffle.

Defined cases: a null text is empty, an empty text has zero statistics and is scored like any other;
conflicting labels of a document count as 0; without a trusted positive every score is the prior; repeated
rows get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows
from pairlab.llm.quality_rules import Text

#: Documented bounds of the training sample, and fixed values.
POSITIVES, UNLABELLED = 6000, 12000
FOLDS, THRESHOLD, BINS = 5, 0.3, 10
EPOCHS, BATCH, RATE, DECAY = 60, 512, 0.05, 1e-4
NAMES = ("words", "word_length", "line_length", "distinct", "top_word", "repeat", "dup_lines", "symbols", "marks",
         "upper", "digits", "not_ascii", "bare", "loud", "entropy", "neighbour", "sentence", "short_words")
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def statistics(text: str) -> list[float]:
    """Numbers that describe a text, about 0 to 10 each."""
    t = Text(text)
    n, chars = t.n_words, len(t.raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(t.raw, np.uint8), minlength=256)
    words = t.words
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    p = counts[counts > 0] / chars
    same = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(not w.strip(b"|#*$%&<>!-_=+.,;:") for w in words)
    loud = t.raw.count(b"!") + t.raw.count(b"?")
    stops = counts[33] + counts[46] + counts[63]
    return [math.log1p(n), t.word_chars / n, math.log1p(n / max(t.n_lines, 1)),
            len(tally) / n ** 0.85, max(tally.values()) / n, t.n_repeat_words / n, t.n_dup_lines / max(t.n_lines, 1),
            t.n_symbols / n, float(counts[_MARKS].sum()) / n, float(counts[_UPPER].sum()) / chars,
            float(counts[_DIGIT].sum()) / chars, float(counts[128:].sum()) / chars, bare / n, loud / n,
            float(-(p * np.log2(p)).sum()), same / n, float(stops) / n, sum(len(w) < 4 for w in words) / n]


class Model:
    """Binned statistics, weights and bias."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, bias: float):
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(coded(rows, self.cuts) @ self.weights + self.bias, -30, 30)))


def coded(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One 0/1 column per statistic and cut: is it above the cut?  (Steps, so neighbours share weight.)"""
    return (rows[:, :, None] > cuts[None]).reshape(len(rows), cuts.size).astype(np.float32)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Mini-batch Adam on the non-negative risk."""
    both = np.concatenate([pos, unl, np.zeros((1, len(NAMES)))])
    cuts = np.quantile(both, np.concatenate([np.linspace(0.05, 0.95, BINS), [0.98, 0.02]]), axis=0).T
    if not len(pos) or not len(unl):
        return Model(cuts, np.zeros(cuts.size), math.log(prior / (1 - prior)))
    x_p, x_u = coded(pos, cuts), coded(unl, cuts)
    w, b = np.zeros(cuts.size + 1), 0.0
    w[-1] = math.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    add = lambda x: np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    x_p, x_u = add(x_p), add(x_u)
    rng = np.random.default_rng(seed)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x_u))
        for k in range(0, len(x_u), BATCH):
            u = x_u[order[k:k + BATCH]]
            p = x_p[rng.integers(0, len(x_p), BATCH)]
            z_p, z_u = p @ w, u @ w
            negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            g_neg = (sig(z_u) @ u) / len(u) - prior * (sig(z_p) @ p) / len(p)
            g_pos = -prior * (sig(-z_p) @ p) / len(p)
            g = (g_pos + g_neg if negative >= 0 else -g_neg) + DECAY * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (0.98 ** epoch) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(cuts, w[:-1], float(w[-1] + b))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def _statistics(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield {"x": [statistics(t) for t in batch.column("text").to_pylist()]}

    return map_rows(df, run, "x array<double>", {"x": pa.list_(pa.float64())})


def _array(df: DataFrame, limit: int) -> np.ndarray:
    rows = [r["x"] for r in _statistics(df).limit(limit).collect()]
    return np.array(rows, float).reshape(len(rows), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    texts = id_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality") \
        .filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("q"))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("k")).first()
    prior = (seen["k"] + 1) / (seen["n"] + 2)

    def picked(df: DataFrame, have: int, want: int) -> DataFrame:
        share = min(1.0, want / max(have, 1))
        return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    trusted = picked(known.filter("q = 1").select("doc_id"), seen["k"], positives).limit(2 * positives)
    total = texts.select("doc_id").count()
    pos = _array(texts.join(F.broadcast(trusted), "doc_id", "left_semi"), 2 * positives)
    unl = _array(picked(texts.filter(fold(F.col("doc_id")) != 0), total, unlabelled), 2 * unlabelled)
    order = lambda a: a[np.lexsort(a.T)]  # noqa: E731  the rows arrive in any order
    return fit(order(pos), order(unl), prior)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column("text").to_pylist()], float)
            yield {"doc_id": batch.column("doc_id"), "score": model.scores(rows.reshape(-1, len(NAMES)))}

    scored = map_rows(id_text(docs), run, "doc_id long, score double", {"doc_id": pa.int64(), "score": pa.float64()})
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
