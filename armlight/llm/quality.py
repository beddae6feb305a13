"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; all other documents outside the labels are unlabelled web text. A
linear model minimises the non-negative unbiased risk (Kiryo et al., 2017)

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

with the logistic loss by Adam over batches; where the second term is negative, its gradient is climbed instead.

The class prior is estimated from the same two samples (best bin estimation; Garg et al., 2021): a model of half of them
tells positives from unlabelled rows, and on the other half the least ratio of the unlabelled to the positive share above
a score bounds the prior, at the score where that bound with its sampling error is lowest. Negative labels are not read.

Features of a text are shares of hashed triples of character classes (upper, lower, digit, white space, each mark) and
a few ratios; they are counted over the whole text. The fit sees at most ``BOUND`` positives and twice as many
unlabelled rows, so what the driver holds is ``3 * BOUND`` rows of ``WIDTH`` numbers, whatever the corpus. Scoring is
one pass over all rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import map_batches, slices, utf8
from armlight.llm.terms import WHITE, mix, word_hashes
from armlight.llm.training_rows import fold, sample

BOUND = 6_000
TRIPLES = 1 << 10
WIDTH = TRIPLES + 4
SLICE = 2 << 20
# texts whose features are counted at once: each takes some 30 kB on the way, however short
ROWS = 1_024
FOLDS, HELD_OUT = 3, 1

# character classes of bytes: lower, upper, digit, white space, line feed, beyond ASCII, and each mark by itself
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97
_CLASS[WHITE] = 32
_CLASS[10] = 10


def text_features(content: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` numbers per text; a text without characters is all zero."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(n), lengths)
    out = np.zeros((n, WIDTH), np.float32)
    if len(content) > 2:
        kinds = _CLASS[content]
        triple = mix(kinds[:-2] << np.uint64(16) | kinds[1:-1] << np.uint64(8) | kinds[2:]) % np.uint64(TRIPLES)
        whole = owner[:-2] == owner[2:]
        cell = owner[:-2][whole] * TRIPLES + triple[whole].astype(np.int64)
        counts = np.bincount(cell, minlength=n * TRIPLES).reshape(n, TRIPLES)
        out[:, :TRIPLES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    words, text = word_hashes(content, offsets)
    if len(words):
        total = np.maximum(1, np.bincount(text, minlength=n))
        again = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        out[:, TRIPLES] = np.bincount(text[1:][again], minlength=n) / total
        order = np.lexsort((words, text))
        first = np.ones(len(order), bool)
        first[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
        out[:, TRIPLES + 1] = np.bincount(text[order][first], minlength=n) / total
        out[:, TRIPLES + 2] = np.log1p(total) / 10
        out[:, TRIPLES + 3] = lengths / total / 20
    return out


class LinearScore:
    """Weights over standardised features."""

    def __init__(self, weights, bias, mean, scale):
        self.weights, self.bias = (weights / scale).astype(np.float32), float(bias - (weights / scale) @ mean)

    def score(self, features):
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30).astype(np.float64)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, margin: float = 0.01) -> float:
    """The share of positives among the unlabelled rows; 0.5 without two rows of both kinds."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = fit_nnpu(positive[::2], unlabelled[::2], 0.5, apart=True)
    rest = (positive[1::2], unlabelled[1::2])
    scores = [np.concatenate([model.score(x[i : i + 1024].astype(np.float32)) for i in range(0, len(x), 1024)]) for x in rest]
    scores = [np.sort(x) for x in scores]
    cuts = np.unique(np.concatenate(scores))
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in scores)
    error = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in scores)
    cuts = np.flatnonzero(above_p > 0)
    best = cuts[np.argmin((above_u[cuts] + (1 + margin) * error) / above_p[cuts])]
    return float(min(1.0, above_u[best] / above_p[best]))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, batch: int = 512, apart: bool = False):
    """A :class:`LinearScore`; without positives or unlabelled rows it scores every text with the prior. With ``apart``
    it tells positives from unlabelled rows instead."""
    prior = min(max(prior, 0.01), 0.99)
    n = len(positive) + len(unlabelled)
    mean, scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
    if n:
        mean = ((positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n).astype(np.float32)
        spread = sum(((x[i : i + 512] - mean) ** 2).sum(0, dtype=np.float64) for x in (positive, unlabelled) for i in range(0, len(x), 512))
        scale = (np.sqrt(spread / n) + 1e-3).astype(np.float32)

    def standard(x):
        return np.clip(np.hstack([(x - mean) / scale, np.ones((len(x), 1), np.float32)]), -8, 8)

    weights = np.zeros(WIDTH + 1)
    weights[-1] = np.log(prior / (1 - prior))
    if len(positive) and len(unlabelled):
        rng, m, v, step = np.random.default_rng(7), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), 0
        batches = max(1, len(unlabelled) // batch)
        for _ in range(epochs):
            p_parts, u_parts = (np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled))
            for rows_p, rows_u in zip(p_parts, u_parts, strict=True):
                if not len(rows_p) or not len(rows_u):
                    continue
                bp, bu = standard(positive[rows_p]), standard(unlabelled[rows_u])
                fp, fu = (1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) for x in (bp, bu))
                # d loss(f) = s - 1 and d loss(-f) = s for the logistic loss
                good = prior * (bp.T @ (fp - 1)) / len(bp)
                bad = (bu.T @ fu) / len(bu) - prior * (bp.T @ fp) / len(bp)
                risk = -np.log1p(-np.minimum(fu, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(fp, 1 - 1e-9)).mean()
                slope = good + bad if risk >= 0 else -bad
                if apart:
                    slope = (bp.T @ (fp - 1)) / len(bp) + (bu.T @ fu) / len(bu)
                slope[:-1] += decay * weights[:-1]
                step += 1
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LinearScore(weights[:-1], weights[-1], mean, scale)


def _features_of(docs: DataFrame, kept: str) -> np.ndarray:
    """Features of a bounded frame of (text, kept), collected as bytes."""

    def run(batches):
        for part in slices(batches, "text", SLICE, ROWS):
            rows = text_features(*utf8(part["text"])).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part[kept], pa.array([r.tobytes() for r in rows], pa.binary())], [kept, "f"])

    schema = T.StructType([docs.schema[kept], T.StructField("f", T.BinaryType())])
    rows = map_batches(docs, run, schema).collect()
    cells = np.frombuffer(b"".join(bytes(r["f"]) for r in rows), np.float16).reshape(-1, WIDTH)
    return cells, np.array([r[kept] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> LinearScore:
    """Fits on documents outside the held-out fold; see the module's text for the bound."""
    learn = fold("doc_id", FOLDS) != HELD_OUT
    known = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.select("doc_id").where(learn & F.col("doc_id").isNotNull()).distinct()
    trusted = sample(known.where("quality = 1").join(ids, "doc_id"), bound, "positive").select("doc_id", F.lit(1).alias("side"))
    free = ids.join(labels.select("doc_id"), "doc_id", "left_anti")
    unlabelled = sample(free, 2 * bound, "unlabelled").select("doc_id", F.lit(0).alias("side"))
    # at most 3 * bound ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(trusted.unionByName(unlabelled)), "doc_id")
    features, side = _features_of(chosen.select("text", "side"), "side")
    positive, web = features[side == 1], features[side == 0]
    return fit_nnpu(positive, web, class_prior(positive, web))


def score(docs: DataFrame, model: LinearScore, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text, null as empty; equal texts score alike. A column of that
    name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c != name])
    names = rows.columns

    def run(batches):
        for part in slices(batches, "text", SLICE, ROWS):
            scores = shared.value.score(text_features(*utf8(part["text"])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*names, name])

    return map_batches(rows, run, T.StructType([*rows.schema, T.StructField(name, T.DoubleType())]))
