"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words. Its score is that of

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so a pair of terms can weigh more, or less, than both alone. The model is fitted by Adagrad on the logistic loss, on at
most ``BOUND`` labelled rows of each class, weighted back to the classes' shares. Only terms of at least ``LEAST`` of
these rows whose shares in the two classes differ by ``DEVIATIONS`` standard errors have weights, so a small sample does
not learn chance words. Terms that matter only together have weights too: all pairs of terms are tested for whether one
moves the other's difference between the classes, by ``PAIR_DEVIATIONS`` standard errors, as there are many pairs. The driver holds the sample's term numbers, bounded by ``BOUND`` and ``TERMS`` per row. Scoring is
one pass over all rows and whole texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlight.llm.batches import list_array, slices, utf8
from armlight.llm.terms import BREAKS, word_hashes
from armlight.llm.training_rows import fold, sample

BOUND = 5_000
TERMS = 1 << 18
FACTORS = 4
LEAST = 4
DEVIATIONS = 3.0
PAIR_DEVIATIONS = 6.0
# a test of two terms needs so many rows of each class with and without the first
STRATUM = 20
PAIR_BLOCK = 1_024
SLICE = 2 << 20
FOLDS, HELD_OUT = 5, 0


def text_terms(content: np.ndarray, offsets: np.ndarray):
    """(text number, term) of the distinct hashed words of each text, in order."""
    words, text = word_hashes(content, offsets, BREAKS)
    cells = np.unique(text * TERMS + (words % np.uint64(TERMS)).astype(np.int64))
    return cells // TERMS, cells % TERMS


class FactorizationMachine:
    def __init__(self, bias=0.0):
        self.bias = bias
        self.slot = np.zeros(TERMS, np.int32)  # slot 0 is for terms without a weight
        self.linear, self.factors = np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32)

    def raw(self, text, slots, n):
        """Scores before the logistic function, and the sum of factors of each text."""
        sums = np.stack([np.bincount(text, self.factors[slots, f], n) for f in range(FACTORS)], 1)
        own = np.bincount(text, (self.factors[slots] ** 2).sum(1), n)
        pairs = 0.5 * ((sums**2).sum(1) - own)
        return self.bias + np.bincount(text, self.linear[slots], n) + pairs, sums

    def score(self, text, terms, n):
        slots = self.slot[terms]
        held = slots > 0
        return 1 / (1 + np.exp(-np.clip(self.raw(text[held], slots[held], n)[0], -30, 30)))


def paired_terms(rows, toxic, terms):
    """Those of ``terms`` that interact with another one: the difference of a term's share between toxic and clean rows
    is another among rows with the other term than among rows without it."""
    place = np.full(TERMS, -1)
    place[terms] = np.arange(len(terms))
    lists = [p[p >= 0] for p in (place[r] for r in rows)]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in lists])
    column = np.concatenate([np.zeros(0, int), *lists])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    toxic = np.asarray(toxic) == 1
    classes = toxic, ~toxic
    totals = [np.bincount(column[c[row]], minlength=len(terms)).astype(np.float32) for c in classes]
    sizes = [np.float32(c.sum()) for c in classes]

    def block(start):
        out = np.zeros((len(rows), min(PAIR_BLOCK, len(terms) - start)), np.float32)
        a, b = np.searchsorted(column, [start, start + PAIR_BLOCK])
        out[row[a:b], column[a:b] - start] = 1
        return out

    def difference(held, of):
        """The difference of two shares and the square of its error; a smoothed share keeps the error of few rows up."""
        of = [np.maximum(n, 1) for n in of]
        common = (held[0] + held[1] + 1) / (of[0] + of[1] + 2)
        return held[0] / of[0] - held[1] / of[1], common * (1 - common) * (1 / of[0] + 1 / of[1])

    found = np.zeros(len(terms), bool)
    for start in range(0, len(terms), PAIR_BLOCK):
        left = block(start)
        with_left = [t[start : start + left.shape[1], None] for t in totals]
        tested = np.all([(w >= STRATUM) & (n - w >= STRATUM) for w, n in zip(with_left, sizes, strict=True)], 0)
        if not tested.any():
            continue
        for other in range(0, len(terms), PAIR_BLOCK):
            right = left if other == start else block(other)
            both = [left[c].T @ right[c] for c in classes]
            own = [t[None, other : other + right.shape[1]] for t in totals]
            inside, error = difference(both, with_left)
            outside, further = difference([o - b for o, b in zip(own, both, strict=True)], [n - w for n, w in zip(sizes, with_left, strict=True)])
            hit = tested & (np.abs(inside - outside) >= PAIR_DEVIATIONS * np.sqrt(error + further))
            if other == start:
                np.fill_diagonal(hit, False)
            found[start : start + left.shape[1]] |= hit.any(1)
            found[other : other + right.shape[1]] |= hit.any(0)
    return terms[found]


def fit_machine(rows, toxic, weights, epochs=25, rate=0.1, decay=1e-4, batch=256, seed=5) -> FactorizationMachine:
    """``rows``: arrays of distinct terms; without rows of both classes the score is the share of toxic rows."""
    weights = np.asarray(weights, float)
    share = float((weights * toxic).sum() / weights.sum()) if len(rows) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    machine = FactorizationMachine(np.log(share / (1 - share)))
    if len(np.unique(toxic)) < 2:
        return machine
    in_toxic, in_clean = (
        np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t == kind]), minlength=TERMS) for kind in (1, 0)
    )
    n_toxic, n_clean = (toxic == 1).sum(), (toxic == 0).sum()
    common = (in_toxic + in_clean) / len(rows)
    error = np.sqrt(common * (1 - common) * (1 / n_toxic + 1 / n_clean)) + 1e-9
    apart = np.abs(in_toxic / n_toxic - in_clean / n_clean) / error
    used = np.flatnonzero((in_toxic + in_clean >= LEAST) & (apart >= DEVIATIONS))
    # a term in fewer rows leaves too few in a stratum
    used = np.union1d(used, paired_terms(rows, toxic, np.flatnonzero((in_toxic >= STRATUM) & (in_clean >= STRATUM))))
    machine.slot[used] = np.arange(1, len(used) + 1)
    rng = np.random.default_rng(seed)
    machine.linear = np.zeros(len(used) + 1)
    machine.factors = rng.normal(0, 0.01, (len(used) + 1, FACTORS))
    g_linear, g_factors, g_bias = np.full(len(used) + 1, 1e-2), np.full((len(used) + 1, FACTORS), 1e-1), 1e-2
    rows = [machine.slot[r] for r in rows]
    rows = [r[r > 0] for r in rows]
    if not len(used):
        return machine
    lengths = np.array([len(r) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            slots, text = np.concatenate([rows[i] for i in pick]), np.repeat(np.arange(len(pick)), lengths[pick])
            raw, sums = machine.raw(text, slots, len(pick))
            slope = weights[pick] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[pick]) / len(pick)
            touched, place = np.unique(slots, return_inverse=True)
            each = slope[text]
            d_linear = np.bincount(place, each) + decay * machine.linear[touched]
            part = each[:, None] * (sums[text] - machine.factors[slots])
            d_factors = np.stack([np.bincount(place, part[:, f]) for f in range(FACTORS)], 1) + decay * machine.factors[touched]
            g_linear[touched] += d_linear**2
            g_factors[touched] += d_factors**2
            g_bias += slope.sum() ** 2
            machine.linear[touched] -= rate * d_linear / np.sqrt(g_linear[touched])
            machine.factors[touched] -= rate * d_factors / np.sqrt(g_factors[touched])
            machine.bias -= rate * slope.sum() / np.sqrt(g_bias)
    machine.linear, machine.factors = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> FactorizationMachine:
    """Fits on labelled documents outside the held-out fold; see the module's text for the bound."""
    known = (
        labels.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id")
    )
    counts = {t: n for t, n in known.groupBy("toxic").count().collect()}
    # at most 2 * bound ids
    chosen = sample(known.where("toxic = 1"), bound, "toxic").unionByName(sample(known.where("toxic = 0"), bound, "clean"))

    def run(batches):
        for part in slices(batches, "text", SLICE):
            text, terms = text_terms(*utf8(part["text"]))
            column = list_array(terms.astype(np.int32), np.bincount(text, minlength=len(part)))
            yield pa.RecordBatch.from_arrays([part["toxic"], column], ["toxic", "terms"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    schema = T.StructType([picked.schema["toxic"], T.StructField("terms", T.ArrayType(T.IntegerType()))])
    rows = picked.mapInArrow(run, schema).toArrow()
    terms = rows["terms"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]) if len(terms) else np.zeros(1)
    values = terms.flatten().to_numpy() if len(terms) else np.zeros(0, np.int32)
    lists = [values[a:b] for a, b in zip(ends[:-1].astype(int), ends[1:].astype(int), strict=True)]
    toxic = rows["toxic"].to_numpy().astype(float)
    weight = {t: n / min(n, bound) for t, n in counts.items()}
    return fit_machine(lists, toxic, [weight[int(t)] for t in toxic])


def score(docs: DataFrame, machine: FactorizationMachine, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text, null as empty; equal texts score alike. A column of that
    name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(*[c for c in docs.columns if c != name])
    names = rows.columns

    def run(batches):
        for part in slices(batches, "text", SLICE):
            scores = shared.value.score(*text_terms(*utf8(part["text"])), len(part))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.DoubleType())]))
