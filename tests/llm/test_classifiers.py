"""The toxicity machine and the quality model against loops, planted pairs and known mixtures."""

import numpy as np
import pytest

from armlight.llm import quality, toxicity


def _pairs(n, noise, seed):
    """Rows that are toxic if they have both of two terms or none of them; each term alone says nothing."""
    rng = np.random.default_rng(seed)
    rows, toxic = [], []
    for _ in range(n):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([[10] * int(a), [11] * int(b), rng.choice(3000, noise) + 100]).astype(int)))
        toxic.append(float(a == b))
    return rows, np.array(toxic)


def _scores(machine, rows):
    return machine.score(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, int), *rows]), len(rows))


@pytest.mark.parametrize("noise", [0, 20])
def test_terms_that_matter_only_together(noise):
    rows, toxic = _pairs(4_000, noise, 1)
    machine = toxicity.fit_machine(rows[:3_000], toxic[:3_000], np.ones(3_000))
    assert ((_scores(machine, rows[3_000:]) >= 0.5) == toxic[3_000:]).mean() > 0.9


def test_paired_terms():
    rows, toxic = _pairs(2_000, 30, 2)
    terms = np.unique(np.concatenate(rows))
    assert toxicity.paired_terms(rows, toxic, terms).tolist() == [10, 11]
    # pairs of terms in different blocks
    wide = toxicity.PAIR_BLOCK
    try:
        toxicity.PAIR_BLOCK = 1
        assert toxicity.paired_terms(rows, toxic, terms[:40]).tolist() == [10, 11]
    finally:
        toxicity.PAIR_BLOCK = wide
    # a toxic word interacts with nothing
    alone = [np.append(r, 20_000) if t else r for r, t in zip(rows, np.arange(2_000) % 2, strict=True)]
    assert not len(toxicity.paired_terms(alone, np.arange(2_000) % 2, np.append(terms, 20_000)))
    assert not len(toxicity.paired_terms(rows, toxic, terms[:0])) and not len(toxicity.paired_terms(rows[:30], toxic[:30], terms))


def test_pair_sum_is_that_of_a_loop():
    rng = np.random.default_rng(3)
    machine = toxicity.FactorizationMachine(0.3)
    machine.slot[:9] = np.arange(9)
    machine.linear, machine.factors = rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS))
    machine.linear[0], machine.factors[0] = 0, 0
    rows = [np.array([1, 2, 5, 8]), np.array([], int), np.array([3]), np.array([4, 6, 7, 100])]
    for row, got in zip(rows, _scores(machine, rows), strict=True):
        held = [s for s in machine.slot[row] if s]
        raw = machine.bias + sum(machine.linear[i] for i in held)
        raw += sum(machine.factors[i] @ machine.factors[j] for x, i in enumerate(held) for j in held[x + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def _mixture(share, seed, n=3_000):
    rng = np.random.default_rng(seed)
    positive, web = (np.zeros((k, quality.WIDTH), np.float32) for k in (n // 2, n))
    # like the triples of real texts, most features are empty
    positive[:, :60], web[:, :60] = rng.normal(size=(n // 2, 60)), rng.normal(size=(n, 60))
    kind = rng.random(n) < share
    positive[:, :20] += 1
    web[:, :20] += np.where(kind, 1, -1)[:, None]
    return positive, web, kind


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_and_labels_of_a_known_mixture(share):
    positive, web, kind = _mixture(share, 4)
    prior = quality.class_prior(positive, web)
    assert abs(prior - share) < 0.12
    model = quality.fit_nnpu(positive, web, prior)
    _, fresh, truth = _mixture(share, 5)
    assert ((model.score(fresh) >= 0.5) == truth).mean() > 0.9


def test_prior_without_rows():
    none = np.zeros((0, quality.WIDTH), np.float32)
    assert quality.class_prior(none, none) == 0.5
    assert quality.class_prior(np.ones((5, quality.WIDTH), np.float32), none) == 0.5
    same = np.ones((5, quality.WIDTH), np.float32)
    assert 0 <= quality.class_prior(same, same) <= 1
