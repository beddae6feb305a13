"""Induced sorting of fragments against a dictionary of all windows."""

import random

import numpy as np

from armlight.llm import repeats
from armlight.llm.induction import LENGTH, REACH, SAMPLE, covered_windows

from tests.llm.brute_repeats import removed


def _fragments(seed, groups):
    """Random fragments around shared samples; contexts are cut from few strings, so that many windows are equal."""
    rng = random.Random(seed)
    rows = []
    for group, size in enumerate(groups):
        sample = bytes(rng.choices(range(3), k=SAMPLE))
        lefts = [bytes(rng.choices(range(2), k=REACH)) for _ in range(2)]
        rights = [bytes(rng.choices(range(2), k=REACH)) for _ in range(2)]
        for _ in range(size):
            left, right = bytearray(rng.choice(lefts)), bytearray(rng.choice(rights))
            if rng.random() < 0.7:
                left[rng.randrange(REACH)] ^= 1
            if rng.random() < 0.7:
                right[rng.randrange(REACH)] ^= 1
            lead = rng.randint(0, REACH)
            least = max(0, lead - rng.randint(0, lead))
            piece = bytes(left[REACH - lead :]) + sample + bytes(right[: REACH - least])
            rows.append((group, rng.randrange(6), rng.randrange(10**6), lead, piece))
    return rows


def test_covered_windows():
    for seed in range(12):
        rows = _fragments(seed, [1, 2, 40, 3, 150])
        group, ids, start, lead = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
        pieces = [r[4] for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        which, window = covered_windows(group, ids, start, lead, np.frombuffer(b"".join(pieces), np.uint8), offsets)
        first, every = {}, []
        for i, (g, doc, at, before, piece) in enumerate(rows):
            for w in range(len(piece) - LENGTH + 1):
                key, place = (g, before - w, piece[w : w + LENGTH]), (doc, at + w)
                first[key] = min(first.get(key, place), place)
                every.append((i, w, key, place))
        want = {(i, w) for i, w, key, place in every if place > first[key]}
        got = list(zip(which.tolist(), window.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == want and want


def test_no_fragments():
    none = np.zeros(0, np.int64)
    assert [len(c) for c in covered_windows(none, none, none, none, np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0, 0]


def _texts():
    """Passages in changing surroundings, null bytes, letters of several bytes, one letter over and over."""
    rng = random.Random(11)
    passages = ["".join(rng.choices("ab é\0", k=rng.randint(80, 260))) for _ in range(6)] + ["x" * 400, "ab" * 150]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage) // 2)
            parts += ["".join(rng.choices("abcdef", k=rng.randint(0, 40))), passage[cut : cut + rng.randint(60, 300)]]
        texts.append((k, "".join(parts)))
    return texts


def test_both_ways_agree_with_all_strings(spark):
    """Every sample by induction, and every one with more than two runs window by window."""
    texts = _texts()
    docs = spark.createDataFrame(texts, "id bigint, text string")
    want = removed(texts)
    for group in (repeats.GROUP, 2):
        spans = {r.id: r.spans for r in repeats.repeated_spans(docs, group).collect()}
        for k, text in texts:
            gone = bytearray(len(text.encode()))
            for start, end in spans.get(k, []):
                gone[start:end] = b"\1" * (end - start)
            assert sum(gone) == want[k][0], (group, k)
    assert sum(n for n, _, _ in want.values()) > 1_000
