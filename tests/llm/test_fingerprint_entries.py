"""Fingerprints and their likeness against a plain loop over the k-mers of a text."""

import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from armlight.llm import fingerprints as fp

TEXTS = ["", " \t\n", "one", "one two", "a b c a b c a b c", "x" * 100, "é ü " * 30, " ".join(f"w{k % 37}" for k in range(500))]
TEXTS += [" ".join(f"w{k * k % 91}" for k in range(n)) for n in (3, 4, 50, 400)] + [TEXTS[-1] + " tail"]


def _hash(*values):
    seed = 42
    for value in values:
        if value is not None:
            seed = xxhash.xxh64_intdigest(value, seed)
    return seed


def _long(value):
    return struct.pack("<q", value)


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def entries(text):
    tokens = [t.encode() for t in re.findall(r"[^ \t-\r]{1,%d}" % fp.TOKEN, text)]
    seen, bins = Counter(), {}
    for place in range(max(len(tokens) - fp.K + 1, min(len(tokens), 1))):
        kmer = _signed(_hash(*tokens[place : place + fp.K])) >> 24
        value = _hash(_long(kmer), struct.pack("<i", seen[kmer]))
        seen[kmer] += 1
        bins.setdefault(value >> (64 - fp.BIN_BITS), []).append((_signed(value) >> 24, place))
    out = set()
    for number, held in bins.items():
        least = [_long(h) for h, _ in sorted(sorted(held)[:2], key=lambda v: v[1])]
        out.add(_signed(number << (64 - fp.BIN_BITS) | _hash(*least) >> fp.BIN_BITS))
    return out


def test_entries_and_likeness(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("id", fp.signature(F.col("text")).alias("own"))
    got = {r.id: r.own for r in rows.collect()}
    want = {i: entries(t) for i, t in enumerate(TEXTS)}
    assert {i: set(own) for i, own in got.items()} == want and all(len(own) == len(want[i]) for i, own in got.items())
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.id <= b.id")).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), fp.likeness(F.col("a.own"), F.col("b.own")).alias("like")
    )
    for a, b, like in pairs.collect():
        most = max(len(want[a]), len(want[b]))
        assert like == (len(want[a] & want[b]) / most if most else 1.0)
