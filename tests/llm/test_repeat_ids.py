"""Removal of repeated strings where ids are null, repeated or text."""

import random

from armlight.llm import repeats

from tests.llm.brute_repeats import removed

_RNG = random.Random(4)
PASSAGE = "".join(_RNG.choices("abcdef gh", k=160))
TEXTS = ["".join(_RNG.choices("abcdef gh", k=90)) + PASSAGE * (k % 2 + 1) + str(k) for k in range(5)]


def test_null_and_repeated_ids(spark):
    ids = [None, None, 7, 7, 7]
    rows = [*zip(ids, TEXTS, strict=True), (7, TEXTS[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = repeats._row_keys(docs.selectExpr("doc_id", "coalesce(text, '') as text")).collect()
    # nulls come first, rows of one id and text share a number
    assert [r.doc_id for r in sorted(keyed, key=lambda r: r.id)] == [None] * 3 + [7] * 4
    want = removed({(r.id, r.text) for r in keyed})
    expected = sorted((str(r.doc_id), want[r.id][0], want[r.id][2]) for r in keyed)
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()) == expected


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(TEXTS)], "doc_id string, text string")
    want = removed([(f"k{k}", t) for k, t in enumerate(TEXTS)])
    assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()} == want
