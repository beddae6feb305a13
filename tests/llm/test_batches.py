"""What a Python worker holds at once is bounded by bytes and by rows, and results don't depend on it."""

import numpy as np
import pyarrow as pa
import pytest

from armlight.llm import batches, id_files, jaccard, packing, quality
from armlight.llm.queries import vocabulary_path
from armlight.session import fresh_path

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def no_limit(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)
    if before is not None:
        spark.conf.set(LIMIT, before)


@pytest.fixture(scope="module")
def long_texts(spark):
    return spark.createDataFrame([(i, f"{i} " + "word " * 4_000) for i in range(600)], "doc_id bigint, text string").coalesce(1)


def _bytes_of(held):
    for batch in held:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])


def test_steps_get_batches_of_few_bytes(spark, long_texts, no_limit):
    model = quality.LinearScore(np.zeros(quality.WIDTH), 0.0, np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    steps = {
        "quality": lambda: quality.score(long_texts, model),
        "signatures": lambda: jaccard._signatures(long_texts),
        "shingles": lambda: jaccard.shingle_counts(long_texts),
        "packing": lambda: packing.tokenised(long_texts, vocabulary_path()),
        "id files": lambda: id_files.write_ids(long_texts, vocabulary_path("byte_bpe_50k.json"), fresh_path(spark, "batches-test")),
    }
    for name, step in steps.items():
        spark.conf.unset(LIMIT)
        step()
        most = max(r["n"] for r in long_texts.mapInArrow(_bytes_of, "n bigint").collect())
        assert most < batches.BATCH_BYTES + 50_000, name


def test_a_limit_of_the_session_stays(spark, long_texts, no_limit):
    spark.conf.set(LIMIT, "1000000")
    jaccard.shingle_counts(long_texts)
    assert spark.conf.get(LIMIT) == "1000000"


def test_slices_of_short_texts_have_few_rows():
    texts = ["a"] * 25 + [None] * 7 + ["b" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(33)), pa.array(texts)], ["doc_id", "text"])
    parts = list(batches.slices([batch], "text", 30, 10))
    assert max(map(len, parts)) == 10
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [len(p) for p in batches.slices([batch], "text", 30)] == [32, 1]


def test_results_do_not_depend_on_batches(spark, no_limit):
    rows = [(i, " ".join(f"w{(i // 2 + k) % 97}" for k in range(i % 40))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None)], "doc_id bigint, text string").repartition(3, "doc_id")

    def results():
        sets = {(r["id"], r["size"], r["one"], r["two"], bytes(r["point"]), *r["prefix"]) for r in jaccard._signatures(docs).collect()}
        tokens = {(r["doc_id"], r["curve"], r["doc_tokens"], bytes(r["ids"])) for r in packing.tokenised(docs, vocabulary_path()).collect()}
        return sets, tokens

    spark.conf.set(LIMIT, "2000")
    small = results()
    spark.conf.unset(LIMIT)
    assert small == results()
