"""Texts and columns on which operators once failed: long runs, and columns of any names."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from armlight.llm import id_files, line_dedup, packing, pieces, secret_scan
from armlight.llm.bpe import Encoder
from armlight.llm.queries import vocabulary_path

from tests.llm.brute_secrets import all_spans

LONG = ["a." * 200_000, "-" * 200_000, "a+" * 100_000, "a-." * 70_000 + ":1", "x" * 200_000, "user=" + "b." * 50_000 + " password: abcdef123 db.example.org:5432"]


def test_secrets_in_long_runs(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id bigint, text string").repartition(6)
    start = time.time()
    got = {r.doc_id: r.s or "" for r in secret_scan.scan(docs).select("doc_id", secret_scan.span_text("spans").alias("s")).collect()}
    assert time.time() - start < 60
    for i, text in enumerate(LONG[-1:], len(LONG) - 1):
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in all_spans(text))


@pytest.mark.parametrize("operator", [secret_scan.scan, secret_scan.redact, line_dedup.drop_repeated_lines])
def test_columns_of_any_name(spark, operator):
    text = "one\ntwo\nthree\npassword: abc123XYZ\nuser=bob at db.example.org:5432\ntail"
    names = "_key bigint, _spans int, _id int, _text_key int, text_key int, pos int, key int, found int, row int"
    rows = [(k, text, *range(9)) for k in range(3)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")
    got = operator(docs)
    assert got.count() == 3 and set(docs.columns) <= set(got.columns)
    assert {tuple(r[c] for c in docs.columns[2:]) for r in got.collect()} == {tuple(range(9))}


def test_one_long_word():
    encoder, word = Encoder(vocabulary_path()), "ab" * 500_000
    start = time.time()
    ids = encoder.encode(word)
    assert time.time() - start < 30
    assert encoder.decode(np.frombuffer(ids, "<u2").tolist()).replace(" ", "").replace("</w>", "") == word


def test_pieces_of_the_word_vocabulary():
    """Encoding by pieces gives the library's ids, with special tokens and without."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    encoder, rng = id_files.LibraryEncoder(vocabulary_path(), by_pieces=True), random.Random(6)
    parts = ["'s", "'", "’", "×", "é", "É", "Σ", "ς", " ", "  ", "\n", "\t", "a", "B", "The", "7", "²", ",", "--", " ", "\x1c", "　", "日本"]
    for special in ([], ["<|endoftext|>"]):
        texts = ["".join(rng.choices(parts + special, k=rng.randint(1, 40))) for _ in range(2000)] + [None, ""]
        encoder.cache = pieces.PieceCache(40)
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            ids, sizes = encoder.encode(pa.array(some, pa.string()))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
            assert sizes.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_packed_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(vocabulary_path()), random.Random(7)
    texts = [None, "", "x<|endoftext|>y", *(" ".join(rng.choices(["alpha", "beta,", "Gamma.", "7", "don't"], k=rng.randint(1, 3000))) for _ in range(12))]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), vocabulary_path()).collect()
    for i, text in enumerate(texts):
        mine = sorted((p for p in found if p.doc_id == i), key=lambda p: p.start)
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x for p in mine for x in p.ids] == want
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in mine)
    lengths = {}
    for p in found:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in lengths.values())
