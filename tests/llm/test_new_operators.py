"""Spelling variants, id files and conversation repair against plain versions, on hard cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlight.llm import conversations, id_files, spelling
from armlight.llm.queries import vocabulary_path
from armlight.session import fresh_path

from tests.llm import brute_new

SCHEMA = "doc_id bigint, text string, word string, n int, block string, start int, shard string"


def spelled():
    rng = random.Random(11)
    stems = ["".join(rng.choices("abcdeéÀ", k=rng.randint(5, 9))) for _ in range(40)]

    def typo(word):
        at = rng.randrange(len(word))
        return rng.choice([word[:at] + word[at + 1 :], word[:at] + "z" + word[at:], word[:at] + "y" + word[at + 1 :]])

    pool = stems * 30 + [typo(w) for w in stems for _ in range(3)] * 6 + [typo(typo(w)) for w in stems] * 5
    texts = [None, "", " \n", "x" * 9000, *(" ".join(rng.choices(pool, k=400)) for _ in range(30))]
    texts += ["Grüße, GRÜSSE! Ünder under Under-under under×under " * 5, "a1b2c3", " ".join(rng.choices(pool, k=20_000))]
    rows = list(enumerate(texts))
    return [*rows, rows[7], rows[7], (None, texts[8]), (None, texts[9])]


@pytest.fixture(scope="module")
def spelled_docs(spark):
    rows = spelled()
    return rows, spark.createDataFrame([(i, t, "w", 3, "b", 4, "s") for i, t in rows], SCHEMA).repartition(3)


def forms(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants(spelled_docs):
    rows, docs = spelled_docs
    want = brute_new.variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert forms(spelling.variants(docs)) == want


def test_spelling_in_parted_blocks(spelled_docs, monkeypatch):
    """With cells of seven words nearly every block is dealt into parts, tiles end within them."""
    rows, docs = spelled_docs
    monkeypatch.setattr(spelling, "CELL", 7)
    monkeypatch.setattr(spelling, "TILE", 5)
    assert forms(spelling.variants(docs)) == brute_new.variants(rows)


def test_spelling_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint64).astype(np.uint32)
    payload = id_files.pack(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    for start, count in ((0, len(ids)), (3, 11), (32_767, 37_000), (70_000, 1), (5, 0)):
        assert (id_files.unpack(payload, bits, start, count) == ids[start : start + count]).all()
    assert id_files.pack(ids[:0], bits) == b""


def test_bits_hold_the_vocabulary():
    assert [id_files.id_bits(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        id_files.pack(np.array([8], np.uint32), 3)


def hard_texts():
    rng = random.Random(2)
    odd = [None, "", " ", "  a  b ", "a\n\n b\t c\r\n", "don't we'll  'S", "x<|endoftext|>y <|endoftext|>", "é à ß b　c \u0085d", "日本 語 text", "\U0001f600 ok", "a" * 30_000]
    return odd + ["".join(rng.choices(" \n\tab.é'1 ÿ", k=rng.randint(1, 300))) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("special", [True, False])
def test_pieces_as_the_library(library, special, monkeypatch):
    """With a special token in the texts and without one, where the cuts are finer; the cache forgets on the way."""
    import pyarrow as pa

    monkeypatch.setattr(id_files, "CACHED_PIECES", 50)
    rng = random.Random(8)
    texts = [t for t in hard_texts() if special or "<|" not in (t or "")]
    texts += ["".join(rng.choices(["'s", "'", "’", "×", "é", "Ã", " ", "\n", "\t", "a", "B", "7", "²", ",", "--", "\u00a0", "\x1c", "\x7f"], k=rng.randint(1, 60))) for _ in range(3000)]
    encoder = id_files.LibraryEncoder(vocabulary_path("byte_bpe_50k.json"))
    assert encoder.by_pieces
    parts = [encoder.encode(pa.array(texts[k : k + 100], pa.string())) for k in range(0, len(texts), 100)]
    ids, sizes = (np.concatenate(x) for x in zip(*parts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_whole_texts_where_pieces_would_differ():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary_path()
    encoder = id_files.LibraryEncoder(path)
    assert not encoder.by_pieces
    texts = ["Some  Words here", None, "x"]
    ids, _ = encoder.encode(pa.array(texts, pa.string()))
    other = Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in texts for i in other.encode(t or "", add_special_tokens=False).ids]


def test_id_files(spark, library, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    texts = hard_texts()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, "another"), (6, "second text of an id"), (9, texts[3])]
    docs = spark.createDataFrame([(i, t, "w", 3, "b", 4, "s") for i, t in rows], SCHEMA).repartition(5)
    path = fresh_path(spark, "id-files-test")
    id_files.write_ids(docs, vocabulary_path("byte_bpe_50k.json"), path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, flat = [], []
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
    read = id_files.read_documents(spark, path).join(id_files.shard_starts(spark, path), "shard")
    got = [(r.doc_id, r.shard_start + r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read.collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.shard for r in read.collect()}) > 1
    for first, count in ((0, 1), (95, 450), (len(flat) - 3, 3), (len(flat), 10)):
        parts = sorted((r.position, list(r.ids)) for r in id_files.read_range(spark, path, first, count).collect())
        assert [x for _, p in parts for x in p] == flat[first : first + count]


def test_id_files_of_no_rows(spark):
    path = fresh_path(spark, "id-files-test")
    id_files.write_ids(spark.createDataFrame([], SCHEMA), vocabulary_path("byte_bpe_50k.json"), path)
    assert id_files.read_documents(spark, path).count() == 0


def talks():
    rng = random.Random(4)
    said = ["Yes.", "No", "Why?", "", " \n", "Well. \n", "…", "It is so!", "dots.. here", "a:b"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", ""]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"{t} is said." if rng.random() < 0.8 else "cut") for t in range(300)]
    rows += [(101, None, "user", "Hi."), (101, None, "user", "Hi."), (101, 4, "assistant", None), (101, 9, None, "Ho."), (None, 1, "user", "Q?"), (None, 2, "assistant", "A.")]
    rows += [(102, 3, "user", "Same turn."), (102, 3, "user", "Another one."), (102, 3, "assistant", "And one.")] + [(103, 1, "user", "Same.")] * 400
    dropped = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return rows + [(dropped, 1, "user", "Gone.")]


TALK = "conv_id bigint, turn bigint, role string, text string, code string, place int, n int"


def reports(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_conversation_repair(spark):
    rows = talks()
    given = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], TALK).repartition(4)
    got = conversations.with_hashes(*conversations.repair(given))
    assert got.count() == len({r[0] for r in rows})
    assert reports(got) == brute_new.reports(rows)
    none = conversations.with_hashes(*conversations.repair(spark.createDataFrame([], TALK)))
    assert none.count() == 0


def test_search_in_blocks():
    """Blocks of any size give the path of one search over the whole conversation."""
    rng = random.Random(9)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice([".", "x", ""]) and rng.choice([str(rng.random()) + ".", "x" + str(rng.random()), "", "."])) for _ in range(rng.randint(0, 80))]
        names = ["", "truncated", "blank", "duplicate"]
        codes = "".join(conversations.letter(r if r in "sua" else "", names.index(k)) for (r, _), k in zip(rows, brute_new.faults(rows)))
        assert conversations.cheapest(codes) == brute_new.repaired(tuple(rows))[:2]


def test_repaired_rows_are_legal(spark):
    given = spark.createDataFrame([(*r, "c", 1, 2) for r in talks()], TALK)
    _, repaired = conversations.repair(given)
    lines = {}
    for r in repaired.orderBy("conv_id", "place", "nth").collect():
        lines.setdefault(r.conv_id, []).append(r.role[:1])
    import re

    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in lines.values())
