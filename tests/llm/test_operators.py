"""The operators against brute force on a small table of hard cases: null, empty and long texts, ties, copies, extra columns."""

import random
import re
import zlib

import pytest

import corpus_pipeline
from armlight.llm import exact_dedup, fingerprints, jaccard, line_dedup, packing, quality, repeats, secret_scan, tokens, toxicity
from armlight.llm.queries import vocabulary_path

from tests.llm.brute_repeats import removed
from tests.llm.brute_secrets import all_spans, base

SCHEMA = "doc_id bigint, text string, id string, label int, spans string, n_bytes string"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(1, 8))) for _ in range(300)]

    def body(n):
        return " ".join(rng.choices(words, k=n))

    passage, base_text = body(60), body(120)
    near = base_text.split(" ")
    near[60] = "changed"
    found = [None, "", "", " \n\t", "a", "a b c", "A b  C", "x" * 350, "x" * 350, base_text, base_text.upper(), base_text, " ".join(near)]
    found += [body(30) + "\n" + passage + "\n" + body(20) for _ in range(4)]
    found += ["one\ntwo\nthree\nfour\n" + body(3), "zero\none\ntwo\nthree\nfive", "one\ntwo\nthree\n" * 3]
    found += ['password: "abc123XYZ" user=bob at db.example.org:5432', "AKIA" + "A1" * 10 + " key " + "aB3" * 10, "deadbeef" * 4]
    return list(enumerate([*found, body(4000), body(5), body(90)]))


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7, "y", "z") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_as_the_library(docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoded = tokens.encode(docs, path)
    got = {r.doc_id: (r.ids, r.decoded) for r in tokens.decode(encoded, path).collect()}
    for i, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
    assert tokens.encode(no_docs, path).count() == 0


def test_secrets(docs, no_docs):
    got = {r.doc_id: r for r in secret_scan.scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", secret_scan.span_text("spans").alias("spans")).collect()}
    for i, text in ROWS:
        kinds = [k for k, _, _ in base(text or "")]
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [kinds.count(k) for k in ("assign", "access", "hex")]
        assert (got[i].spans or "") == ",".join(f"{k}:{s}:{e}" for k, s, e in all_spans(text or ""))
    assert secret_scan.scan(no_docs.select("doc_id", "text")).count() == 0


def test_exact_groups(docs, no_docs):
    groups = {}
    for i, text in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    assert got == want
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_packing_keeps_every_id(docs, no_docs):
    path = vocabulary_path()
    ids = {r.doc_id: [*r.ids, 1] for r in tokens.encode(docs, path).collect()}
    pieces = packing.pack(docs, path).collect()
    for doc, whole in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            part = whole[p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, len(part)) == (at, len(whole), p.length)
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p.length
        assert at == len(whole)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 2048
    assert packing.pack(no_docs, path).count() == 0


def test_repeats(docs, no_docs):
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert got == removed([(i, t or "") for i, t in ROWS])
    assert repeats.remove_repeats(no_docs).count() == 0


def test_jaccard_components(docs, no_docs):
    sets = {}
    for i, text in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.component_id for r in jaccard.with_components(docs).collect()} == label
    assert {r.doc_id: r.n_shingles for r in jaccard.shingle_counts(docs).collect()} == {i: len(s) for i, s in sets.items()}
    assert jaccard.with_components(no_docs).count() == 0


def test_line_windows(docs, no_docs):
    seen, want = set(), {}
    for i, text in ROWS:
        lines = [] if text is None else text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if "".join(window).strip(" \t\r\n"):
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
        want[i] = (len(gone), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert {r.doc_id: (r.n_removed, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()} == want
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0


def test_fingerprints(docs, no_docs):
    order = sorted(ROWS, reverse=True)
    following = {i: order[(k + 1) % len(order)][1] or "" for k, (i, _) in enumerate(order)}
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    for i, text in ROWS:
        text = text or ""
        n = len(text) // 3
        assert got[i].edited == text[: len(text) - n] + following[i][:n]
    same = [i for i, t in ROWS if t == "x" * 350]
    assert got[same[0]].own == got[same[1]].own
    assert fingerprints.edited_pairs(no_docs).count() == 0


@pytest.mark.parametrize("classifier, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, docs, no_docs, classifier, column):
    folder = "/root/testdata/sf0.01"
    given, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(given, labels)
    held = {r.doc_id for r in given.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % classifier.FOLDS == classifier.HELD_OUT}
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id in held and r[column] is not None}
    scores = {r.doc_id: r.score for r in classifier.score(given.select("doc_id", "text"), model).collect()}
    right = sum((scores[i] >= 0.5) == bool(t) for i, t in truth.items())
    assert truth and right >= 0.9 * len(truth)
    odd = classifier.score(docs.select("doc_id", "text"), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert classifier.score(no_docs.select("doc_id", "text"), model).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        docs, before = after, set(ids)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == before
