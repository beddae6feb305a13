"""The Jaccard join against all pairs, over a whole table and where every document holds one passage."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from armlight.llm import jaccard
from armlight.llm.queries import op7_jaccard_join


def sets_of(texts):
    """{id: shingles} for (id, text) rows; rows of one id are kept apart as a list."""
    out = []
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()))
    return out


def components(sets):
    """Smallest reachable id, every pair of rows that share a shingle compared."""
    above = {i: i for i, _ in sets}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    having = {}
    for k, (_, s) in enumerate(sets):
        for shingle in s:
            having.setdefault(shingle, []).append(k)
    done = set()
    for k, (i, a) in enumerate(sets):
        for other in {o for shingle in a for o in having[shingle] if o > k}:
            j, b = sets[other]
            # a pair within one component changes nothing
            if (k, other) not in done and root(i) != root(j) and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                above[high] = low
    return {i: root(i) for i in above}


def test_all_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = sets_of(rows)
    got = op7_jaccard_join(spark, folder).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets} and len(got) == len(rows)


@pytest.mark.parametrize("hot", [100_000, 0])
def test_one_passage_in_every_document(spark, monkeypatch, hot):
    """Every document holds one passage, a third are near copies, others sit around the bound."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "CELL", 40)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    copied = rng.choices(words, k=80)
    rows = []
    for i in range(400):
        own = list(copied) if i % 3 == 0 else rng.choices(words, k=rng.choice([0, 3, 10, 40, 90]))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i * 7 + 3, " ".join(own + passage)))
    rows += [(5, rows[0][1]), (5, "another text of the same id " + "x y z " * 9), (6, "another text of the same id " + "x y z " * 9), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = sets_of(rows)
    assert {r.id: r.label for r in jaccard.components(docs).collect()} == components(sets)


def test_long_texts_and_no_ids(spark):
    rng = random.Random(2)
    long = [str(rng.randrange(10**6)) for _ in range(120_000)]
    changed = list(long)
    for k in rng.sample(range(len(long)), 2_000):
        changed[k] = "new"
    rows = [(9, " ".join(long)), (2, " ".join(changed)), (None, " ".join(long)), (None, None), (4, " \t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"label": docs_column(), "id": docs_column()})
    got = jaccard.with_components(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(2, 2), (4, 4), (9, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_tree_sums_of_the_largest_uncut_counts():
    """Sums of 16 bits hold 254 in each group: no pair is lost at the top of their range."""
    points = np.full((200, jaccard.GROUPS), 254, np.uint8)
    points[::3, ::2] = 0
    sizes = points.sum(1, dtype=np.int64)
    query, entry = jaccard.CountTree(points, sizes, np.arange(200)).search(points, sizes, np.arange(200))
    shared = np.minimum(points[:, None], points[None]).sum(2, dtype=np.int64)
    near = (180 * shared >= 80 * (sizes[:, None] + sizes[None])) & ~np.eye(200, dtype=bool)
    assert set(zip(query.tolist(), entry.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(near))))


@pytest.mark.parametrize("most", [200, 255])
def test_cells_of_many_sizes_in_batches(monkeypatch, most):
    """Small cells are compared together, without a tree each, wherever batches end; no pair of a cell is lost."""
    rng = np.random.default_rng(4)
    built = []
    tree = jaccard.CountTree
    monkeypatch.setattr(jaccard, "CountTree", lambda *a: built.append(len(a[0])) or tree(*a))
    frames, near, loose = [], set(), set()
    base = rng.integers(0, 4, (6, jaccard.GROUPS))
    base[0, 0] = most
    for cell, n in enumerate([2] * 300 + [3, 64, 65, 1, 150, 40, 90]):
        # of each three cells of a shingle, the second is one of two parts
        i, j = ((0, 0), (0, 1), (1, 1))[cell % 3]
        points = np.maximum(base[rng.integers(0, 6, n)] - rng.integers(0, 2, (n, jaccard.GROUPS)) * rng.integers(0, 2, (n, 1)), 0)
        points[:, 0] = np.where(points[:, 0] >= most - 1, most, points[:, 0])
        sizes, ids = points.sum(1), rng.permutation(1000)[:n]
        labels, part = ids % 7, rng.integers(i, j + 1, n)
        frames.append(pd.DataFrame({
            "shingle": cell // 3, "i": i, "j": j, "id": ids, "label": labels, "part": part, "size": sizes,
            "point": [p.astype(np.uint8).tobytes() for p in points],
        }).astype({"i": "int32", "j": "int32", "part": "int32"}))
        bounds = np.where(points == 255, 65535, points)
        for x in range(n):
            for y in range(x):
                shared = np.minimum(bounds[x], bounds[y]).sum()
                if labels[x] != labels[y] and (i == j or part[x] != part[y]) and 180 * shared >= 80 * (sizes[x] + sizes[y]):
                    pair = min(ids[x], ids[y]), max(ids[x], ids[y])
                    loose.add(pair)
                    if 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y]):
                        near.add(pair)
    rows = pa.Table.from_pandas(pd.concat(frames), preserve_index=False)
    assert near
    for size in (10_000, 97, 1):
        built.clear()
        found = [b.to_pandas() for b in jaccard._cell_pairs(iter(rows.combine_chunks().to_batches(max_chunksize=size)))]
        assert near <= set(pd.concat(found).itertuples(index=False, name=None)) <= loose
        assert len(built) <= 3
    assert not list(jaccard._cell_pairs(iter([])))
