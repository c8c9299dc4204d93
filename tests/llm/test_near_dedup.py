import random

import numpy as np
import pytest

from glyphframe.llm import near_dedup
from glyphframe.llm.graph import components
from glyphframe.llm.runtime import Scratch
from glyphframe.llm.shingles import shingle_sets

from .conftest import words_of


def shingles(text):
    words = words_of((text or "").lower() if (text or "").isascii() else text)
    words = [w.lower() for w in words]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute(docs):
    """docs: (id, text); components by all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def corpus(n=160):
    rng = random.Random(2)
    docs, bases = [], [[f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 30, 120)))] for _ in range(25)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("paired", [2, 32])
def test_components_equal_all_pairs(spark, monkeypatch, paired):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    docs = corpus()
    want = brute(docs)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    for r in rows:
        assert r.n_shingles == len(shingles(dict(docs)[r.doc_id])) and r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.component_id, r.n_shingles, r.kept))
    assert [c for i in (1, 2) for c, _, _ in by_id[i]] == [1, 1, 1] and by_id[9][0][0] == 1
    assert by_id[6][0][0] == 5 and by_id[8][0][0] == 7
    assert all(by_id[i] == [(i, 0, True)] for i in (3, 4, 10))
    assert all(c is None and kept for c, _, kept in by_id[None])
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 7, 10, 11]


def test_an_id_with_two_texts_ties_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {1}


def test_every_coordinate_fills_and_estimates(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        flat = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (near_dedup.sketches(flat, np.array([0, n])) != near_dedup._EMPTY).all()
    shared, own = rng.integers(0, 2**63, 600).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([shared, own[:200]]), np.concatenate([shared, own[200:]])
    rows = near_dedup.sketches(np.concatenate([a, b]), np.array([0, 800, 1600]))
    assert abs((rows[0] == rows[1]).mean() - 0.6) < 0.15


def test_shingles_of_short_texts():
    flat, bounds = shingle_sets([b"one two", b"ONE  two", b"", None, b"a b c d e f"])
    assert np.diff(bounds).tolist() == [1, 1, 0, 0, 2] and flat[0] == flat[1]


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(Scratch(spark), edges).collect()}
    assert set(got) == {*range(61), 100, 101} and {got[i] for i in range(61)} == {0} and got[101] == 100
    assert components(Scratch(spark), edges.where("a > 1000")).count() == 0
