import random

import numpy as np
import pytest

from lidarlake.llm import near
from lidarlake.llm.common import words
from lidarlake.llm.components import components


def sets(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, size, least=80):
    s, up = {d: sets(t, size) for d, t in texts.items()}, {d: d for d in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = len(s[a]), len(s[b])
            if x and y and 100 * min(x, y) >= least * max(x, y):
                both = len(s[a] & s[b])
                if 100 * both >= least * (x + y - both):
                    p, q = top(a), top(b)
                    up[max(p, q)] = min(p, q)
    return {d: (len(s[d]), top(d)) for d in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(corpus, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(corpus, size).collect()}
    assert got == brute(texts, size)


def test_group_of_many_different_near_copies(spark, monkeypatch):
    """Blocks, large buckets and several rounds: copies that resemble a base more than each other."""
    monkeypatch.setattr(near, "LARGE", 8)
    monkeypatch.setattr(near, "BLOCK", 10)
    r, vocabulary = random.Random(5), [f"w{k}" for k in range(500)]
    base = [r.choice(vocabulary) for _ in range(80)]
    texts = {}
    for d in range(70):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(80)] = r.choice(vocabulary)
        texts[d] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_duplicates(df, 2).collect()}
    assert got == brute(texts, 2)


def test_awkward_and_empty_tables(awkward, empty):
    rows = near.near_duplicates(awkward, 2).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[d].component_id for d in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 5, 5, 7, 7]
    assert by[2].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[7].n_shingles == 1 and not by[8].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near.near_duplicates(empty, 2).collect() == []
    kept = near.keep_one(awkward, 2)
    assert kept.columns == awkward.columns and kept.where("doc_id in (6, 8)").count() == 0 and kept.where("doc_id is null").count() == 2


def test_signatures_within_the_bound_share_a_key():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 16, near.CHUNKS * near.SLOTS).astype(np.uint16)
        b = a.copy()
        at = r.choice(len(a), 2 * near.CHUNKS - 1, replace=False)
        b[at] ^= 1
        assert set(near.keys(a)) & set(near.keys(b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 21)] + [(100 + k, 101 + k) for k in range(40)] + [(None, 1), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20} | {100 + k: 100 for k in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
