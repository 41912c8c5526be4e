"""Templates of a leaf of any size: every pair that agrees is found."""

import random

import numpy as np
import pytest

from lidarlake.llm import lines


def brute(rows, similar):
    """template -> smallest template that links reach, all pairs compared."""
    head = {h: h for h, _ in rows}
    again = True
    while again:
        again = False
        for h, t in rows:
            for g, u in rows:
                if 100 * sum(a == b for a, b in zip(t, u)) >= similar * len(t) and head[g] < head[h]:
                    head[h], again = head[g], True
    return {h: x for h, x in head.items() if x != h or any(y == h and g != h for g, y in head.items())}


@pytest.mark.parametrize("block", [2000, 25, 4])
def test_templates_equal_brute_force(spark, block):
    r, rows = random.Random(block), []
    for leaf, size in ((1, 6), (2, 10), (3, 17)):
        for _ in range(12):
            t = [7, 8, 9] + [r.randint(1, 4) for _ in range(size - 3)]
            for _ in range(5):
                u = t[:]
                for k in r.sample(range(3, size), r.randint(0, size // 4)):
                    u[k] = r.randint(0, 6)
                rows.append((leaf, len(rows) - 50, u))
    want = {}
    for leaf in (1, 2, 3):
        want |= brute([(h, t) for f, h, t in rows if f == leaf], 80)
    df = spark.createDataFrame([(f, h, bytearray(np.array(t, np.int32).tobytes())) for f, h, t in rows], "leaf long, template long, tokens binary")
    got = lines.generalised(df, df.groupBy("leaf").count().withColumnRenamed("count", "n"), 80, block)
    assert {x.template: x.head for x in got.collect()} == want


def test_pairs_in_a_large_leaf(spark):
    """A leaf of 4200 templates with 100 pairs that agree in 9 of 10 tokens: all found."""
    r, docs = random.Random(9), []
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    for k in range(4000):
        docs.append((k, "in the end " + " ".join(word() for _ in range(7))))
    for k in range(100):
        t = ["in", "the", "end", *(word() for _ in range(7))]
        docs.append((10_000 + k, " ".join(t)))
        t[r.randint(3, 9)] = word()
        docs.append((20_000 + k, " ".join(t)))
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x.doc_id for x in out.where("n_dropped > 0").collect()) == [20_000 + k for k in range(100)]


def test_empty_leaves(spark):
    assert lines.generalised(spark.createDataFrame([], "leaf long, template long, tokens binary"), spark.createDataFrame([], "leaf long, n long"), 80).count() == 0
