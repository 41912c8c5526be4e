from itertools import combinations

from lidarlake.llm import decontaminate


def test_every_alignment_shares_a_seed():
    """All patterns of substitutions that leave 80 percent of an item in place, up to 20 tokens."""
    for m in range(1, 21):
        masks = [*(decontaminate.MASKS if m >= decontaminate.SPAN else ()), *(k for k, sizes in decontaminate.SHORT_MASKS.items() if m in sizes)]
        for bad in map(set, combinations(range(m), m - -(-4 * m // 5))):
            assert any(not bad & {p + o for o in k} for k in masks for p in range(m - k[-1])), (m, bad)


def test_short_items_leak(spark):
    item = lambda n: [f"t{n}x{k}" for k in range(n)]
    swap = lambda n, *at: " ".join("zz" if k in at else x for k, x in enumerate(item(n)))
    bench = spark.createDataFrame([(n, " ".join(item(n))) for n in (1, 2, 3, 4, 5, 7, 8, 10, 15)], "item_id long, text string")
    docs = {1: swap(1), 2: swap(2), 3: swap(3), 4: swap(4), 5: swap(5, 2), 7: swap(7, 3), 8: swap(8, 0), 10: swap(10, 2, 6), 15: swap(15, 3, 7, 11), 20: swap(4, 1), 21: swap(5, 1, 2), 22: swap(8, 0, 7)}
    df = spark.createDataFrame([(d, f"a b c {t} d e") for d, t in docs.items()], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(n, n) for n in (1, 2, 3, 4, 5, 7, 8, 10, 15)}
