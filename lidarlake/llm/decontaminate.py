"""Benchmark decontamination by spaced seeds: DataFrame functions only.

Tokens are runs of letters and digits, lowered. A mask takes five of eight neighbouring tokens and ignores the
others, so that a substitution at an ignored place leaves the seed as it is. Seeds of documents meet seeds of
benchmark items; a hit fixes an alignment (document place minus item place), and on each alignment the tokens are compared
place by place: an item counts as leaked if some window of WINDOW of its tokens (all, if it is shorter) agrees
in LEAST percent of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import stored

#: Places that a seed takes (fixed values): both have weight 5 and span 8; what one ignores the other takes.
MASKS = ((0, 1, 2, 4, 7), (0, 3, 5, 6, 7))
SPAN = 8
#: For short items, by number of tokens: with these, every alignment that agrees in 80 percent of places shares a seed.
SHORT_MASKS = {(0, 1, 2, 5): range(8, 20), (0, 1, 2, 3): (4,), (0, 1, 2): (3, 6, 7), (0, 1): (2, 5), (0,): (1,)}
WINDOW, LEAST = 20, 80
#: Rows of 16 to 60 bytes that may be broadcast; beyond, joins shuffle.
BROADCAST_SEEDS, BROADCAST_ALIGNMENTS = 1_000_000, 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(df: DataFrame, mask: tuple[int, ...], *keep: str) -> DataFrame:
    """(*keep, place, seed): one mask at each place of ``words`` where a whole span fits.

    Words are hashed first, so that what is generated has five numbers a row; a text that is too short has
    slices of length 0. No filter on the size: it would be pushed below and split each text twice.
    """
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    n = F.greatest(F.size("words") - mask[-1], F.lit(0))
    span = F.arrays_zip(*[F.slice("words", k + 1, n).alias(f"w{k}") for k in mask])
    rows = hashed.select(*keep, F.posexplode(span).alias("place", "w"))
    fields = [F.col("w")[name] for name in rows.schema["w"].dataType.names]
    return rows.select(*keep, "place", F.xxhash64(F.lit(str(mask)), *fields).alias("seed"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, matched, window, overlap): what items leak into ``docs(doc_id, text)``, and how much.

    ``benchmark(item_id, text)``. A row for each document and item with at least ``least`` percent of some window of
    the item's tokens in place; the best window counts. Items that are null or without tokens have no seeds
    and do not leak; null ids are not tested. Rows with the same doc_id (or item_id) are one document
    with several texts. Other columns are ignored; an empty table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.xxhash64("words").alias("item_key")).dropDuplicates(["item_id", "item_key"])
    split, found = docs.select("doc_id", tokens(F.col("text")).alias("words")), None
    for mask in (*MASKS, *SHORT_MASKS):
        fit = F.size("words").isin(*SHORT_MASKS[mask]) if mask in SHORT_MASKS else F.size("words") >= SPAN
        wanted = seeds(items.where(fit), mask, "item_id", "item_key").withColumnRenamed("place", "item_place")
        n = wanted.limit(BROADCAST_SEEDS + 1).count()
        if not n and mask in SHORT_MASKS:
            continue
        if n <= BROADCAST_SEEDS:
            wanted = F.broadcast(wanted)
        hits = seeds(split, mask, "doc_id").join(wanted, "seed").select("doc_id", "item_id", "item_key", (F.col("place") - F.col("item_place")).alias("shift"))
        found = hits if found is None else found.unionByName(hits)
    found = stored(found.distinct(), "alignments")
    aligned = F.broadcast(found) if found.limit(BROADCAST_ALIGNMENTS + 1).count() <= BROADCAST_ALIGNMENTS else found
    both = docs.join(aligned, "doc_id").withColumn("words", tokens(F.col("text"))).drop("text")
    both = both.join(items.withColumnRenamed("words", "item_words"), ["item_id", "item_key"])
    same = F.transform(F.col("item_words"), lambda w, k: F.when(F.get("words", k + F.col("shift")) == w, 1).otherwise(0))
    both = both.select("doc_id", "item_id", same.alias("same"), F.least(F.size("item_words"), F.lit(window)).alias("window"))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("window") + 1),
        lambda i: F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, x: a + x))
    both = both.select("doc_id", "item_id", F.array_max(sums).cast("long").alias("matched"), F.col("window").cast("long").alias("window"))
    best = both.where(100 * F.col("matched") >= least * F.col("window")).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("window")).alias("overlap"), "matched", "window")).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.window", "b.overlap")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents into which an item leaks; all its columns and other rows stay."""
    leaked = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
