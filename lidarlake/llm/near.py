"""Near-duplicate documents: multi-index Hamming join over b-bit MinHash signatures, exact confirmation.

A document's set is its distinct ``size``-word shingles (64-bit hashes). Equal sets form a class and go on
as one member. A signature has CHUNKS x SLOTS minhashes of 16 bits. By the pigeonhole principle two
signatures that differ in at most ``2 * CHUNKS - 1`` slots share a chunk with at most one wrong slot, so a
member gets one key for each slot left out of each chunk (the enumerated chunk errors), and members that
share a key are candidates. All pairs under that distance are found for certain; a pair of similarity 0.8
misses with probability 0.263 ** CHUNKS.

Candidates never become all pairs of a group. First each member meets only the two ends of each of its
buckets and what is confirmed on full sets is joined into components. Then, bucket by bucket, only members of
different components are compared: in blocks, by signature, in memory; only what lies within the signature
distance is confirmed on full sets. So no link that could change a component is left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import Hashes, mix, shingles, small, stored, words
from lidarlake.llm.components import components

CHUNKS, SLOTS = 8, 5
#: Signatures that differ in more of the 40 slots are not confirmed: at similarity 0.8 the mean is 8, the deviation 2.5.
MOST_WRONG = 19
#: Members of a bucket that are compared with each other in one block.
BLOCK = 1000
#: Of larger buckets the blocks hold texts too, and confirm on full sets what they find; no pairs leave them.
LARGE = 64
_MULTIPLY = mix(np.arange(1, CHUNKS * SLOTS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of CHUNKS * SLOTS minima over a non-empty set of hashes."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(low, mix(s[k : k + 4096, None] * _MULTIPLY).min(axis=0), out=low)
    return low.astype(np.uint16)


def keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and each of its slots that may be wrong."""
    out, part = [], sig.reshape(CHUNKS, SLOTS).astype(np.uint64)
    for leave in range(SLOTS):
        h = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(SLOTS) + np.uint64(leave + 1)
        for k in range(SLOTS):
            if k != leave:
                h = mix((h << np.uint64(16)) + h + part[:, k])
        out.append(h)
    return np.concatenate(out).view(np.int64)


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())])


def _members(batches, size: int):
    seen = Hashes()
    for batch in small(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(seen.of(words(text)), size)
            if len(s):
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()))
            else:
                rows.append((doc, 0, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MEMBERS)] if rows else [pa.array([], f.type) for f in _MEMBERS], schema=_MEMBERS)


def _keyed(batches):
    for batch in batches:
        ids, sigs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        if not len(ids):
            continue
        k = np.concatenate([keys(np.frombuffer(x, np.uint16)) for x in sigs])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, CHUNKS * SLOTS)), pa.array(k)], names=["sid", "key"])


def _wrong(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _within(batches):
    """Pairs whose signatures are within MOST_WRONG."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.filter(pa.array(_wrong(a, b) <= MOST_WRONG)).select([0, 1])


def _confirm(batches, size: int, least: int):
    """Rows sorted by hub, the hub's own row first: pairs with 100 * intersection >= least * union."""
    seen, hub, own = Hashes(), None, None
    for batch in small(batches):
        a, b = [], []
        for h, member, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            s = shingles(seen.of(words(text)), size)
            if member is None:
                hub, own = h, s
            elif h == hub:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= least * (len(own) + len(s) - both):
                    a.append(h)
                    b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _here(sig: np.ndarray, others: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first key that a signature shares with each of others: one bucket takes a pair, not all."""
    wrong = (others != sig).reshape(-1, CHUNKS, SLOTS)
    few = wrong.sum(axis=2) <= 1
    chunk = few.argmax(axis=1)
    at = np.arange(len(others))
    leave = wrong[at, chunk].argmax(axis=1)  # 0 if none is wrong
    return (keys(sig).reshape(SLOTS, CHUNKS)[leave, chunk] == key) | ~few.any(axis=1)


def _across(key, ids, comp, sig, side, texts, size: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components within MOST_WRONG: of one block (side is None), or one of each side.

    Members of the most frequent component never meet each other, so only the rest walk over the block.
    A pair that shares several buckets is taken in the first of them alone.
    With texts, the pairs are confirmed on full sets."""
    values, counts = np.unique(comp, return_counts=True)
    if len(values) < 2:
        return []
    out, rest = [], np.flatnonzero(comp != values[counts.argmax()])
    if texts is not None:
        seen = Hashes()
        sets = [shingles(seen.of(words(x)), size) for x in texts]
        n = np.array([len(x) for x in sets])
    for i in rest:
        near = (comp != comp[i]) & (_wrong(sig, sig[i]) <= MOST_WRONG)
        if side is not None:
            near &= side != side[i]
        at = np.flatnonzero(near)
        at = at[_here(sig[i], sig[at], key)] if len(at) else at
        if texts is not None and len(at):
            others = np.concatenate([sets[k] for k in at])
            place = np.minimum(np.searchsorted(sets[i], others), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][place] == others).astype(np.int64), np.concatenate([[0], np.cumsum(n[at])[:-1]]))
            at = at[100 * both >= least * (n[at] + n[i] - both)]
        if len(at):
            out.append((np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])))
    return out


def _blocks(batches, size: int, least: int):
    """Rows (key, p, q, side, sid, component, sig[, text]) sorted by block: cross pairs of each block of a bucket."""
    rest = None

    def flush(t):
        cols = [t.column(k).to_numpy() for k in range(6)]
        sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(t.num_rows, -1)
        cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        cuts = [0, *cuts.tolist(), t.num_rows]
        out = []
        for i, j in zip(cuts, cuts[1:]):
            side = None if cols[1][i] == cols[2][i] else cols[3][i:j]
            texts = t.column(7).slice(i, j - i).to_pylist() if t.num_columns > 7 else None
            out += _across(cols[0][i], cols[4][i:j], cols[5][i:j], sig[i:j], side, texts, size, least)
        a, b = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        key = [t.column(k).to_numpy() for k in range(3)]
        last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = t.slice(cut)
        if cut:
            yield flush(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield flush(rest)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, least: int, salts: int = 16) -> DataFrame:
    """(a, b) of ``pairs`` that are similar on full sets. A hub's members are dealt over ``salts`` tasks,
    to each of which the hub's text goes once; the sets of one hub and one member are in memory at a time."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    wanted = pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.col("b").alias("member"), "salt").unionByName(
        pairs.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.lit(None).cast("long").alias("member"), "salt").distinct())
    rows = wanted.join(docs, "doc_id").select("hub", "member", "text", "salt")
    rows = rows.repartition("hub", "salt").sortWithinPartitions(F.col("hub"), F.col("salt"), F.col("member").asc_nulls_first())
    return rows.mapInArrow(partial(_confirm, size=size, least=least), "a long, b long")


def _distance_filter(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    pairs = pairs.join(sigs.select(F.col("sid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("sig").alias("sig_b")), "b")
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_within, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= least * |union| of their sets of distinct ``size``-word
    shingles (A-Z lowered; a shorter text is one shingle). component_id: smallest doc_id reachable by links.
    Texts that are null, empty or without words have an empty set, are linked with nothing and are kept.
    Rows with the same doc_id are one document each but share the component of the first; a row whose doc_id
    is null is never linked (component null, kept). Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = stored(docs.mapInArrow(partial(_members, size=size), "doc_id long, n_shingles long, set_hash binary, sig binary"), "members")
    classes = members.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("sid"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")
    sigs = classes.select("sid", "sig")
    buckets = sigs.mapInArrow(_keyed, "sid long, key long")
    ends = buckets.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low != high")
    met = stored(buckets.join(ends, "key"), "buckets")  # only members of shared buckets
    pairs = met.where("sid != low").select(F.col("low").alias("a"), F.col("sid").alias("b")).unionByName(
        met.where("sid != high").select(F.col("sid").alias("b"), F.col("high").alias("a")).select("a", "b"))
    pairs = pairs.distinct()
    # a pair can come with either end as hub
    pairs = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("a")).groupBy("lo", "hi").agg(F.min("a").alias("a"))
    pairs = pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    edges = stored(confirmed(_distance_filter(pairs, sigs), docs, size, least), "links")
    comp = stored(components(edges), "components")
    # what is left: members of one bucket in different components
    left = met.select("key", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("component"))
    mixed = left.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 != c1")
    left = left.join(mixed.select("key", "n"), "key").join(sigs, "sid")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = left.withColumn("mine", F.pmod(F.xxhash64("sid"), blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = ["key", "p", "q", "side", "sid", "component", "sig"]
    left = left.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "sid", "component", "sig", "n")
    left = stored(left, "mixed")

    def across(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")
        return rows.mapInArrow(partial(_blocks, size=size, least=least), "a long, b long").distinct()

    few = confirmed(across(left.where(F.col("n") <= LARGE).select(columns)), docs, size, least)
    many = across(left.where(F.col("n") > LARGE).join(docs.withColumnRenamed("doc_id", "sid"), "sid").select(*columns, "text"))
    more = stored(few.unionByName(many), "links")
    comp = stored(components(edges.unionByName(more)), "components")
    by_set = classes.select("set_hash", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("set_hash", F.coalesce("component", "sid").alias("component_id"))
    out = members.select("doc_id", "n_shingles", "set_hash").join(by_set, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """``docs`` (all its columns) with one row of each group of near duplicates: that of the smallest doc_id.

    Rows that share a doc_id stay or go together. Rows without an id or without words stay."""
    gone = near_duplicates(docs, size, least).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone_id"), "left_anti")
