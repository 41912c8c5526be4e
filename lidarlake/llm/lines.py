"""Line deduplication by a log-template tree.

A line's fields that vary (tokens with digits, addresses) become wildcards; what is left is its template. The
tree has a fixed depth: token count, then the first DEPTH tokens. In a leaf, templates that agree in SIMILAR
percent of their places are linked, and what links connect generalises to one template, the places in which they differ
being wildcards. A template that occurs in several documents stays in the first of them (smallest doc_id) and its lines
are dropped from all others.

Only hashes of lines are shuffled to count templates; token hashes only of leaves with several templates. A leaf of at
most BLOCK templates is compared in one task. In a larger one, templates are compared where they share one of the parts
into which their places are split, one part more than may differ, so that no pair is missed; a part that very many
share is compared block by block. No result depends on block or order.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import small, stored
from lidarlake.llm.components import components

DEPTH, SIMILAR, BLOCK = 3, 80, 2000
#: Shorter lines (in tokens) have no template: only equal ones count, and in MANY documents, for that they recur in a few says nothing.
LEAST_TOKENS = 6
#: Shorter still (in tokens), lines are left alone: brackets, headings of a word or two.
LEAST_SHORT, MANY = 3, 5
#: Hashes of leaves (8 bytes each) that may be broadcast.
BROADCAST_LEAVES = 1_000_000
_WILD = "<*>"
_VARIES = re.compile(r"\d|://|@").search
#: Scripts without blanks between words (Thai to Burmese, Khmer, kana, Han): two characters count as one token.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]").findall


def template(line: str) -> list[str]:
    t = line.split()
    return [_WILD if _VARIES(x) else x for x in t] if _VARIES(line) else t


def _hash(tokens: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest("\x1f".join(tokens).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def leaf(tokens: list[str]) -> int:
    return _hash([str(len(tokens)), *tokens[:DEPTH]])


def needed(line: str, tokens: int, least: int) -> int:
    """Documents in which a line without a template must recur to be dropped; 0 if it never is."""
    n = tokens if line.isascii() else max(tokens, len(_UNSPACED(line)) // 2)
    return 2 if n >= least else MANY if n >= LEAST_SHORT else 0


_LINES = "doc_id long, text_key long, line int, leaf long, template long, needs int"


def _lines(batches, least: int):
    for batch in small(batches):
        out = []
        for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for k, line in enumerate(text.split("\n")):
                if len(line) >= 2 * least - 1 and len(t := template(line)) >= least:
                    out.append((doc, key, k, leaf(t), _hash(t), None))
                elif len(line) >= 2 * LEAST_SHORT - 1 and (n := needed(line, len(t := line.split()), least)):
                    out.append((doc, key, k, None, _hash(["\x1e", *t]), n))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "text_key", "line", "leaf", "template", "needs"])


def _tokens(batches, least: int):
    """Each template of a batch once, with the hashes of its tokens."""
    known: dict[str, int] = {_WILD: 0}
    for batch in small(batches):
        out = {}
        for text in batch.column(0).to_pylist():
            for line in text.split("\n"):
                if len(line) >= 2 * least - 1 and len(t := template(line)) >= least and (h := _hash(t)) not in out:
                    if len(known) > 120_000:
                        known.clear()
                        known[_WILD] = 0
                    for x in t:
                        if x not in known:
                            known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF | 1
                    out[h] = (leaf(t), np.array([known[x] for x in t], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.binary())], names=["template", "leaf", "tokens"])


def _roots(size: int):
    """Union-find over 0 .. size - 1: (find, join); the smaller root wins."""
    up = list(range(size))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    return find, join


def links(tokens: np.ndarray, similar: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest over the rows of ``tokens``: its trees are what pairs that agree in ``similar`` percent of places connect.

    With ``sides``, only pairs of different sides are compared. A row is not compared with its own tree."""
    n, size = tokens.shape
    find, join = _roots(n)
    out = []
    for k in range(1, n):
        same = 100 * (tokens[:k] == tokens[k]).sum(axis=1) >= similar * size
        if sides is not None:
            same &= sides[:k] != sides[k]
        for j in np.flatnonzero(same).tolist():
            if find(j) != find(k):
                join(j, k)
                out.append((j, k))
    return out


def parts(tokens: np.ndarray, similar: int) -> list[bytes]:
    """Keys of a template: its places after the first DEPTH (equal in the leaf), dealt over one part more than may differ.

    Two templates that agree in ``similar`` percent of all places have a part in common (pigeonhole principle)."""
    n = len(tokens)
    differ = n - -(-similar * n // 100)
    rest = tokens[min(DEPTH, n) :]
    cuts = np.linspace(0, len(rest), differ + 2).astype(int).tolist()
    return [k.to_bytes(4, "big") + rest[i:j].tobytes() for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]


def _keys(batches, similar: int):
    """A row for each part of each template."""
    for batch in small(batches):
        out = []
        for lf, h, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for key in parts(np.frombuffer(raw, np.int32), similar):
                out.append((xxhash.xxh3_64_intdigest(lf.to_bytes(8, "big", signed=True) + key) - (1 << 63), h, raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "template", "tokens"])


def _compare(batches, similar: int):
    """Rows (bucket, p, q, side, template, tokens) sorted by bucket, p, q: links of each block of a bucket, as (a, b)."""
    now, rows = None, []

    def out():
        by_size: dict[int, list] = {}  # only a clash of hashes puts templates of several sizes into one bucket
        for r in rows:
            by_size.setdefault(len(r[2]), []).append(r)
        a, b = [], []
        for same in by_size.values():
            sides = None if now[1] == now[2] else np.array([r[0] for r in same])
            for i, j in links(np.frombuffer(b"".join(r[2] for r in same), np.int32).reshape(len(same), -1), similar, sides):
                a.append(same[i][1])
                b.append(same[j][1])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for bucket, p, q, side, h, raw in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if now != (bucket, p, q):
                if rows:
                    yield out()
                now, rows = (bucket, p, q), []
            rows.append((side, h, raw))
    if rows:
        yield out()


def compared(rows: DataFrame, similar: int, block: int) -> DataFrame:
    """(a, b) links in each bucket of ``rows(bucket, template, tokens, n)``; of more than ``block`` rows, each pair of blocks is a task's."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("template"), blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "template", "tokens")
    rows = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "template")
    return rows.mapInArrow(partial(_compare, similar=similar), "a long, b long")


def generalised(rows: DataFrame, sizes: DataFrame, similar: int, block: int | None = None) -> DataFrame:
    """(template, head) of the templates that a link joins to others; head is the smallest of what links connect.

    ``rows(leaf, template, tokens)``, ``sizes(leaf, n)``. A leaf of at most ``block`` templates is compared in one task; in
    larger ones the templates that share a part are. Either way every pair that agrees is found."""
    block = block or BLOCK
    rows = rows.join(sizes, "leaf")
    few = compared(rows.where(F.col("n") <= block).withColumnRenamed("leaf", "bucket"), similar, block)
    if sizes.where(F.col("n") > block).isEmpty():
        return settled(few)
    keyed = rows.where(F.col("n") > block).select("leaf", "template", "tokens").mapInArrow(partial(_keys, similar=similar), "bucket long, template long, tokens binary")
    keyed = stored(keyed, "parts")
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return settled(few.unionByName(compared(keyed.join(counts, "bucket"), similar, block)))


def settled(edges: DataFrame) -> DataFrame:
    return components(stored(edges.distinct(), "links")).select(F.col("node").alias("template"), F.col("component").alias("head"))


def recurring(docs: DataFrame, lines: DataFrame, least: int, similar: int) -> DataFrame:
    """(template, stays): templates found in several documents and the one in which their lines stay."""
    counts = stored(lines.groupBy("leaf", "template").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "templates")
    leaves = counts.groupBy("leaf").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1 and low != high").select("leaf", "n")
    leaves = stored(leaves, "leaves")
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    rows = docs.select("text").mapInArrow(partial(_tokens, least=least), "template long, leaf long, tokens binary")
    rows = rows.join(F.broadcast(leaves.select("leaf")) if small else leaves.select("leaf"), "leaf", "left_semi")
    rows = rows.groupBy("leaf", "template").agg(F.first("tokens").alias("tokens"))
    heads = generalised(rows, leaves, similar)
    counts = counts.join(heads, "template", "left").select("template", F.coalesce("head", "template").alias("head"), "low", "high")
    tops = counts.groupBy("head").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high")
    return counts.join(tops.select("head", F.col("low").alias("stays")), "head").select("template", "stays")


def recurring_short(lines: DataFrame) -> DataFrame:
    """(template, stays): lines without a template that recur, word for word, in as many documents as they need."""
    counts = lines.groupBy("template", "needs").agg(F.min("doc_id").alias("stays"), F.count_distinct("doc_id").alias("n"))
    return counts.where("n >= needs").select("template", "stays")


def _rewrite(batches, columns: int, at: int):
    for batch in small(batches):
        texts = []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(columns).to_pylist()):
            if gone:
                gone = set(gone)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            texts.append(text)
        cols = [*batch.columns[:columns]]
        cols[at] = pa.array(texts, batch.schema.field(at).type)
        n = pa.array([len(x) if x else 0 for x in batch.column(columns).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*cols, n], names=[*batch.schema.names[:columns], "n_dropped"])


def dedup_lines(docs: DataFrame, least: int = LEAST_TOKENS, similar: int = SIMILAR) -> DataFrame:
    """``docs`` (all its columns, rows kept) with recurring lines taken out of ``text``, and n_dropped, how many.

    A line of ``least`` tokens or more whose template occurs in several documents stays only in the one with
    the smallest doc_id, and so does a line of LEAST_SHORT tokens or more that is found word for word in MANY. In scripts
    without blanks two characters count as a token, and only equal lines are found. Ties: the smallest doc_id has a line's
    place whatever the order of rows; very long lines are compared whole. Repeats within one document stay. Null and empty texts, and rows with a null doc_id, are left alone
    and do not count. Rows with the same doc_id are one document. A column ``n_dropped`` of the input is replaced. An empty
    table gives no rows.
    """
    docs = docs.drop("n_dropped")
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    used = used.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    lines = stored(used.mapInArrow(partial(_lines, least=least), _LINES), "lines")
    long, short = lines.where("needs is null"), lines.where("needs is not null")
    gone = lines.join(recurring(used, long, least, similar).unionByName(recurring_short(short)), "template").where("doc_id != stays")
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).agg(F.collect_set("line").alias("_gone_lines"))
    names = docs.columns
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_gone_key")), "left").select(*names, "_gone_lines")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return out.mapInArrow(partial(_rewrite, columns=len(names), at=names.index("text")), f"{kinds}, n_dropped long")
