"""Best-fit packing of documents into sequences by the linear grouping scheme, on the histogram of lengths.

Lengths are integers below the sequence size, so a histogram of them is small whatever the corpus. On it:
the large lengths are split into groups of equal cardinality and rounded up to their group's largest; for these
few sizes a fractional optimum over configurations is found by column generation and rounded down, what is
left over is placed best-fit; then the actual lengths replace the rounded ones (as runs of equal lengths,
never document by document) and the small lengths go best-fit into the gaps. Rounding leaves gaps where small lengths are
few: sequences with free room (and, if that helps, those of many lengths) are then taken apart and filled best-fit, at the limit that gives fewest. The plan says which ranks of each
length go to which sequences; documents look up their rank. Nothing but the histogram and the per-shard
counts of lengths leaves the executors.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarlake.llm.common import small, stored
from lidarlake.llm.tokens import encoder as encoder_of

GROUPS = 96
#: Lengths over capacity / SMALL are large.
SMALL = 3
#: With at most so many shards (of at most ``capacity`` lengths, 16 bytes each) their first ranks are broadcast.
BROADCAST_SHARDS = 2000
PIECES = "doc_id long, piece int, start long, length int, ids binary, shard int, place long"


# ---- the plan, on the driver -------------------------------------------------------------------------


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Best value of a sequence and how often each size is taken; sizes are large, so few fit, and one more is tried at a time."""
    room = np.arange(capacity + 1)
    best, took = [np.zeros(capacity + 1)], []
    rest = room[None, :] - sizes[:, None]
    for _ in range(capacity // int(sizes.min())):
        x = np.where(rest >= 0, values[:, None] + best[-1][np.maximum(rest, 0)], -1.0)
        k = x.argmax(axis=0)
        x = x[k, room]
        took.append(np.where(x > best[-1] + 1e-12, k, -1))
        best.append(np.maximum(x, best[-1]))
    counts, c = [0] * len(sizes), capacity
    for k in reversed(took):
        if k[c] >= 0:
            counts[k[c]] += 1
            c -= sizes[k[c]]
    return float(best[-1][capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Fractional optimum: (how often each size, how many sequences). Column generation over a basis."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, d)
        price = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(price, np.array(sizes), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(column, float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, d)
    return [([round(v) for v in basis[:, k]], max(0.0, float(x[k]))) for k in range(n)]


@dataclass
class Run:
    """``count`` sequences alike: the lengths in them, in order, and what is free."""

    lengths: tuple[int, ...]
    count: int
    free: int


class _BestFit:
    """Runs by free room; a length goes to the fullest sequences that take it, else to new ones."""

    def __init__(self, capacity: int):
        self.capacity, self.by_free = capacity, defaultdict(Counter)

    def put(self, lengths: tuple[int, ...], count: int) -> None:
        if count:
            self.by_free[self.capacity - sum(lengths)][lengths] += count

    def place(self, length: int, count: int) -> None:
        while count:
            free = min((f for f, runs in self.by_free.items() if f >= length and runs), default=None)
            if free is None:
                each = self.capacity // length
                whole, rest = divmod(count, each)
                self.put((length,) * each, whole)
                self.put((length,) * rest, 1 if rest else 0)
                return
            lengths, there = next(iter(self.by_free[free].items()))
            each = free // length
            if there * each <= count:
                n, taken = there, each
            elif count >= each:
                n, taken = count // each, each
            else:
                n, taken = 1, count
            del self.by_free[free][lengths]
            self.put(lengths, there - n)
            self.put(lengths + (length,) * taken, n)
            count -= n * taken

    def runs(self) -> list[Run]:
        return [Run(x, n, free) for free, runs in sorted(self.by_free.items()) for x, n in runs.items()]


def refill(runs: list[Run], capacity: int) -> list[Run]:
    """The best of: the runs as they are; those with some free room, and then those of many lengths too, taken apart and placed best-fit, largest first."""
    best, least = runs, sum(r.count for r in runs)
    most = max((r.free for r in runs), default=0)
    loosen = [(1 << k, math.inf) for k in reversed(range(most.bit_length()))] + [(1, n) for n in (64, 32, 16, 8, 6, 5, 4, 3)]
    for room, lengths in loosen:
        fit, loose = _BestFit(capacity), Counter()
        for r in runs:
            if r.free < room and len(r.lengths) < lengths:
                fit.put(r.lengths, r.count)
            else:
                for length in r.lengths:
                    loose[length] += r.count
        for length in sorted(loose, reverse=True):
            fit.place(length, loose[length])
        n = sum(sum(x.values()) for x in fit.by_free.values())
        if n < least:
            best, least = fit.runs(), n
    return best


def pack_histogram(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold exactly ``histogram`` (length -> count; 0 < length <= capacity)."""
    return refill(linear_grouping(histogram, capacity, groups), capacity)


def linear_grouping(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """The plan of the scheme itself, before sequences with free room are filled again."""
    large = sorted((s for s in histogram if s > capacity // SMALL), reverse=True)
    fit = _BestFit(capacity)
    total = sum(histogram[s] for s in large)
    if total:
        # groups of equal cardinality, each a queue of actual lengths from its largest down
        share, group_of, queues = max(1, -(-total // groups)), [], []
        room = 0
        for s in large:
            count = histogram[s]
            while count:
                if not room:
                    queues.append([])
                    group_of.append(s)
                    room = share
                n = min(room, count)
                queues[-1].append([s, n])
                count, room = count - n, room - n
        # groups that round to one size are one size
        sizes = sorted(set(group_of), reverse=True)
        merged = {s: [q for s2, qs in zip(group_of, queues) if s2 == s for q in qs] for s in sizes}
        left = {s: sum(n for _, n in merged[s]) for s in sizes}
        plan = configurations(sizes, [left[s] for s in sizes], capacity)
        runs: list[tuple[tuple[int, ...], int]] = []
        for counts, x in plan:
            n = min([int(x + 1e-6), *(left[s] // c for s, c in zip(sizes, counts) if c)])
            if n > 0 and any(counts):
                runs.append((tuple(s for s, c in zip(sizes, counts) for _ in range(c)), n))
                for s, c in zip(sizes, counts):
                    left[s] -= n * c
        # substitute actual lengths for rounded ones, run by run
        for pattern, n in runs:
            while n:
                heads = Counter(pattern)
                take = min([n, *(_ahead(merged[s], c) for s, c in heads.items())])
                actual = []
                for s, c in heads.items():
                    for length, m in _draw(merged[s], c, take):
                        actual += [length] * m
                fit.put(tuple(actual), take)
                n -= take
        for s in sizes:  # what rounding down left over
            for length, n in merged[s]:
                fit.place(length, n)
    for s in sorted((s for s in histogram if s <= capacity // SMALL), reverse=True):
        fit.place(s, histogram[s])
    return fit.runs()


def _ahead(queue: list[list[int]], each: int) -> int:
    """For how many sequences ``each`` items can be drawn alike from the head of the queue; 1 if mixed."""
    return max(1, queue[0][1] // each)


def _draw(queue: list[list[int]], each: int, times: int) -> list[tuple[int, int]]:
    """Take ``each`` items for ``times`` sequences alike (times is 1 if they are mixed)."""
    out, need = [], each
    while need:
        length, n = queue[0]
        m = need if n >= need * times else n // times
        out.append((length, m))
        queue[0][1] -= m * times
        need -= m
        if not queue[0][1]:
            queue.pop(0)
    return out


def ranges(runs: list[Run], first: int = 0) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by rank: where the ranks of a length go."""
    next_rank, out, sequence = Counter(), defaultdict(list), first
    for r in runs:
        offset = 0
        for length in r.lengths:
            out[length].append((next_rank[length], sequence, offset))
            next_rank[length] += r.count
            offset += length
        sequence += r.count
    return {s: np.array(x, np.int64) for s, x in out.items()}


# ---- documents ---------------------------------------------------------------------------------------


def _pieces(batches, tokenizer: str, end: int, capacity: int):
    encoder, shard, seen = encoder_of(tokenizer), TaskContext.get().partitionId(), Counter()
    tail = np.array([end], "<u4").tobytes()
    for batch in small(batches):
        rows, raw = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = encoder(text) + tail
            n = len(x) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                rows.append((doc, p, a, b - a, shard, seen[b - a]))
                seen[b - a] += 1
            raw.append(x)
        cols = list(zip(*rows)) if rows else [()] * 6
        # between the two steps ids are bytes, two each where the vocabulary allows: lists would be copied id by id
        values = np.frombuffer(b"".join(raw), "<u4").astype("<u2" if encoder.narrow and end < 1 << 16 else "<u4")
        offsets = pa.array((np.concatenate([[0], np.cumsum(np.array(cols[3], np.int64))]) * values.itemsize).astype(np.int32))
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), ids, pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids", "shard", "place"])


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, digests: bool = False) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids, sequence_id, offset; with ``digests``
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids.

    The pieces of a sequence fill it without gaps from 0. Only documents over ``capacity`` tokens are cut;
    their first piece takes the remainder. Null or empty text: the end id alone. Rows with the same doc_id
    are packed one by one. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(docs.mapInArrow(partial(_pieces, tokenizer=tokenizer, end=end, capacity=capacity), PIECES), "pieces", compression="zstd", **{"parquet.block.size": str(32 << 20)})
    counts = stored(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    full = histogram.pop(capacity, 0)
    where = ranges(pack_histogram(histogram, capacity), full)
    where[capacity] = np.array([[0, 0, 0]], np.int64)  # each full piece is a sequence of its own
    # ids stay where they are: what meets them is one row a shard, with the ranks at which its lengths begin
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "length", F.coalesce(before, F.lit(0)).alias("before"))
    starts = starts.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    if counts.select("shard").distinct().count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, "shard").withColumn("rank", F.col("place") + F.col("before")[F.col("length")])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", "rank")
    return ranked.mapInArrow(partial(_locate, where=where, digests=digests), DIGESTS if digests else PACKED)


PACKED = "doc_id long, piece int, start long, length int, ids array<int>, sequence_id long, offset int"
DIGESTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _locate(batches, where: dict[int, np.ndarray], digests: bool):
    for batch in batches:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            rows, at = where[int(s)], np.flatnonzero(length == s)
            k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
            sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
            offset[at] = rows[k, 2]
        cuts, raw = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]), b"".join(batch.column(4).to_pylist())
        ids = np.frombuffer(raw, f"<u{len(raw) // max(1, int(cuts[-1])) or 4}").astype("<u4")
        if digests:
            view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
            crc = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.int64())
            cols = [pa.array(length.astype(np.int64)), crc, pa.array(sequence), pa.array(offset)]
        else:
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view("<i4")))
            cols = [batch.column(3), lists, pa.array(sequence), pa.array(offset.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["doc_id", "piece", "start", "length", "ids_crc32" if digests else "ids", "sequence_id", "offset"])
