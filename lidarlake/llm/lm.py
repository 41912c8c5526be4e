"""Language-model scores: marginal probability of a text over all segmentations of its words into subwords.

The vocabulary is that of an existing sentencepiece model. Its scores order the pieces; they start as a
Zipf distribution by rank and are re-estimated once, by expected counts over all segmentations of every word
of the training documents (the E step runs on the executors, over the table of distinct words). A word's
probability is the forward recursion over its lattice; a character that no piece covers is spelled by bytes.
The forward sums are rescaled as they go, so a word of any length keeps a finite log probability.

The base score needs the count of each word. Words more frequent than 1 / HEAVY of all tokens (at most HEAVY of them)
are looked up where the text is; the others go, once per document and with their number there, to a join by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import partial
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import small, stored, words

#: A word with over 1 / HEAVY of all training tokens is broadcast, so at most HEAVY words are.
HEAVY = 200_000
LONGEST = 16
#: Exponent of the distribution by rank that the first expectations start from.
ZIPF = 0.5
#: Words of a block of lattices, and their most characters; longer ones go one by one.
BLOCK, SHORT = 2048, 64
#: A sum below this goes one by one, with scales: above it what gets too small for a number is no part of it.
LEAST = 1e-200
#: Fills a short word's places in a block: opens no piece.
_PAD = "\U0010ffff"
#: A document's end is a token; no word can be spelled like this.
END = b"\n"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


# ---- the lattice -------------------------------------------------------------------------------------


class Lattice:
    """log10 probability of words from piece probabilities; pieces open a word with its mark."""

    MARK = "▁"

    def __init__(self, probs: dict[str, float], byte: float, most: int = 200_000):
        self.probs, self.byte, self.most = probs, byte, most
        self.known: dict[bytes, float] = {}
        #: piece or beginning of one -> probability (0: only a beginning); a walk ends where this ends
        self.starts = {p[:k]: 0.0 for p in probs for k in range(1, len(p))} | probs
        self.trie = None

    def __reduce__(self):
        return Lattice, (self.probs, self.byte, self.most)

    @classmethod
    def from_model(cls, path: str) -> Lattice:
        """Pieces of a sentencepiece model by rank of score: a flat Zipf distribution, before any counts."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces.sort(key=lambda i: (-sp.get_score(i), i))
        w = {sp.id_to_piece(i): (k + 10.0) ** -ZIPF for k, i in enumerate(pieces)}
        w = {p: x for p, x in w.items() if len(p) <= LONGEST}
        total = sum(w.values())
        return cls({p: 0.98 * x / total for p, x in w.items()}, 0.01 / 256)

    def _spelled(self, c: str) -> float:
        return self.byte if c < "\x80" else self.byte ** len(c.encode("utf-8", "surrogatepass"))

    def _log(self, w: str) -> float:
        """Natural log of the sum over all segmentations; rescaled where the sums get small."""
        n, starts, scale = len(w), self.starts.get, 0.0
        f = [1.0] + [0.0] * n
        for j in range(n):
            x = f[j]
            if x < 1e-150:
                for k in range(j, min(n, j + LONGEST) + 1):
                    f[k] /= x
                scale, x = scale + math.log(x), 1.0
            f[j + 1] += x * self._spelled(w[j])
            for i in range(j + 1, n + 1):
                p = starts(w[j:i])
                if p is None:
                    break
                if p:
                    f[i] += x * p
        return math.log(f[n]) + scale

    def log10(self, word: bytes) -> float:
        return self.log10s([word])[word]

    def log10s(self, words: Iterable[bytes]) -> dict[bytes, float]:
        """At least these words with their log10 probability; what is met again is not computed again."""
        if len(self.known) >= self.most:
            self.known.clear()
        new = list(set(words).difference(self.known))
        whole = np.ones(len(new))
        for at, b in self._blocks(new):
            whole[at] = b.whole
        logs = np.log10(np.maximum(whole, LEAST))
        for k in np.flatnonzero(whole < LEAST).tolist():
            logs[k] = self._log(self.MARK + new[k].decode("utf-8", "surrogatepass")) / math.log(10)
        self.known.update(zip(new, logs.tolist()))
        self.known[END] = math.log10(self.probs.get(self.MARK + "\n", self.byte))
        return self.known

    def _states(self):
        """The beginnings of pieces as a trie: sorted keys (state, next character), their states, and each state's probability."""
        if self.trie is None:
            number = {p: k for k, p in enumerate(self.starts, 1)}
            keys = np.array([number.get(p[:-1], 0) << 21 | ord(p[-1]) for p in number], np.int64)
            order = np.argsort(keys)
            self.trie = keys[order], order + 1, np.array([0.0, *self.starts.values()])
        return self.trie

    def _blocks(self, words: list[bytes]):
        """(places among ``words``, block) of all words, those of like length together; long words are left out with a sum of 0."""
        texts = [self.MARK + w.decode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], SHORT, "right"))
        for k in range(0, short, BLOCK):
            at = order[k : min(k + BLOCK, short)]
            yield at, _Block(self, [texts[x] for x in at.tolist()], sizes[at])
        if short < len(order):
            yield order[short:], _Long

    def expects(self, words: list[bytes], counts: np.ndarray, into: np.ndarray) -> None:
        """``expect`` of many words; ``into`` has a place for each state."""
        for at, b in self._blocks(words):
            whole, rest = np.broadcast_to(b.whole, len(at)), {}
            for k in at[whole < LEAST].tolist():
                self.expect(words[k], counts[k], rest)
            for piece, n in rest.items():
                into[self.number(piece)] += n
            if b is not _Long:
                b.expect(np.where(whole < LEAST, 0.0, counts[at]), into)

    def number(self, piece: str) -> int:
        """The state of a piece."""
        keys, states, _ = self._states()
        s = 0
        for c in piece:
            s = int(states[np.searchsorted(keys, s << 21 | ord(c))])
        return s

    def expect(self, word: bytes, count: float, into: dict[str, float]) -> None:
        """Add ``count`` times the expected number of each piece over all segmentations of a word.

        Sums from the left and from the right are each rescaled where they get small; a place's two scales meet again in the
        ratio to the whole, which is never small."""
        w = self.MARK + word.decode("utf-8", "surrogatepass")
        n, starts = len(w), self.starts.get
        f, arcs, scale, now = [1.0] + [0.0] * n, [], [0.0] * (n + 1), 0.0
        for j in range(n):
            x = f[j]
            if x < 1e-150:
                for k in range(j, min(n, j + LONGEST) + 1):
                    f[k] /= x
                now, x = now + math.log(x), 1.0
            scale[j] = now
            f[j + 1] += x * self._spelled(w[j])
            for i in range(j + 1, n + 1):
                p = starts(w[j:i])
                if p is None:
                    break
                if p:
                    f[i] += x * p
                    arcs.append((j, i, p))
        whole, at = math.log(f[n]) + now, len(arcs) - 1
        b, now = [0.0] * n + [1.0], 0.0
        for j in range(n - 1, -1, -1):
            if b[j + 1] < 1e-150:
                x = b[j + 1]
                for k in range(j + 1, min(n, j + 1 + LONGEST) + 1):
                    b[k] /= x
                now += math.log(x)
            share = count * f[j] * math.exp(min(600.0, scale[j] + now - whole))
            back = b[j + 1] * self._spelled(w[j])
            while at >= 0 and arcs[at][0] == j:
                _, i, p = arcs[at]
                at -= 1
                x = p * b[i]
                back += x
                piece = w[j:i]
                into[piece] = into.get(piece, 0.0) + share * x
            b[j] = back


class _Long:
    whole = 0.0


class _Block:
    """Lattices of words side by side: row j of an array has what belongs to the j-th character of each."""

    def __init__(self, lattice: Lattice, texts: list[str], sizes: np.ndarray):
        keys, states, probs = lattice._states()
        n, width = int(sizes.max()), len(texts)
        c = "".join([x.ljust(n, _PAD) for x in texts]).encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(c, np.uint32).astype(np.int64).reshape(width, n).T.ravel()
        spelled = np.array([lattice._spelled(x) for x in "a\x80\u0800\U00010000"])
        self.spelled = spelled[(c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000)].reshape(n, width)
        self.n, self.width, self.sizes, self.arcs = n, width, sizes, []
        at, s = np.arange(n * width), np.zeros(n * width, np.int64)
        rows: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for k in range(1, min(LONGEST, n) + 1):  # all beginnings of k characters, wherever they stand
            key = s << 21 | c[at + (k - 1) * width]
            x = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[x] == key if len(keys) else np.zeros(len(key), bool)
            at, s = at[hit], states[x[hit]]
            p = probs[s]
            some = p > 0
            if some.any():
                arc = np.zeros(n * width)
                arc[at[some]] = p[some]
                arc = arc.reshape(n, width)
                for j in np.unique(at[some] // width).tolist():
                    rows[j].append((k, arc[j]))
                self.arcs.append((k, at[some], s[some], p[some]))
            keep = at + k * width < n * width
            at, s = at[keep], s[keep]
            if not len(at):
                break
        self.rows = rows
        self.f = np.zeros((n + 1, width))
        self.f[0] = 1.0
        for j in range(n):
            x = self.f[j]
            self.f[j + 1] += x * self.spelled[j]
            for k, p in rows[j]:
                self.f[j + k] += x * p
        self.whole = self.f[sizes, np.arange(width)]

    def expect(self, counts: np.ndarray, into: np.ndarray) -> None:
        b = np.zeros((self.n + 1, self.width))
        b[self.sizes, np.arange(self.width)] = 1.0
        for j in range(self.n - 1, -1, -1):
            b[j] += b[j + 1] * self.spelled[j]
            for k, p in self.rows[j]:
                b[j] += b[j + k] * p
        share, b = (self.f * (counts / np.maximum(self.whole, LEAST))).ravel(), b.ravel()
        for k, at, s, p in self.arcs:
            into += np.bincount(s, share[at] * p * b[at + k * self.width], len(into))


def _expected(batches, start: Lattice):
    got = np.zeros(len(start.starts) + 1)
    for batch in batches:
        rows = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END]
        start.expects([w for w, _ in rows], np.array([c for _, c in rows], np.float64), got)
    pieces = [(p, n) for p, n in zip(start.starts, got[1:].tolist()) if n]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.string()), pa.array([n for _, n in pieces], pa.float64())], names=["piece", "n"])


def reestimate(start: Lattice, counts: DataFrame, documents: int) -> Lattice:
    """One step of expectation maximisation over all distinct words; pieces never met keep a small share."""
    rows = counts.select("word", "c").mapInArrow(partial(_expected, start=start), "piece string, n double")
    got = {r["piece"]: r["n"] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    total = sum(got.values()) + documents + 0.01 * len(start.probs) + 2.56
    probs = {p: (got.get(p, 0.0) + 0.01) / total for p in start.probs}
    probs[Lattice.MARK + "\n"] = max(documents, 0.5) / total  # a document's end
    return Lattice(probs, 0.01 / total)


# ---- counts and scores -------------------------------------------------------------------------------


def _count(batches, most: int = 500_000):
    c: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])
        c.clear()
        return out

    for batch in small(batches):
        for text in batch.column(0).to_pylist():
            c.update(words(text))
            c[END] += 1
            if len(c) > most:
                yield rows()
    yield rows()


def _score(batches, heavy, lattice: Lattice, log_unit: float):
    """A row for each document with what is known here, and one for each of its other words."""
    heavy = {w: (math.log10(c + 0.5) - log_unit) for w, c in heavy.value.items()}
    row = TaskContext.get().partitionId() << 33
    for batch in small(batches):
        counts = [Counter(words(text)) for text in batch.column(2).to_pylist()]
        logs = lattice.log10s(set().union(*counts)).__getitem__
        word, n, size, tokens, known, base, score = ([] for _ in range(7))
        for c in counts:
            c[END] += 1
            before, b, k = len(word), 0.0, 0
            for w, x in c.items():
                h = heavy.get(w)
                if h is None:
                    word.append(w)
                    n.append(x)
                else:
                    b += x * h
                    k += x
            size.append(len(word) - before)
            tokens.append(sum(c.values()))
            known.append(k)
            base.append(b)
            score.append(sum(map(mul, map(logs, c), c.values())))
        key, others, docs = np.arange(row + 1, row + 1 + len(counts)), len(word), len(counts)
        row += docs
        both = lambda a, b, kind: pa.concat_arrays([a, pa.array(b, kind)])
        none, zero = partial(pa.nulls, others), np.zeros(others, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.repeat(key, size), key])), both(none(pa.int64()), batch.column(0).to_pylist(), pa.int64()), both(none(pa.bool_()), batch.column(1).to_pylist(), pa.bool_()),
                pa.array(word + [END + k.to_bytes(8, "big") for k in key.tolist()], pa.binary()),  # those of documents meet no word, and spread
                pa.array(n + [0] * docs, pa.int64()), both(pa.array(zero), known, pa.int64()), both(pa.array(zero.astype(np.float64)), base, pa.float64()),
                both(none(pa.float64()), score, pa.float64()), both(none(pa.int64()), tokens, pa.int64()),
            ],
            names=["key", "doc_id", "held_out", "word", "n", "known", "base", "score", "tokens"])


def score(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the id as text is not 1 mod 5 (a null doc_id counts as training).
    Null or empty texts are an end token alone. Repeated rows are scored one by one and count as often. Other
    columns are ignored; an empty table gives no rows. Without training documents nothing is known.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = docs.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, c long")
    counts = stored(counts.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lattice = reestimate(Lattice.from_model(vocabulary), counts, ends)
    log_unit = math.log10(total + 0.5 * (distinct + 1))
    heavy = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") * HEAVY > total).collect()}  # at most HEAVY words
    heavy = docs.sparkSession.sparkContext.broadcast(heavy)
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(
        partial(_score, heavy=heavy, lattice=lattice, log_unit=log_unit),
        "key long, doc_id long, held_out boolean, word binary, n long, known long, base double, score double, tokens long")
    rows = rows.join(counts, "word", "left")
    other = F.col("tokens").isNull()
    rows = rows.select(
        "key", "doc_id", "held_out", "score", "tokens",
        (F.col("known") + F.when(other & F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.when(other, F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - log_unit)).otherwise(0.0)).alias("base"))
    out = rows.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.max("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
