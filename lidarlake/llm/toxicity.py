"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps each token to a class: insult (in five weights), threat, target, negation, reported
speech, or clause end. Four small transducers read the class string of a clause and mark its insults and threats:
negated (a negation up to three words before), reported (a verb of speech before, in the clause), targeted (a target
up to four words before or after), and a last one gives each marked core its weight. They are composed to one
machine; a clause's score is the weight of its best path, a document's score a logistic function of what its clauses
sum to, absolutely and per word. So documents are scored on matched clauses, never on isolated words: a threat
without a target is nothing, negation and reported speech lower a core's weight, a target raises it.

Insult arcs (words, and stems of them), the factors of the contexts (within bounds that keep their sense) and the
final weights are learned from a bounded sample of labelled rows; the sample's bound is a parameter.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import small, stored
from lidarlake.llm.fst import Fst

#: At most about so many labelled rows of each label are learned from.
SAMPLE = 4000
#: An insult arc needs so many different left neighbours in toxic rows, this log-likelihood ratio (G2) and these log odds.
LEAST_SEEN, LEAST_G2, LEAST_ODDS = 3, 24.0, 2.0
STEMS = (5, 4)
# Small closed classes in the languages of the corpus (fixed values).
THREAT = "kill hurt destroy beat smash crush murder stab shoot töten umbringen schlagen vernichten matar golpear destruir tuer frapper détruire".split()
TARGET = "you your yours he she they him her them his their u du dich dir ihr euch er sie usted tú te ti ustedes él ella ellos tu toi vous il elle ils elles".split()
NEGATION = "not no never nobody none neither nor cannot don't isn't aren't wasn't nicht kein keine nie niemals nunca jamás ningún ne pas jamais aucun aucune".split()
REPORT = "said says say told tells claims claimed wrote writes reported quoted according sagte sagt schrieb laut dijo dice escribió según dit écrit selon".split()
_CLAUSE_END = ".!?;:…¶"
_STRIP = "\"'“”‘’«»()[]{}<>,.!?;:…*#$%&|~_-¡¿"


class Lexicon:
    """token -> class characters: A-E insult by weight, t threat, y target, n negation, r report, w other, '.' clause end."""

    def __init__(self, arcs: dict[str, float], most: int = 120_000):
        self.arcs, self.most, self.known = arcs, most, {}
        self.closed = {**dict.fromkeys(TARGET, "y"), **dict.fromkeys(NEGATION, "n"), **dict.fromkeys(REPORT, "r"), **dict.fromkeys(THREAT, "t")}

    def weight(self, word: str) -> float:
        if word in self.arcs:
            return self.arcs[word]
        return next((w for n in STEMS if len(word) > n and (w := self.arcs.get(word[:n] + "*")) is not None), 0.0)

    def _class(self, token: str) -> str:
        if token == "¶":
            return "."
        word = token.strip(_STRIP)
        end = "." if token[-1] in _CLAUSE_END else ""
        w = self.weight(word) if word else 0.0
        return ("ABCDE"[min(4, int(w / 2))] if w > 0 else self.closed.get(word, "w")) + end

    def classes(self, text: str | None) -> str:
        if not text:
            return ""
        tokens = text.lower().replace("\n", " ¶ ").split()
        known = self.known
        try:
            return "".join([known[t] for t in tokens])
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self._class(t)
            return "".join([known[t] for t in tokens])


# ---- the grammar --------------------------------------------------------------------------------------

_CORE = re.compile("[A-Et]")
#: Words that a negation reaches, and that may stand between a core and its target.
REACH, NEAR = 3, 4
#: What each mark does to a core's weight at first, and where learning may move it: negation and reported speech lower, a target raises.
FACTORS = {"n": 0.25, "r": 0.5, "y": 1.5, "t": 2.0}
CHOICES = {"n": (0.0, 0.1, 0.25, 0.4, 0.5), "r": (0.0, 0.25, 0.5, 0.7), "y": (1.25, 1.5, 2.0, 3.0), "t": (1.0, 2.0, 3.0, 4.0)}
_CORES, _OTHERS = "ABCDEt", "wnyr"
#: Marks of a core, in the order in which they are written.
MARKS = ("", "n", "r", "nr")


def negation() -> Fst:
    """Cores within REACH words after a negation get the mark n."""
    m = Fst(0)
    for left in range(REACH + 1):
        after = max(0, left - 1)
        for x in _OTHERS:
            m.add(left, x, x, REACH if x == "n" else after)
        for x in _CORES:
            m.add(left, x, x + "n" if left else x, after)
    return m


def reported() -> Fst:
    """Cores after a verb of speech get the mark r."""
    m = Fst(0)
    for told in (0, 1):
        for x in _OTHERS:
            m.add(told, x, x, 1 if x == "r" else told)
        for x in _CORES:
            for mark in ("", "n"):
                m.add(told, x + mark, x + mark + "r" if told else x + mark, told)
    return m


def targeted() -> Fst:
    """Cores with a target at most NEAR words before or after get the mark y; a threat without one becomes a plain word.

    State k >= 0: a target was met and reaches k more words. State -k: a target is promised within k words; it must come."""
    m = Fst(0, range(NEAR + 1))
    cores = [x + mark for x in _CORES for mark in MARKS]
    for k in range(NEAR + 1):
        after = max(0, k - 1)
        for x in _OTHERS:
            m.add(k, x, x, NEAR if x == "y" else after)
        for x in cores:
            if k:
                m.add(k, x, x + "y", after)
            else:
                m.add(0, x, "w" if x[0] == "t" else x, 0)
                m.add(0, x, x + "y", -NEAR)
    for k in range(1, NEAR + 1):
        m.add(-k, "y", "y", NEAR)
        for x in ["w", "n", "r", *cores] if k > 1 else ():
            m.add(-k, x, x + "y" if x in cores else x, 1 - k)
    return m


def level(core: str) -> float:
    return 1.0 + "ABCDE".index(core[0]) if core[0] != "t" else 1.0


def weigher(factors: dict[str, float]) -> Fst:
    """One state: each marked core's weight."""
    m = Fst(0)
    for x in _OTHERS:
        m.add(0, x, "", 0)
    for x in _CORES:
        for mark in MARKS:
            for y in ("", "y") if x != "t" else ("y",):
                core = x + mark + y
                w = level(core) * (factors["t"] if x == "t" else 1.0)
                for f in mark + ("" if x == "t" else y):
                    w *= factors[f]
                m.add(0, core, core, 0, w)
    return m


_CONTEXT = negation() @ reported() @ targeted()
_LONG = re.compile(f"w{{{NEAR + 2},}}")


class Machine:
    """The composed grammar: clause -> (weight, marked cores); clauses alike are walked once."""

    def __init__(self, factors: dict[str, float], most: int = 20_000):
        self.fst, self.most, self.known = _CONTEXT @ weigher(factors), most, {}

    def clause(self, classes: str) -> tuple[float, tuple[str, ...]]:
        classes = _LONG.sub("w" * (NEAR + 1), classes)  # more plain words than anything reaches are as good as NEAR + 1
        got = self.known.get(classes)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            w, out = self.fst.best(classes)
            got = self.known[classes] = (w, tuple(x for x in out if x))
        return got

    def match(self, classes: str) -> tuple[float, list[str]]:
        """Sum over the matched clauses of a document, and their marked cores."""
        total, cores = 0.0, []
        if _CORE.search(classes):
            for c in classes.split("."):
                if _CORE.search(c):
                    w, marked = self.clause(c)
                    total += w
                    cores += marked
        return total, cores


def n_tokens(classes: str) -> int:
    return len(classes) - classes.count(".")


def vector(total: np.ndarray | float, tokens: np.ndarray | float) -> np.ndarray:
    """What the final weights see: matched weight, absolute and per hundred words."""
    return np.stack([np.log1p(total), np.log1p(100.0 * np.asarray(total) / np.maximum(tokens, 20))], axis=-1)


# ---- learning ----------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _units(batches):
    for batch in small(batches):
        unit, left, label = [], [], []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen, last = set(), ""
            for token in (text or "").lower().split():
                word = token.strip(_STRIP)
                if word:
                    for u in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                        seen.add((u, last))
                    last = word
            for u, p in seen:
                unit.append(u)
                left.append(p)
                label.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(left, pa.string()), pa.array(label, pa.int32())], names=["unit", "left", "label"])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most about ``most`` labelled training rows of each label, chosen by a hash of the id; and how many there are of each."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(most / max(1, count.get(1, 0)))).otherwise(F.lit(most / max(1, count.get(0, 0))))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.join(F.broadcast(chosen), "doc_id").select("label", "text"), count  # at most about 2 * most ids


def learn_arcs(rows: DataFrame) -> dict[str, float]:
    """Words and stems whose left neighbours are far more various in toxic rows than chance would have it: unit -> log odds.

    Different left neighbours are counted, not rows, so that a copied document counts once. The share of toxic ones
    is held against that of all units by the log-likelihood ratio."""
    pairs = rows.mapInArrow(_units, "unit string, left string, label int").groupBy("unit", "left").agg(F.max("label").alias("t"), F.max(1 - F.col("label")).alias("c"))
    units = stored(pairs.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-units")
    all_t, all_c = units.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if not all_t or not all_c:
        return {}
    share = all_t / (all_t + all_c)
    t, c = F.col("t"), F.col("c")
    n = t + c
    g2 = 2 * (t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0))
    odds = F.log((t + 0.5) / (c + 0.5)) - math.log(share / (1 - share))
    best = units.where(t >= LEAST_SEEN).select("unit", odds.alias("w"), g2.alias("g2")).where((F.col("w") >= LEAST_ODDS) & (F.col("g2") >= LEAST_G2))
    return {r["unit"]: float(r["w"]) for r in best.collect()}  # at most the units of the sample


def logistic(x: np.ndarray, y: np.ndarray, s: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(weights, log likelihood) by Newton's method, rows weighted by ``s``; the last weight is the intercept, the others are not negative."""
    x, s = np.hstack([x, np.ones((len(x), 1))]), s / s.sum()
    use = list(range(x.shape[1]))
    while True:
        z, w = x[:, use], np.zeros(len(use))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (s * (y - p)) - ridge * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-7:
                break
        below = [k for k, v in zip(use[:-1], w) if v < 0]
        if not below:
            out = np.zeros(x.shape[1])
            out[use] = w
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ out, -30, 30))), 1e-9, 1 - 1e-9)
            return out, float((s * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        use = [k for k in use if k not in below]


def _matches(batches, arcs):
    lexicon, machine = Lexicon(arcs), Machine(FACTORS)
    for batch in small(batches):
        tokens, cores = [], []
        for text in batch.column(1).to_pylist():
            classes = lexicon.classes(text)
            tokens.append(n_tokens(classes))
            cores.append(machine.match(classes)[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(cores, pa.list_(pa.string()))], names=["label", "tokens", "cores"])


def _totals(cores: list[list[str]], factors: dict[str, float]) -> np.ndarray:
    weight = {core: w for arcs in weigher(factors).arcs[0].values() for core, w, _ in arcs if core}
    return np.array([sum(map(weight.__getitem__, c)) for c in cores], float)


class Grammar:
    """Arcs, factors of the contexts and final weights; small, sent to the executors with the task."""

    def __init__(self, arcs: dict[str, float], factors: dict[str, float], weights: np.ndarray):
        self.arcs, self.factors, self.weights = arcs, factors, weights

    @classmethod
    def learn(cls, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Grammar:
        chosen, counts = sample(docs, labels, most)
        rows = stored(chosen, "toxic-sample")
        arcs = learn_arcs(rows)
        got = rows.mapInArrow(partial(_matches, arcs=arcs), "label int, tokens long, cores array<string>").toPandas()  # at most about 2 * most rows
        return cls.fit(arcs, got["label"].to_numpy(np.int64) if len(got) else np.empty(0, np.int64), got["tokens"].to_numpy(float), [list(c) for c in got["cores"]], counts)

    @classmethod
    def fit(cls, arcs: dict[str, float], y: np.ndarray, tokens: np.ndarray, cores: list[list[str]], counts: dict[int, int]) -> Grammar:
        """Factors (one at a time, while the likelihood rises) and final weights; rows stand for as many labels as ``counts`` says."""
        factors = dict(FACTORS)
        if len(np.unique(y)) < 2:  # nothing to learn from: a match of some weight is toxic
            return cls(arcs, factors, np.array([2.0, 2.0, -5.0]))
        s = np.array([counts.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)], float)[y]
        weights, best = logistic(vector(_totals(cores, factors), tokens), y, s)
        for mark, choices in CHOICES.items():
            if any(mark in c for doc in cores for c in doc):
                for f in choices:
                    tried = factors | {mark: f}
                    w, l = logistic(vector(_totals(cores, tried), tokens), y, s)
                    if l > best + 1e-6:
                        factors, weights, best = tried, w, l
        return cls(arcs, factors, weights)


class Judge:
    """text -> log odds of toxicity."""

    def __init__(self, arcs: dict[str, float], factors: dict[str, float], weights: np.ndarray):
        self.lexicon, self.machine, self.weights = Lexicon(arcs), Machine(factors), weights

    def __call__(self, text: str | None) -> float:
        classes = self.lexicon.classes(text)
        total, _ = self.machine.match(classes)
        return float(vector(total, n_tokens(classes)) @ self.weights[:-1] + self.weights[-1]) if total else float(self.weights[-1])


def _score(batches, grammar):
    judge = Judge(*grammar)
    for batch in small(batches):
        z = np.array([judge(t) for t in batch.column(1).to_pylist()], float)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    ``labels(doc_id, toxic)``: learned from only where crc32 of the id as text is no multiple of 5; an id with
    several labels counts as toxic if one says so. Null and empty texts match nothing. Very long texts are read whole, clause by
    clause. Of equal paths through a clause the first is taken; their weight is the same. A null doc_id is not held out.
    Repeated rows are scored one by one; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    g = Grammar.learn(docs, labels, most)
    scores = docs.mapInArrow(partial(_score, grammar=(g.arcs, g.factors, g.weights)), "doc_id long, score double")
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(batches, grammar, at: int):
    judge = Judge(*grammar)
    for batch in small(batches):
        yield batch.filter(pa.array([judge(t) < 0 for t in batch.column(at).to_pylist()], pa.bool_()))


def filter_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` (all its columns) without the rows whose text scores 0.5 or more."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_clean, grammar=(grammar.arcs, grammar.factors, grammar.weights), at=docs.columns.index("text")), kinds)
