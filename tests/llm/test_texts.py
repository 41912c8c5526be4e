import collections
import math
import random
import zlib

import numpy as np
import pytest

from lidarlake.llm import decontaminate, lines, lm, quality, secrets, toxicity, urls
from lidarlake.llm.common import words
from lidarlake.llm.queries import OP8_SQL, URL_RULES, tokenizer_path

# ---- secrets -------------------------------------------------------------------------------------------


def test_secrets_equal_brute_force(corpus, texts):
    for r in secrets.digests(secrets.scan(corpus)).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == secrets.brute_force(texts[r.doc_id])


def test_secrets_in_random_text():
    r = random.Random(2)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "ſecret", "=", ":", ' "', "'", " ", "  ", "abcdef", "ab", "secret=", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", "g", "İ", "K", "é", "\n", "+/="]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        base = [s for s in secrets.find(text) if s[0] in secrets.KINDS[:3]]
        n = [sum(s[0] == k for s in base) for k in secrets.KINDS[:3]]
        import hashlib

        assert (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()) == secrets.brute_force(text), text


def test_checksums_are_validated():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    n, tail = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        tail = secrets._B62[k] + tail
    good = f"ghp_{body}{tail.rjust(6, '0')}"
    assert ("github", 3, 3 + len(good)) in secrets.find(f"is {good}.")
    assert not [s for s in secrets.find(f"is ghp_{body}000000.") if s[0] == "github"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert [s[0] for s in secrets.find(jwt)] == ["jwt"] and secrets.find("eyJhbGci.eyJ.c2ln") == []


def test_secrets_of_awkward_and_empty_tables(awkward, empty):
    assert secrets.digests(secrets.scan(awkward)).count() == 13
    assert secrets.scan(empty).count() == 0


# ---- urls ----------------------------------------------------------------------------------------------

PAGES = ["http://a.Example.com/en/1", "https://www.example.com/en/?q", "x://example.com", "http://net/es/", "http://a.net/fr/x#y", "nothing", "", None, "http://xexample.com/en/", "http://b.net/esp/", "://", "http://.com/", "http://COM/", "http://example.com/en", "http://a..com//"]


def test_urls_equal_sql(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(PAGES)), "url": PAGES})  # noqa: F841
    want = sorted(map(str, duckdb.sql(OP8_SQL).fetchall()))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, url string")
    for most in (urls.BROADCAST_RULES, 0):
        assert sorted(str(tuple(r)) for r in urls.judge(df, rules, broadcast_rules=most).collect()) == want


def test_urls_with_other_rules(spark):
    """Paths that do not end with a slash, an empty path, nulls and doubles; brute force."""
    rules = [("Example.com", "/a", "block"), ("example.com", "", "allow"), ("b.example.com", "/a/b", "allow"), ("org", "/x", "block"), ("org", "/x", "allow"), (None, "/", "block"), ("net", None, "block")]
    pages = [f"http://{h}{p}" for h in ("example.com", "b.example.com", "c.b.example.com", "z.org", "net") for p in ("", "/", "/a", "/ab", "/a/b/c", "/x/y")]
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(pages)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for k, u in enumerate(pages):
        host, _, path = u[7:].partition("/")
        path = "/" + path if "/" in u[7:] else ""
        fits = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in rules if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = sorted(fits, key=lambda f: (-f[0], -f[1], f[3]))[0] if fits else None
        assert got[k] == ((best[2], best[3]) if best else (None, "allow")), u
    assert urls.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------


def test_leaks_with_substitutions(spark, monkeypatch):
    r, vocabulary = random.Random(4), [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    item = [r.choice(vocabulary) for _ in range(40)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    swapped = [x if k % 8 != 3 else "zz" for k, x in enumerate(item)]
    docs = [(1, " ".join(noise(30) + item + noise(30))), (2, " ".join(noise(50) + swapped + noise(9))), (3, " ".join(noise(120))), (4, " ".join(item[:10])), (5, None), (6, ""), (None, " ".join(item)), (7, " ".join(item[5:30]).upper() + "!"), (7, "other text")]
    bench = spark.createDataFrame([(9, ", ".join(item), "x"), (10, None, "x"), (11, "too short", "x")], "item_id long, text string, words string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, place long")
    for seeds, alignments in ((decontaminate.BROADCAST_SEEDS, decontaminate.BROADCAST_ALIGNMENTS), (0, 0)):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
        monkeypatch.setattr(decontaminate, "BROADCAST_ALIGNMENTS", alignments)
        got = {(x.doc_id, x.item_id): x.overlap for x in decontaminate.leaks(df, bench).collect()}
        assert set(got) == {(1, 9), (2, 9), (7, 9)} and got[1, 9] == 1.0 and 0.8 <= got[2, 9] < 1
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark, corpus, texts):
    """Every alignment of every item, without seeds: places that agree in the best window."""
    import re

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda s: [x for x in re.split(r"[\W_]+", s.lower()) if x]
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    want = set()
    for d, t in texts.items():
        w = norm(t)
        where = collections.defaultdict(list)
        for k, x in enumerate(w):
            where[x].append(k)
        for i, item in items.items():
            rare = sorted(range(len(item)), key=lambda k: len(where[item[k]]))[: max(1, len(item) // 2)]
            size = min(20, len(item))
            for shift in {p - k for k in rare for p in where[item[k]]}:
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(item)]
                if 100 * max(sum(same[k : k + size]) for k in range(len(item) - size + 1)) >= 80 * size:
                    want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus, bench).collect()} == want and want


# ---- lines ---------------------------------------------------------------------------------------------


def test_lines(spark):
    log = lambda k, who: f"Session {k} of user {who} ended at 12:0{k} after {k * 7} ms idle"
    rows = [
        (5, log(1, "ann") + "\nkeep this short\nonly here is this line of words"), (6, "first line that nobody else has\n" + log(2, "ann")), (7, log(3, "ann") + "\n" + log(4, "ann")),
        (8, "common notice of terms and conditions apply here\nkeep this short"), (9, "common notice of terms and conditions apply here"), (10, "common notice of terms and conditions apply there"), (11, None), (12, ""), (None, "common notice of terms and conditions apply here"),
    ]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n_dropped long, leaf string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(df).collect()}
    assert got[5][0] == rows[0][1] and got[6] == ("first line that nobody else has", 1) and got[7] == ("", 2)
    assert got[8][0] == rows[3][1] and got[9] == ("", 1) and got[10] == ("", 1)
    assert got[11] == (None, 0) and got[12] == ("", 0) and got[None] == (rows[8][1], 0)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_in_blocks(spark, monkeypatch):
    """A leaf split into blocks: exact repeats are found whatever the block, and templates meet in the second round."""
    monkeypatch.setattr(lines, "BLOCK", 5)
    rows = [(k, f"alpha beta gamma delta epsilon zeta eta theta iota {'abcdefghijklmnopqrstuvwxyz'[k]}") for k in range(26)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 25 and [r.text for r in got if r.doc_id == 0] == [rows[0][1]]


def test_lines_of_a_corpus(corpus, texts):
    where = collections.defaultdict(set)
    for d, t in texts.items():
        for x in t.split("\n"):
            if len(x.split()) >= lines.LEAST_TOKENS:
                where[x].add(d)
    for r in lines.dedup_lines(corpus).collect():
        left = (r.text or "").split("\n")
        for x in left:
            assert len(where.get(x, ())) < 2 or min(where[x]) == r.doc_id


def test_lines_of_awkward_table(awkward):
    got = lines.dedup_lines(awkward)
    assert got.columns == [*awkward.columns, "n_dropped"] and got.count() == 13


# ---- quality -------------------------------------------------------------------------------------------


def brute_repeats(w, size=8):
    n = collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    hit = {j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
    return len(hit)


def test_statistics_equal_brute_force(texts):
    r = random.Random(1)
    more = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["a\n\na\n b\nb \u00a0 x\x1c#*$", "", " \n "]
    for t in [*texts.values(), *more]:
        w = t.encode().split()
        lines_ = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        chars = sum(len(x.decode()) for x in w)
        assert quality.statistics(t, w) == (len(w), chars, sum(c in "#*$%&|<>" for c in t), len(lines_) - len(set(lines_)), brute_repeats(w))


def kneser_ney(docs, tokens):
    """p(c | a, b) of a modified Kneser-Ney model of ``docs`` (lists of token numbers), by dictionaries alone."""
    tables = {3: collections.Counter(t for d in docs for t in zip([0, 0, *d], [0, *d], d))}
    for n in (2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    discounts = {n: quality._discounts(*(sum(c == k for c in t.values()) for k in (1, 2, 3, 4))) for n, t in tables.items()}

    def p(context, c):
        n = len(context) + 1
        low = p(context[1:], c) if n > 1 else 1 / tokens
        beside = {g[-1]: x for g, x in tables[n].items() if g[:-1] == context}
        if not beside:
            return low
        d = lambda x: discounts[n][min(x, 3) - 1]
        total = sum(beside.values())
        return (beside[c] - d(beside[c])) / total * (c in beside) + sum(map(d, beside.values())) / total * low if c in beside else sum(map(d, beside.values())) / total * low

    return p


def test_model_equals_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("the cat dog sat on a mat zebra7 Ünder".split()) for _ in range(r.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame([("en", t) for t in texts] + [("fr", "le chat"), ("de", None), ("de", " ")], "lang string, text string").repartition(3)
    v, m = quality.train(docs, keep=10**9, least_gram=1)
    assert b"cat" in v.words and b"chat" not in v.words
    assert v.tokens([b"chat", b"the"]).tolist() == [quality.MARK, *(quality.FIRST_BYTE + c for c in b"chat"), v.words[b"the"]]
    seen = [v.tokens(t.encode().split()).tolist() for t in texts]
    want, lang = kneser_ney(seen, len(v)), v.lang("en")
    for a, b in [(0, 0), (0, seen[0][0]), (seen[1][0], seen[1][1]), (5, 7), (v.words[b"cat"], quality.MARK)]:
        c = np.arange(1, len(v))
        got = m.probability(lang << 3 * quality.BITS | a << 2 * quality.BITS | b << quality.BITS | c)
        assert got.sum() == pytest.approx(1 - m.probability(np.array([lang << 3 * quality.BITS | a << 2 * quality.BITS | b << quality.BITS]))[0])
        for k in r.sample(range(len(c)), 40) + [x - 1 for x in seen[0]]:
            assert got[k] == pytest.approx(want((a, b), int(c[k]))), (a, b, c[k])
    logs = quality.log_probabilities(m, [np.array(d) for d in seen], [lang] * len(seen))
    assert logs[4] == pytest.approx(sum(np.log10(want(g[:2], g[2])) for g in zip([0, 0, *seen[4]], [0, *seen[4]], seen[4])))
    assert m.probability(np.array([7 << 3 * quality.BITS | 9]))[0] == pytest.approx(1 / len(v))  # a language without a model


def test_pruned_model_is_a_distribution_and_sees_order(spark, corpus):
    docs = corpus.select("lang", "text").where("lang is not null")
    v, m = quality.train(docs, keep=3000)
    assert all(len(g[0]) <= 3000 for g in m.grams) and len(m.grams[2][0])
    w = [x for x in docs.first().text.encode().split()]
    lang, c = v.lang(docs.first().lang), np.arange(len(v))
    for a, b in ((0, 0), (v.tokens(w)[0], v.tokens(w)[1])):
        assert m.probability(lang << 3 * quality.BITS | a << 2 * quality.BITS | b << quality.BITS | c).sum() == pytest.approx(1)
    mixed = w[:]
    random.Random(1).shuffle(mixed)
    one, two = quality.log_probabilities(m, [v.tokens(w), v.tokens(mixed)], [lang, lang])
    assert one > two


def test_quality_of_awkward_and_empty_tables(awkward, empty):
    rows = quality.judge(awkward).collect()
    assert len(rows) == 13 and all(r.base_failed and not r.kept and r.perplexity is None for r in rows if r.n_words == 0)
    assert quality.judge(empty).count() == 0


def test_quality_keeps_clean_documents(spark, corpus):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows = [r for r in quality.judge(corpus).collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in rows) >= 0.98 * len(rows)


# ---- toxicity ------------------------------------------------------------------------------------------


def naive_clause(clause, factors):
    """Weight of a clause by looking around each core, without machines."""
    total = 0.0
    for k, x in enumerate(clause):
        if x in "ABCDEt":
            targeted = "y" in clause[max(0, k - 4) : k] + clause[k + 1 : k + 5]
            w = 1.0 + "ABCDE".index(x) if x != "t" else factors["t"] * targeted
            w *= factors["n"] if "n" in clause[max(0, k - 3) : k] else 1
            w *= factors["r"] if "r" in clause[:k] else 1
            total += w * (factors["y"] if targeted and x != "t" else 1)
    return total


def test_composed_grammar_equals_looking_around():
    r = random.Random(8)
    for factors in (toxicity.FACTORS, {"n": 0.5, "r": 0.7, "y": 1.25, "t": 4.0}):
        machine = toxicity.Machine(factors)
        for _ in range(3000):
            clause = "".join(r.choice("wwwwwwnyrAEt") for _ in range(r.randint(1, 14)))
            assert machine.clause(clause)[0] == pytest.approx(naive_clause(clause, factors)), clause


def test_context_changes_the_score():
    arcs = {"idiot": 7.0, "moro*": 5.0}
    said = ["He is an idiot.", "He is not an idiot.", "She said he is an idiot.", "An idiot wrote.", "I will kill you", "kill the process", ""]
    for factors in (toxicity.FACTORS, {"n": 0.5, "r": 0.7, "y": 1.25, "t": 1.0}):  # at first, and the weakest that learning may choose
        plain, negated, told, bare, threat, process, empty = map(toxicity.Judge(arcs, factors, np.array([2.0, 2.0, -5.0])), said)
        assert plain > told and plain > negated and plain > bare > empty and threat > process == empty
    assert toxicity.Machine(toxicity.FACTORS).match(toxicity.Lexicon(arcs).classes("what moronic talk"))[1] == ["C"]


def test_learned_factors_and_weights():
    """Negated cores in clean documents, targeted ones in toxic ones: the factors go as far as they may."""
    cores = [["Cy"], ["Cy", "C"], ["Dy"]] * 20 + [["Cn"], ["Cny"], []] * 40
    y = np.array([1] * 60 + [0] * 120)
    g = toxicity.Grammar.fit({}, y, np.full(180, 50.0), cores, {0: 120, 1: 60})
    assert g.factors["n"] == 0.0 and g.factors["y"] >= 1.25 and (g.weights[:-1] >= 0).all() and g.weights[:-1].any()
    assert toxicity.Grammar.fit({}, y[:60], np.full(60, 50.0), cores[:60], {1: 60}).factors == toxicity.FACTORS


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect() if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_toxicity_of_awkward_and_empty_tables(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.score(awkward, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(awkward, labels.limit(0)).count() == 13 and toxicity.score(empty, labels).count() == 0
    clean = toxicity.filter_clean(awkward, toxicity.Grammar.learn(awkward.select("doc_id", "text"), labels.limit(0)))
    assert clean.columns == awkward.columns and clean.count() == 13


# ---- language model ------------------------------------------------------------------------------------


def segmentations(w):
    return [[w]] + [[w[:k], *rest] for k in range(1, len(w)) for rest in segmentations(w[k:])] if w else [[]]


def test_lattice_sums_all_segmentations():
    probs = {"▁": 0.1, "▁a": 0.2, "b": 0.1, "ab": 0.05, "▁ab": 0.03, "a": 0.02, "é": 0.01}
    lat = lm.Lattice(probs, 1e-4)
    for word in ("ab", "aab", "bé", "zab"):
        p = lambda x: probs.get(x, 0.0) + (1e-4 ** len(x.encode()) if len(x) == 1 else 0.0)
        want = sum(math.prod(map(p, s)) for s in segmentations("▁" + word))
        assert lat.log10(word.encode()) == pytest.approx(math.log10(want))
    assert math.isfinite(lat.log10(b"z" * 20_000))
    into = {}
    lat.expect(b"ab", 3.0, into)
    assert sum(into.values()) > 3 and all(v > 0 for v in into.values())


def test_expected_pieces_equal_brute_force():
    probs = {"▁": 0.1, "▁a": 0.2, "b": 0.1, "ab": 0.05, "▁ab": 0.03, "a": 0.02, "ba": 0.04}
    lat, p = lm.Lattice(probs, 1e-4), lambda x: probs.get(x, 0.0)
    for word in ("ab", "aab", "abba", "babab"):
        all_ = [(math.prod(p(x) + (1e-4 if len(x) == 1 else 0.0) * (x.isascii()) + (1e-12 if x == "▁" else 0.0) for x in s), s) for s in segmentations("▁" + word)]
        # a single character counts as its piece by the share of the piece in its weight
        whole, want = sum(w for w, _ in all_), collections.Counter()
        for w, s in all_:
            for x in s:
                spelled = 0.0 if len(x) > 1 else 1e-4 if x.isascii() else 1e-12
                if p(x):
                    want[x] += 2 * w / whole * p(x) / (p(x) + spelled)
        into = {}
        lat.expect(word.encode(), 2.0, into)
        assert {x: v for x, v in into.items() if v > 1e-12} == pytest.approx({x: v for x, v in want.items() if v > 1e-12})
    long, short = {}, {}
    lat.expect(b"ab" * 5000, 1.0, long)  # far beyond what a number holds without scales
    lat.expect(b"ab" * 500, 1.0, short)
    assert long["ab"] == pytest.approx(10 * short["ab"], rel=0.01)


def test_scores_equal_brute_force(spark):
    """The score column: one step of expectation maximisation and the sum over segmentations, by enumeration."""
    docs = [(k, t) for k, t in enumerate(["to be or", "be not", "to", "", "or not to"] * 4)]
    path = tokenizer_path("piece_bpe_32k.model")
    start = lm.Lattice.from_model(path)
    train = [t for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    spelled = lambda b, x: 0.0 if len(x) > 1 else b ** len(x.encode())
    got = collections.Counter()
    for word, n in collections.Counter(w for t in train for w in t.split()).items():
        all_ = [(math.prod(start.probs.get(x, 0.0) + spelled(start.byte, x) for x in s), s) for s in segmentations("▁" + word)]
        whole = sum(w for w, _ in all_)
        for w, s in all_:
            for x in s:
                if x in start.probs:
                    got[x] += n * w / whole * start.probs[x] / (start.probs[x] + spelled(start.byte, x))
    total = sum(got.values()) + len(train) + 0.01 * len(start.probs) + 2.56
    p = lambda x: ((got[x] + 0.01) / total if x in start.probs else 0.0) + spelled(0.01 / total, x)
    word = lambda w: sum(math.prod(map(p, s)) for s in segmentations("▁" + w))
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    for r in rows:
        want = sum(math.log10(word(w)) for w in docs[r.doc_id][1].split()) + math.log10(len(train) / total)
        assert r.score == pytest.approx(want, rel=1e-6)


def test_base_scores_equal_brute_force(corpus, texts, monkeypatch):
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1}
    c = collections.Counter(x for d in train for x in [*words(texts[d]), lm.END])
    n, v = sum(c.values()), len(c)
    for heavy in (lm.HEAVY, 50):
        monkeypatch.setattr(lm, "HEAVY", heavy)
        for r in lm.score(corpus, tokenizer_path("piece_bpe_32k.model")).collect():
            w = [*words(texts[r.doc_id]), lm.END]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
            assert r.score < 0


def test_lm_of_awkward_and_empty_tables(awkward, empty):
    rows = lm.score(awkward, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == 13 and sum(r.n_tokens == 1 for r in rows) == 4 and all(math.isfinite(r.score) for r in rows)
    assert lm.score(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0
