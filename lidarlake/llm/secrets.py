"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass of an automaton over the text finds where a secret can begin; only there is the kind's pattern tried,
anchored. Kinds whose values carry a checksum or a decodable structure are then validated and what fails is
dropped. Hex runs have no keyword: a run of 24 covers one of every 24th positions, so those positions are
probed and only hits are widened.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarlake.llm.common import small

#: Kinds in the order of equal starts. The first three are the base; the others are validated.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LEAST = 24
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: keyword (lower case) -> kind that may begin there
_WORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}


def _crc62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the random part in base 62."""
    n, out = zlib.crc32(m[1].encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0") == m[2]


def _json_parts(m: re.Match) -> bool:
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in m.groups())
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(body, dict)


def _der(m: re.Match) -> bool:
    """Base64 of a DER sequence whose length field equals what follows it."""
    try:
        raw = base64.b64decode("".join(m[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    size = raw[1] & 0x7F if raw[1] & 0x80 else 0
    told = int.from_bytes(raw[2 : 2 + size], "big") if size else raw[1]
    return told == len(raw) - 2 - size


_ANCHORED = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6), "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "github": (_GITHUB, _crc62), "npm": (_NPM, _crc62), "jwt": (_JWT, _json_parts), "pem": (_PEM, _der),
}
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for word, kind in _WORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost non-overlapping per kind, sorted by start and kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some capitals lower to two characters
        low = text.translate(_ASCII_LOWER)
    begins: dict[str, list[int]] = {}
    for end, (n, kind) in _automaton().iter(low):
        begins.setdefault(kind, []).append(end - n + 1)
    spans = []
    for kind, starts in begins.items():
        pattern, valid = _ANCHORED[kind]
        over = 0
        for at in sorted(starts):
            if at >= over and (m := pattern.match(text, at)):
                # a match that fails still covers its text
                over = m.end()
                if valid(m):
                    spans.append((kind, at, over))
    spans += hex_runs(text)
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def hex_runs(text: str) -> list[tuple[str, int, int]]:
    probe, out, over = text[_HEX_LEAST - 1 :: _HEX_LEAST], [], 0
    for m in _HEX.finditer(probe):
        for k in range(m.start(), m.end()):
            at = k * _HEX_LEAST + _HEX_LEAST - 1
            if at < over:
                continue
            begin = at
            while begin > over and text[begin - 1] in "0123456789abcdef":
                begin -= 1
            over = _HEX.match(text, at).end()
            if over - begin >= _HEX_LEAST:
                out.append(("hex", begin, over))
    return out


def _scan(batches):
    for batch in small(batches):
        found = [find(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], SPANS)], names=["doc_id", "spans"])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and spans, an array of (kind, start, end) by start and kind.

    Null or empty text: no spans. Repeated rows are scanned one by one; other columns are ignored; an empty
    table gives no rows. No shuffle.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digests(spans: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(keep=None):
        return F.array_join(F.transform(F.filter("spans", keep) if keep else F.col("spans"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(lambda s: s["kind"].isin(*KINDS[:3]))
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), joined().alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base alone, by whole-text patterns: what tests hold ``find`` against."""
    text, spans = text or "", []
    for m in _ASSIGN.finditer(text):
        spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, (pattern, least) in ((1, (_ACCESS, 20)), (2, (_HEX, _HEX_LEAST))):
        spans += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[0]) >= least]
    spans.sort()
    n = [sum(1 for s in spans if s[1] == k) for k in range(3)]
    return *n, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
