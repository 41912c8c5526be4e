"""What the corpus operators share: tables, the shared folder, words and stable hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words in every operator here: space and \t to \r.
SPACE = "\x20\x09-\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests) a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "lidarlake-shared")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lidarlake/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words of UTF-8 text with A-Z lowered; bytes.split() splits at exactly SPACE."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def lines_with_words(text: str) -> list[str]:
    return [x for x in text.split("\n") if HAS_WORD(x)]


HAS_WORD = re.compile(f"[^{SPACE}]").search


class Hashes(dict):
    """word -> stable 64-bit hash, kept for ``most`` words so that memory stays bounded."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (shift-xor-multiply), so that sums of products spread evenly."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + h[k : n - size + 1 + k])
    return np.unique(out)


def small(batches, rows: int = 512):
    """Record batches cut to at most ``rows``: bounds what a step holds as Python objects."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)
