import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lidarlake.llm import packing, token_files
from lidarlake.llm.common import shared_dir
from lidarlake.llm.queries import tokenizer_path
from lidarlake.llm.tokens import Encoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def plain(name, end):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_the_library(name, texts):
    e, want, r = Encoder(tokenizer_path(name), most=3000), plain(name, 0), random.Random(3)
    odd = ["İstanbul CAFÉ cafe\u0301 don't we'VE  two  \n\nx\t y ", "<|endoftext|> <|startoftext|>", " lead", "trail ", " ", "\n", "a \nb \n c", "ΣΑΣ ﬁx 12ab can't--stop", "日本 👍🏽", "x" * 2000, "ẞß ÆÐ"]
    odd += ["".join(r.choice(" \n\tabcE'sé\u0301.,!1İΣ日<|> ") for _ in range(r.randint(1, 40))) for _ in range(500)]
    for text in [*odd, *list(texts.values())[:150]]:
        assert e(text) == np.array(want(text)[:-1], "<u4").tobytes(), text[:60]


def test_files_round_trip(spark, corpus, texts):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write_tokens(corpus, path, tokenizer_path(WORD))
    want, start = plain(WORD, 1), 0
    got = {r.doc_id: r for r in token_files.token_digests(spark, path).collect()}
    for d in sorted(texts):
        ids = want(texts[d])
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_files.read_tokens(spark, path).where("doc_id = 7").collect()
    assert one[0].ids == want(texts[7])
    assert "ids" not in token_files.read_tokens(spark, path, ids=False).columns


def test_files_have_dictionaries_and_page_indexes(spark, corpus):
    import glob

    import pyarrow.parquet as pq

    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write_tokens(corpus, path, tokenizer_path(WORD))
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    ids = next(v for k, v in columns.items() if k.startswith("ids"))
    assert ids.has_dictionary_page and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_files_of_awkward_and_empty_tables(spark, awkward, empty):
    for df, n in ((awkward, 13), (empty, 0)):
        path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
        token_files.write_tokens(df, path, tokenizer_path(WORD))
        rows = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
        assert len(rows) == n
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_keeps_every_token(corpus, texts):
    rows = packing.pack(corpus, tokenizer_path(BYTE)).collect()
    n, want, got = check_packing(rows, 1024), plain(BYTE, 2), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(r.ids)
        got[r.doc_id] += r.ids
    assert got == {d: want(t) for d, t in texts.items()}
    assert n <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 2


def test_pack_awkward_and_empty_tables(awkward, empty):
    rows = packing.pack(awkward, tokenizer_path(BYTE), capacity=64).collect()
    check_packing(rows, 64)
    assert sum(r.ids == [2] for r in rows) >= 3  # null and empty texts
    assert packing.pack(empty, tokenizer_path(BYTE)).collect() == []


def test_histogram_is_packed_whole():
    r = random.Random(1)
    for f in (lambda: r.randint(1, 99), lambda: r.choice([30, 51, 60]), lambda: r.randint(1, 5), lambda: 100, lambda: r.randint(26, 70)):
        h = {}
        for _ in range(3000):
            x = f()
            h[x] = h.get(x, 0) + 1
        got = {}
        runs = packing.pack_histogram(h, 100)
        for run in runs:
            assert sum(run.lengths) + run.free == 100 and run.free >= 0
            for x in run.lengths:
                got[x] = got.get(x, 0) + run.count
        assert got == h
    assert packing.pack_histogram({}, 100) == []


def test_histogram_packs_as_well_as_best_fit_decreasing():
    """Many small documents, as in a corpus, and lengths that fit badly."""
    r = random.Random(7)
    for f in (lambda: min(1023, int(r.lognormvariate(5.5, 1.1)) + 1), lambda: r.randint(200, 1000), lambda: r.choice([200, 340, 342, 500, 513, 20])):
        h = {}
        for _ in range(4000):
            x = f()
            h[x] = h.get(x, 0) + 1
        fit = packing._BestFit(1024)
        for x in sorted(h, reverse=True):
            fit.place(x, h[x])
        assert sum(r.count for r in packing.pack_histogram(dict(h), 1024)) <= sum(r.count for r in fit.runs()) * 1.001 + 1
