from lidarlake.llm import lines


def test_short_lines_that_recur(spark):
    """Short boilerplate of many documents and lines in a script without blanks go; rare short lines and headings stay."""
    notice, rare, han = "All rights reserved.", "As said before", "\u7248\u6743\u6240\u6709\u672a\u7ecf\u8bb8\u53ef\u4e0d\u5f97\u8f6c\u8f7d"
    rows = [(k, "\n".join([f"own{'abcdefgh'[k]} text", notice, "Summary", *([rare] if k < 4 else []), *([han] if k in (2, 5) else [])])) for k in range(8)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], 0)
    for k in range(1, 8):
        want = [x for x in rows[k][1].split("\n") if x != notice and (x != han or k == 2)]
        assert got[k] == ("\n".join(want), 1 + (k == 5))


def test_short_lines_of_a_corpus(spark):
    corpus, where = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    for d, t in texts.items():
        for x in t.split("\n"):
            if 3 <= len(x.split()) < 6 and x.isascii():
                where.setdefault(tuple(x.split()), set()).add(d)
    often = {x: d for x, d in where.items() if len(d) >= 5}
    assert often
    for r in lines.dedup_lines(corpus).collect():
        for x in (r.text or "").split("\n"):
            assert tuple(x.split()) not in often or min(often[tuple(x.split())]) == r.doc_id
