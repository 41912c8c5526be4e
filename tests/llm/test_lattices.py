import random

import numpy as np
import pytest

from lidarlake.llm import lm
from lidarlake.llm.queries import tokenizer_path


def test_lattices_of_many_words_equal_those_of_one():
    """Side by side or one by one: words of all lengths, scripts and bytes; also where sums leave the range of a number."""
    r, lat = random.Random(4), lm.Lattice.from_model(tokenizer_path("piece_bpe_32k.model"))
    words = ["".join(r.choice("etaoinshr-éß中\x80\U0010ffff🙂\ud800z9") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    words += ["中文" * 20, "\ud800" * 40, "z" * 63, "z" * 64, "the" * 500, "a", "\U0010ffff", "the", "to"]
    words = list({w.encode("utf-8", "surrogatepass") for w in words})
    got = dict(lat.log10s(words))
    for w in words:
        one = lat._log(lat.MARK + w.decode("utf-8", "surrogatepass")) / np.log(10)
        assert got[w] == pytest.approx(one, rel=1e-12)
    counts, into, want = np.array([r.randint(1, 9) for _ in words], float), np.zeros(len(lat.starts) + 1), {}
    lat.expects(words, counts, into)
    for w, c in zip(words, counts.tolist()):
        lat.expect(w, c, want)
    assert {p: n for p, n in zip(lat.starts, into[1:].tolist()) if n > 1e-9} == pytest.approx({p: n for p, n in want.items() if n > 1e-9}, rel=1e-9)
