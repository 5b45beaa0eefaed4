"""Inputs on which an operator once did less than its whole job."""

import math
import zlib

import numpy as np
import pytest

from marketlens.llm import lattice, pii


def test_short_addresses_and_lettered_ibans_alone_in_a_text(spark):
    number = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4]))
    iban = next(v for k in range(100) if number(v := f"GB{k:02d}NWBKABCDEFGHIJKL") % 97 == 1)
    texts = ["10.0.0.1", "8.8.8.8", "10.1.2.33", "10.0.0.1 ann.lee7@mail.example.org", iban, "1.2.3 and 10.0.0.999", "no value here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.masked(docs, "k").orderBy("doc_id").collect()]
    assert all(a != b for a, b in zip(got[:5], texts)) and got[5:] == texts[5:]
    assert got[3].split(" ")[0] == got[0]  # equal values stay linked


def test_long_held_out_words_pay_for_each_character(spark, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(lattice, "fit", lambda words, pieces, ends: None)  # the first weights, so that the recursion here knows them
    p = lattice.Pieces(tokenizers.path("piece_bpe_32k.model"))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:8]
    long = {held[0]: "z" * 5000, held[1]: "z" * 10_000}
    rows = [*((i, f"alpha beta w{i}") for i in train), *long.items()]
    got = {r.doc_id: r.score for r in lattice.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, v = 8 * 3 + 8, 2 + 8
    spread = 0.5 * v / n  # no word occurs twice, so the discount is a half

    def plain(w):
        alpha = [0.0]
        for j in range(1, len(w) + 1):
            terms = [alpha[j - k] + p.logp[p.at[w[j - k : j]]] for k in range(1, min(j, p.most) + 1) if w[j - k : j] in p.at]
            terms += [] if w[j - 1] in p.at else [alpha[j - 1] + p.of_bytes(w[j - 1])]
            top = max(terms)
            alpha.append(top + math.log10(sum(10 ** (t - top) for t in terms)))
        return alpha[-1]

    for i, w in long.items():
        assert math.isclose(got[i], plain(lattice.MARK + w) + math.log10(spread) + math.log10(8 / n), rel_tol=1e-9), i
    assert got[held[1]] < 1.9 * got[held[0]] < -1000


def test_counted_words_blend_as_before():
    c, m = np.array([0, 1, 5]), np.array([-20.0, -3.0, -4000.0])
    want = np.log10(np.maximum(c - 0.5, 0) / 40 + 0.2 * 10 ** np.maximum(m, -300))
    assert np.allclose(lattice.blended(c, m, 40, 0.5, 0.2), want)
