"""Perplexities are over every 4-gram, however few of them a worker holds."""

from collections import defaultdict

import pytest

from marketlens.llm import quality
from test_quality_model import Plain, mixed  # noqa: F401


@pytest.mark.parametrize("held", [0, 40, 500])
def test_4_grams_that_no_worker_holds_count(mixed, monkeypatch, held):  # noqa: F811
    monkeypatch.setattr(quality, "MODEL", held)
    by, rows = defaultdict(list), mixed.collect()
    for r in rows:
        by[r.lang].append(r.text)
    plain = {code: Plain(texts) for code, texts in by.items()}
    got = {r.doc_id: r for r in quality.judged(mixed).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert abs(got[r.doc_id].log_perplexity - plain[r.lang].perplexity(r.text)) < 1e-4
    monkeypatch.undo()
    every = {r.doc_id: r for r in quality.judged(mixed).collect()}
    assert all(abs(got[i].log_perplexity - x.log_perplexity) <= 1e-6 and got[i].kept == x.kept for i, x in every.items())
