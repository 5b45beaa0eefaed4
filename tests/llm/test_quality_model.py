"""The models of the quality rules against a plain version with dictionaries, and the verdict against the plain rule."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketlens.llm import common, quality


def plain_units(text):
    x = "".join("\1" if c == "\0" else c for c in (text or "").lower())
    x = re.sub(r"[ \t-\r]+", " ", re.sub(r"[#*$%&|<>]+", "#", re.sub(r"[0-9]", "0", x)))
    raw = x.encode("utf-16-le", "surrogatepass")
    return [0, 0, 0, *(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)), 0]


class Plain:
    """Modified Kneser-Ney over 4-grams of one language, order by order, each n-gram a tuple."""

    def __init__(self, texts):
        four = Counter(tuple(u[i - 3 : i + 1]) for u in map(plain_units, texts) for i in range(3, len(u)))
        self.levels = [four]
        while len(self.levels) < 4:
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.levels.reverse()
        self.discount = []
        for level in self.levels:
            n = Counter(level.values())
            if all(n[i] for i in range(1, 5)):
                y = n[1] / (n[1] + 2 * n[2])
                self.discount.append([0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), 0.95 * i) for i in (1, 2, 3))])
            else:
                self.discount.append([0, 0.5, 1.0, 1.5])
        self.after = []
        for level in self.levels:
            by = defaultdict(list)
            for g, c in level.items():
                by[g[:-1]].append(c)
            self.after.append(by)

    def p(self, gram):
        k = len(gram) - 1
        lower = self.p(gram[1:]) if k else 1 / 65536
        own = self.after[k].get(gram[:-1])
        if not own:
            return lower
        d, total = self.discount[k], sum(own)
        c = self.levels[k].get(gram, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in own) / total * lower

    def perplexity(self, text):
        u = plain_units(text)
        return -sum(math.log10(self.p(tuple(u[i - 3 : i + 1]))) for i in range(3, len(u))) / (len(u) - 3)


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        lang = rnd.choice(["en", "ru", None])
        letters = "abcde" if lang == "en" else "жизнь" if lang == "ru" else "日本語文字"
        n = rnd.choice([0, 30, 60, 90, 120])
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 4))) for _ in range(n)]
        if i % 20 == 7:
            words = ["%s😀%d" % (chr(rnd.randrange(0x4E00, 0x9000)), rnd.randrange(9)) for _ in range(80)]
        rows.append((i, lang, None if i == 3 else " ".join(words)))
    rows += [(200 + i, "en", "abc dea " * 60 + " ".join(f"q{k}" for k in range(150))) for i in range(60)]  # a third are copies
    return common.written(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3), "mixed")


def test_model_and_verdict_match_the_plain_version(mixed):
    rows = mixed.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r.text)
    plain = {code: Plain(texts) for code, texts in by.items()}
    got = {r.doc_id: r for r in quality.judged(mixed).collect()}
    want = {r.doc_id: plain[r.lang].perplexity(r.text) for r in rows}
    for r in rows:
        assert abs(got[r.doc_id].log_perplexity - want[r.doc_id]) < 1e-4
    assert any(g.kept for g in got.values()) and any(not g.kept and not g.base_failed for g in got.values())
    for code in by:
        passing = {r.text: got[r.doc_id] for r in rows if r.lang == code and not got[r.doc_id].base_failed}
        at = lambda xs, p: sorted(xs)[math.ceil(p * len(xs)) - 1]
        ppl, n = [g.log_perplexity for g in passing.values()], [g.n_words for g in passing.values()]
        low, mid, high = (at(ppl, p) for p in (0.25, 0.5, 0.75))
        for r in rows:
            g = got[r.doc_id]
            if r.lang == code:
                wider = max(math.sqrt(at(n, 0.5) / max(g.n_words, 1)), 0.6)
                edges = (mid - 8.0 * max(mid - low, 0.001) * wider, mid + 6.0 * max(high - mid, 0.001) * wider)
                if min(abs(g.log_perplexity - e) for e in edges) > 1e-4:
                    assert g.kept == (not g.base_failed and edges[0] <= g.log_perplexity <= edges[1])


@pytest.mark.parametrize("kept", [1 << 18, 40])
def test_probabilities_add_up_to_one(mixed, kept):
    quality.MODEL, before = kept, quality.MODEL
    try:
        model = quality.fit_model(mixed)
    finally:
        quality.MODEL = before
    assert len(model.keys) < 8 * kept
    for code, ctx in (("en", "abc"), ("en", "  a"), ("ru", "жиж"), (None, "日日本"), ("xx", "abc"), ("en", "zzz")):
        c = int.from_bytes(ctx.encode("utf-16-be"), "big")
        ids = np.uint64(c << 16) | np.arange(1 << 16, dtype=np.uint64)
        assert abs((10 ** model.score(ids, code)).sum() - 1) < 1e-3
