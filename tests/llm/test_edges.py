"""Cases at the edges of the corpus operators, each against a plain version."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, language, lattice, media, mixing, packing, pii, sharding, warc


def test_near_misses_of_a_million_characters(spark):
    n = 10**6
    texts = ["x@" + "a." * (n // 2), "a." * (n // 2) + "@", "a" * n + "@b", "1" * n, "1-" * (n // 2), "f" * n, "1." * (n // 2), "+1 " * (n // 3), "DE89" + "A" * n, "a@b" + "-" * n, "2024-" * (n // 5)]
    got = pii.masked(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [len(r.text) for r in got] == [len(t) for t in texts]
    mail = pii.masked(spark.createDataFrame([(1, "write to ann.lee@mail.example.org."), (2, "ann.lee@mail.example.org")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert mail[0].text == f"write to {mail[1].text}." and "ann.lee" not in mail[1].text


def test_ibans_stay_apart_and_other_check_digits_are_no_ibans(spark):
    got = [r.text for r in pii.masked(spark.createDataFrame([(1, "DE02000000000000000030"), (2, "DE99000000000000000030")], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[0] != "DE02000000000000000030" and got[1] == "DE99000000000000000030"


def plain_permuted(x, n, key, kind):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    digest = lambda *parts: int(hashlib.sha256("|".join([key, kind, *map(str, parts)]).encode()).hexdigest()[:13], 16)
    while True:
        u, v = x % a, x // a
        for i in range(8):
            if i % 2 == 0:
                u = (u + digest(i, v)) % a
            else:
                v = (v + digest(i, u)) % b
        x = u + v * a
        if x < n:
            return x


def test_permutation_matches_the_plain_network(spark):
    for n in (1, 7, 1000, 73_414):
        got = spark.range(min(n, 300)).select("id", pii.permuted(F.col("id"), n, "k", "date").alias("to")).collect()
        assert all(r.to == plain_permuted(r.id, n, "k", "date") for r in got)
    few = spark.range(1000).select(pii.permuted(F.col("id"), 1000, "k", "x").alias("to")).distinct().count()
    assert few == 1000


def test_no_document_is_taken_more_than_three_times(spark):
    rows = [(i, "a", "w " * (0 if i % 4 else 30)) for i in range(40)] + [(100 + i, "b", "w " * 4000) for i in range(40)]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, source string, text string"), "few")
    times = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert max(times.values()) <= 3 and {times[i] for i in range(40)} == {3}


def test_sizes_and_checksums_of_shards(spark, sf):
    docs = common.read(spark, sf, "documents")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in sharding.shard_documents(docs).collect():
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))


def test_images_hold_the_payload(spark):
    texts = [None, "", "a", "é" * 288, "xyz " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    images = {r.key: r for r in media.image_figures(media.with_images(docs)).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = images[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])


def test_odd_lengths_are_bad_archives():
    good = warc.record(1, "u", b"body", warc.digest32(b"body"), None, False)
    for bad in (good.replace(b"Content-Length: 4", b"Content-Length: abc"), good.replace(b"WARC-Type: ", b"WARC-\xff: ")):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


def test_equal_largest_pages_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (0, "c", "x"), (None, "d", "y"), (None, "e", "y")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    assert got == [("0", "revisit", 1), ("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "response", None)]


def test_ids_of_a_large_vocabulary_keep_their_width(monkeypatch):
    class Large:
        def get_vocab_size(self):
            return 70_000

    monkeypatch.setattr(packing, "_tokenizer", lambda path: (Large(), {}))
    assert packing.id_type("x") == "<u4"
    out = list(packing._cut(iter([__import__("pyarrow").record_batch([[1], [0], [2], [struct.pack("<II", 69_999, 2)]], names=["key", "begin", "doc_tokens", "ids"])]), "<u4"))
    assert out[0].column(3).to_pylist() == [zlib.crc32(struct.pack("<II", 69_999, 2))]


def test_long_words_have_the_same_recursions():
    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(1)
    words = ["".join(rnd.choice("thea nion".replace(" ", "")) for _ in range(30)), "日本" * 12]
    short, counts = p.marginal(words), p.expect(words, np.array([2.0, 3.0]))
    before, lattice.LONG = lattice.LONG, 5
    try:
        assert np.allclose(p.marginal(words), short) and np.allclose(p.expect(words, np.array([2.0, 3.0])), counts, atol=1e-9)
    finally:
        lattice.LONG = before


def test_scores_match_a_plain_sum(spark):
    rnd = random.Random(2)
    vocab = ["the", "onion", "ñandú", "z" * 60, "qqx"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 9)))) for i in range(60)] + [(60, None), (61, "neverseen " * 3)]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string"), "lm")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = Counter(w for i, x in rows if not held[i] for w in [*(x or "").split(), None])
    n, v = sum(count.values()), len(count)
    once, twice = (sum(c == k for w, c in count.items() if w) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [w for w in count if w]
    for _ in range(lattice.PASSES):
        p.learn(p.expect(words, np.array([float(count[w]) for w in words]) ** lattice.POWER), count[None])
    for r in lattice.scored(docs).collect():
        own = [*(dict(rows)[r.doc_id] or "").split(), None]
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs_tol=1e-5)
        spread = d * (v - 1) / n
        want = sum(math.log10(count[None] / n) if w is None else math.log10(max(count[w] - d, 0) / n + spread * 10 ** p.marginal([w])[0]) for w in own)
        assert math.isclose(r.score, want, abs_tol=1e-4) and r.n_known == sum(count[w] > 0 for w in own) and r.held_out == held[r.doc_id]


def test_fusion_matches_the_plain_rule(spark):
    rnd = random.Random(4)
    word = {"de": ["der", "und", "nicht"], "en": ["the", "and", "not"], "fr": ["le", "et", "pas"]}
    docs = spark.createDataFrame([(i, code, " ".join(rnd.choice(word[code]) for _ in range(20))) for i, code in enumerate(["de", "en", "fr-CA", "en"] * 5) for code in [code[:2]]] + [(99, "nonsense", "x y"), (98, None, "x")], "doc_id long, lang string, text string")
    hosts = ["a.example.co.uk", "b.example.co.uk", "x.other.co.uk", "h.de", "www.h.de", ""]
    pages = []
    for i in range(60):
        code = rnd.choice(list(word))
        said = rnd.choice(["", f'<html lang="{code}">', '<html lang="xx">', "<!-- <html lang=en> geheim > -->"])
        pages.append((i, f"http://{rnd.choice(hosts)}/p", said + "<p>" + " ".join(rnd.choice(word[code]) for _ in range(rnd.randrange(0, 4)))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    codes, likely = language.train(docs)
    assert codes == ["de", "en", "fr"]

    def domain(h):
        x = h.split(".")
        return ".".join(x[-3:] if len(x) > 2 and len(x[-1]) == 2 and x[-2] in language.SECOND else x[-2:])

    host = lambda u: u.split("/")[2]
    logs, post, said = {}, {}, {}
    for i, u, x in pages:
        e = language.TEMPER * likely[:, language.trigrams(language.visible(x))].sum(1)
        logs[i] = e - e.max()
        post[i] = np.exp(logs[i]) / np.exp(logs[i]).sum()
        said[i] = language.declared(x)
    sums = defaultdict(lambda: np.zeros(3))
    for i, u, _ in pages:
        h = host(u)
        for k in (("all",), ("s", h.split(".")[-1]), ("d", domain(h), h.split(".")[-1]), ("h", h), *([("c", said[i]), ("said",)] if said[i] else [])):
            sums[k] += post[i]
    n_codes = len({c for c in said.values() if c})
    for r in language.identified(df, docs).collect():
        i, h = r.page_id, host(dict((p[0], p[1]) for p in pages)[r.page_id])
        prior = np.maximum(sums["all",] - post[i], 0) + 1
        prior /= prior.sum()
        for k in (("s", h.split(".")[-1]), ("d", domain(h), h.split(".")[-1]), ("h", h)):
            own = np.maximum(sums[k] - post[i], 0)
            prior = (own + language.TRUST * prior) / (own.sum() + language.TRUST)
        total = logs[i] + np.log(prior)
        if said[i]:
            total = total + np.log((np.maximum(sums["c", said[i]] - post[i], 0) + 1 / (n_codes + 1)) / (sums["said",] + 1 - post[i]))
        p = np.exp(total - total.max())
        p /= p.sum()
        assert r.lang == codes[int(np.argmax(p))] and abs(r.confidence - p.max()) < 1e-4
