"""Operators against brute force, and the cases that their docstrings define."""

import itertools
import json
import math
import random
import zlib

import numpy as np
import pytest

from marketlens.llm import common, graph, jaccard, language, lattice, media, mixing, packing, pii, quality, sharding, warc

PIECES = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def corpus():
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Énorme", "über", "x1", "omega", "the", "of"]
    text = lambda n: " ".join(rnd.choice(words) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(n))
    base = [text(rnd.randrange(1, 160)) for _ in range(40)]
    near = [b.split(" ") for b in base[:12] if len(b.split(" ")) > 60]
    for w in near:
        w[len(w) // 2] = "changed"
    texts = [*base, *(" ".join(w) for w in near), base[0], base[0].upper(), None, "", "  \n ", "one", "one two", "a\nb\na\nb\n" * 40, text(20_000), "z" * 5000, "\x00 nul", "4111111111111111 a@b.com"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4], None, "k", "s") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_quality_figures_and_whole_results(docs, empty):
    got = quality.judged(docs).collect()
    assert len(got) == docs.count() and "kept_" in got[0].asDict() and quality.judged(empty).count() == 0
    for r in got:
        w = words(r.text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 2000 else None
        lines = [x for x in (r.text or "").encode().split(b"\n") if x.strip()]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        if inside is not None:
            assert r.n_repeat_words == len(inside)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept_)
    assert quality.keep_good(docs).columns == docs.columns


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = PIECES.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.packed(docs).collect()
    want = sorted((str(r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want) and packing.packed(empty).count() == 0
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, own in by_seq.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(itertools.accumulate([0, *(r.length for r in own)]))[:-1]
        assert sum(r.length for r in own) == 4096 or k == max(by_seq)
    ids = dict(want)
    for r in rows:
        if r.doc_id is not None:
            full = ids[str(r.doc_id)]
            assert r.doc_tokens == len(full) and r.ids_crc32 == zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes())


def test_png_round_trip_filters_and_damage(docs, empty):
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 256, (7, 576), dtype=np.uint8)
    png = media.encode_png(a, piece=1000)
    assert (media.decode_png(png) == a).all()
    with pytest.raises(media.BadImage):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(media.BadImage):
        media.decode_png(png[:-5])
    left, up = np.hstack((np.zeros((7, 1), np.uint8), a[:, :-1])).astype(int), np.vstack((np.zeros((1, 576), np.uint8), a[:-1])).astype(int)
    corner = np.vstack((np.zeros((1, 576), int), left[:-1]))
    p = left + up - corner
    d = np.stack((abs(p - left), abs(p - up), abs(p - corner)))
    paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
    for kind, guess in ((0, 0), (1, left), (2, up), (3, (left + up) // 2), (4, paeth)):
        assert (media.unfilter(np.full(7, kind), ((a.astype(int) - guess) % 256).astype(np.uint8)) == a).all()
    got = media.image_figures(media.with_images(docs)).collect()
    assert len(got) == docs.count() and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and len(r.hash) == 8 for r in got)
    assert media.image_figures(media.with_images(empty)).count() == 0


def test_language(spark, sf, docs, empty):
    d = common.read(spark, sf, "documents")
    pages = common.read(spark, sf, "pages")
    got = language.identified(pages, d).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got if r.declared]) > 0.8
    odd = spark.createDataFrame([(1, None, None), (1, "x", ""), (None, "http://h.de/", "<html lang=de>Der <script>the the")], "page_id long, url string, html string")
    assert language.identified(odd, d).count() == 3 and language.identified(odd, empty).where("lang IS NULL").count() == 3
    assert language.identified(odd.limit(0), d).count() == 0
    assert language.visible("a<b>c</b><script>no</script><!-- x -->&amp;<").split() == ["a", "c", "&"] or "no" not in language.visible("a<script>no</script>")


def test_mix_targets_and_bounds(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_documents(empty).count() == 0
    total, sizes = sum(r.size for r in rows), {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, s))
    size = {s: sum(r.size for r in sizes[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            free.remove(s)
    for s in order:
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.taken <= 3 * r.size and r.source_size == size[s] for r in sizes[s])
        assert abs(sum(r.taken for r in sizes[s]) - target[s]) <= max(r.size for r in sizes[s])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in rows)


def test_shards(docs, empty, spark):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and sharding.shard_documents(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    for n in (1, 2, 3, 17, 100):
        assert sorted(r[0] for r in spark.range(n).select(sharding.feistel(common.F.col("id"), n, 5)).collect()) == list(range(n))


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, docs, empty):
    texts = ["4111 1111 1111 1111 / 4111111111111111 / 4111111111111112", "1984-02-29 1983-02-29", "10.0.0.1 and 10.0.0.999", "ann.lee7@mail.example.org", "+1 (017) 555-7713", "DE89370400440532013000", "123-45-6789 000-12-3456", None, "", "ver 1.2.3"]
    got = [r.text for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    a, b, c = got[0].split(" / ")
    assert a.replace(" ", "") == b != texts[0].split(" / ")[1] and luhn(b) and c == "4111111111111112"
    assert got[1].endswith(" 1983-02-29") and not got[1].startswith("1984-02-29") and got[2].endswith("10.0.0.999") and not got[2].startswith("10.0.0.1 ")
    assert got[3].endswith("@mail.example.org") and got[3] != texts[3] and len(got[4]) == len(texts[4]) and got[4] != texts[4]
    moved = "".join(str(int(x, 36)) for x in got[5][4:] + got[5][:4])
    assert int(moved) % 97 == 1 and got[5] != texts[5] and got[6].endswith("000-12-3456") and got[7:] == [None, "", "ver 1.2.3"]
    assert pii.masked(docs, "k").columns == docs.columns and pii.masked(docs, "k").count() == docs.count() and pii.masked(empty, "k").count() == 0
    cards = spark.range(1000).selectExpr("id AS doc_id", "concat('4', lpad(CAST(id AS STRING), 14, '0')) AS b").withColumn("text", common.F.concat("b", common.F.pmod(-pii.luhn_sum(common.F.concat("b", common.F.lit("0"))), common.F.lit(10)).cast("string")))
    assert pii.report(cards, "k").select("text").distinct().count() == 1000


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://e", "é\r\n\r\n" * 50_000), (5, "http://e", "other"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes): r for r in warc.archived(pages).collect()}
    assert len(got) == 7 and got[2, 4].record_type == "response" and got[1, 4].refers_to == 2 and got[None, 4].refers_to == 2
    assert got[3, 0].refers_to == 4 and got[4, 0].record_type == "response" and got[5, 300_000].payload_digest == warc.digest32(("é\r\n\r\n" * 50_000).encode())
    assert warc.archived(pages.limit(0)).count() == 0
    data = warc.archive([warc.record(1, "u", b"body", warc.digest32(b"body"), None, False)], b"some dictionary text" * 20)
    (tmp_path / "x.warc.zst").write_bytes(data)
    assert warc.read_files(spark, str(tmp_path)).first().payload == b"body"
    for bad in (data[:-3], b"x" + data, data[4:]):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(bad))
    with pytest.raises(warc.BadArchive):
        warc.parse(warc.record(1, "u", b"body", "WRONG", None, False))


def test_lattice(docs, empty):
    p = lattice.Pieces(PIECES.path("piece_bpe_32k.model"))

    def brute(w):
        if not w:
            return 1.0
        total = sum(10 ** p.logp[p.at[w[:n]]] * brute(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p.at)
        return total + (10 ** p.of_bytes(w[0]) * brute(w[1:]) if w[0] not in p.at else 0)

    sample = ["the", "onion", "ñandú", "\U0001f600x"]
    assert np.allclose(p.marginal(sample), [math.log10(brute("▁" + w)) for w in sample])
    assert np.isclose(p.expect(sample, np.ones(4)).sum(), sum(p.expect([w], np.ones(1)).sum() for w in sample))
    rows = lattice.scored(docs).collect()
    assert len(rows) == docs.count() and lattice.scored(empty).count() == 0
    train = [w for r in docs.collect() if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 10 for w in [*words((r.text or "").lower() if (r.text or "").isascii() else (r.text or "")), b"</s>"]]
    assert rows[0].train_tokens == len(train) and all(r.score < 0 for r in rows)
    full = {(str(r.doc_id), len(words(r.text)) + 1) for r in docs.collect()}
    assert {(str(r.doc_id), r.n_tokens) for r in rows} == full


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [rows[i].doc_id for i in own if rows[i].doc_id is not None]
        out += [(str(rows[i].doc_id), len(sets[i]), str(min(ids) if ids else None)) for i in own]
    return sorted(out)


def test_jaccard_join(docs, empty, spark):
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.joined(docs).collect()) == brute_components(docs.collect())
    assert jaccard.joined(empty).count() == 0
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    rnd = random.Random(3)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for i in range(160):  # many near copies of one text, with edits at the limit, beside texts that share a long passage
        w = [f"w{k}" for k in range(100)] if i < 80 else [*shared, *(f"d{i}-{k}" for k in range(rnd.randrange(5, 40)))]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        rows.append((i, " ".join(w)))
    hot = common.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "hot")
    for block in (1024, 16):
        jaccard.BLOCK, before = block, jaccard.BLOCK
        try:
            assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.joined(hot).collect()) == brute_components(hot.collect())
        finally:
            jaccard.BLOCK = before


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and json.dumps([n for n, _ in corpus_pipeline.STAGES]) and max(r.length for r in rows) <= 4096
