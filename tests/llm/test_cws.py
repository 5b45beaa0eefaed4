"""Fingerprints: a plain version of the sampling, the likeness they estimate, and cases at the edges."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.llm import cws, queries


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (a, b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def check(rows, docs):
    docs = sorted(((i, x or "") for i, x in docs), key=lambda d: d[0])
    seen = {}
    for r in rows:
        k = next(k for k, d in enumerate(docs) if d[0] == r.doc_id)
        text, following = docs[k][1], docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        yield r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)


def test_edits_neighbours_and_likeness_over_the_given_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op13_fingerprints(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    off = list(check(rows, docs))
    for side in zip(*off):
        assert abs(sum(side) / len(side)) < 0.04 and max(map(abs, side)) <= 0.45


def test_collision_rate_is_the_generalised_jaccard(spark, monkeypatch):
    monkeypatch.setattr(cws, "SAMPLES", 2000)
    pairs = [("a " * 10 + "b c d d", "a " * 5 + "b c c c d d"), ("a b c d", "a b e f"), ("x " * 300 + "y", "x " * 200 + "y z"), ("a b", "c d")]
    texts = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.id: r.fingerprint for r in cws.fingerprints(spark.createDataFrame(texts, "id long, text string"), ["id"], "text").collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = got[2 * i], got[2 * i + 1]
        rate = sum(x[4 * k : 4 * k + 4] == y[4 * k : 4 * k + 4] for k in range(2000)) / 2000
        assert abs(rate - jaccard(a, b)) < 0.045


@pytest.mark.parametrize("rows_of_block", [1, 3, 256])
def test_blocks_and_edges(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(cws, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(cws, "RANGES", 4)
    rnd = random.Random(3)
    docs = [(i * i * i - 50, " ".join(rnd.choice("abcdefgh😀é") for _ in range(rnd.randrange(0, 30)))) for i in range(40)] + [(10**15, None), (10**15 + 1, ""), (10**15 + 2, "word " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Block", F.lit(1)).withColumn("side", F.lit("s")).repartition(5)
    rows = cws.fingerprint_documents(df).collect()
    assert len(rows) == len(docs)
    assert max(abs(x) for pair in check(rows, docs) for x in pair) <= 0.5
    last = {r.doc_id: r for r in rows}
    assert (last[10**15].fingerprint, last[10**15].near_edited, last[10**15].near_next, last[10**15 + 1].near_next) == ("", 1.0, 1.0, 0.0)


def test_single_repeated_and_null_ids(spark):
    assert cws.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = cws.fingerprint_documents(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"ab ab").hexdigest())]
    rows = cws.fingerprint_documents(spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c d"), (None, "c d"), (7, "e f")], "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in rows) == {7: 3, None: 2} and len({r.fingerprint for r in rows}) == 3


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.op13_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
