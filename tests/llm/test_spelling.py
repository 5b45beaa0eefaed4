"""Spelling variants against a plain version that tries every edit."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from marketlens.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        spots = range(len(w))
        tried = {w[:i] + w[i + 1 :] for i in spots} | {w[:i] + a + w[i + 1 :] for i in spots for a in letters} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        found = {x for x in tried if x in n and x != w}
        near[w] = len(found)
        if found and n[best := min(found, key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], near[w], n[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_same_words_over_the_given_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op12_spelling_variants(spark, sf)) == plain(docs)


def test_all_edits_ties_and_chains(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    rnd = random.Random(7)
    words = ["letters"] * 2000 + ["lettersx"] * 150 + ["lettersxy"] * 12 + ["etters", "lletters", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Über÷straße", "über÷straße", "bbbbbbb", "bbbbbba", "bbbbbbc"] * 3
    words += [w for w in ("".join(rnd.choice("abÀé") for _ in range(7)) for _ in range(400))] * 2
    docs = [(i, " ".join(rnd.sample(words, len(words) // 3)) + ",0_" + "-".join(rnd.sample(words, 50))) for i in range(12)] + [(None, "letters LETTERS letterz"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Word", F.lit(1)).withColumn("rank", F.lit(2)).repartition(6)
    got = rows_of(spelling.variants(df))
    assert got == plain(docs)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms


def test_long_words_have_digests_for_keys(spark, monkeypatch):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("ab") for _ in range(n)) for n in (7, 8, 9, 10, 11) for _ in range(40)]
    docs = [(i, " ".join(base)) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    for long in (8, 9):
        monkeypatch.setattr(spelling, "LONG", long)
        assert [(k.startswith("-"), kind) for kind, k in spelling.keys_of("abcabcabca") if kind == 2][0] == (True, 2)
        got = sorted(brute_near(spelling.keys_of, [w for w, *_ in want]).items())
        assert got == sorted((w, n) for w, _, _, _, n, _ in want)
    monkeypatch.undo()
    assert rows_of(spelling.variants(df)) == want
    long = "q" * 100_000  # a hundred thousand groups of short keys
    rows = rows_of(spelling.variants(spark.createDataFrame([(1, f"{long} {long} {long}z {long}z")], "doc_id long, text string")))
    assert [(r[0][-2:], r[3], r[4]) for r in rows] == [("qq", 2, 1), ("qz", 2, 1)]


def brute_near(keys_of, words):
    """Near counts from the groups that keys_of names."""
    groups, near = {}, Counter({w: 0 for w in words})
    for w in words:
        for kind, key in keys_of(w):
            groups.setdefault(key, []).append((kind, w))
    for members in groups.values():
        own = [w for kind, w in members if kind == spelling.SELF]
        gone = [w for kind, w in members if kind == spelling.DELETED]
        star = [w for kind, w in members if kind == spelling.STAR]
        for w in star:
            near[w] += len(star) - 1
        for w in own:
            near[w] += len(gone)
        for w in gone:
            near[w] += len(own)
    return near


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only 1234567")], "doc_id long, text string")).collect() == []
