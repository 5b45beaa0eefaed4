"""The conversation trie against a plain one, and its cases at the edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    for v in by.values():
        v.sort(key=lambda z: z[0])
    seqs = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = [z[1:] for z in by.get(c - c % 20, [])[:h]] + [z[1:] for z in own[h:]]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in children[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_same_nodes_over_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_conversation_trie(spark, sf)) == plain(rows)


@pytest.mark.parametrize("chunk", [3, 5, trie.CHUNK])
def test_shared_beginnings_copies_and_long_conversations(spark, chunk):
    rnd = random.Random(chunk)
    rows = []
    for c in range(130):
        if c in (20, 45, 47) or rnd.random() < 0.1:
            continue  # absent conversations, a base among them
        length = rnd.choice([0, 1, 2, 3, 5, 9, 17]) + 1
        same = rnd.random() < 0.5
        for t in range(length):
            rows.append((c, t, rnd.choice(["user", None]) if not same else "user", f"turn {t} a b" if same else rnd.choice(["x y", "z", None, ""])))
    rnd.shuffle(rows)
    got = rows_of(trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk))
    assert got == plain(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(empty).collect() == [] and trie.trie(empty).columns == COLUMNS
    # null turns first, null ids left out, clashing further columns unread, a conversation of a million words whole
    rows = [(5, 1, "user", "b"), (5, None, "user", "a"), (None, 0, "user", "x"), (7, 0, None, "w " * 10**6), (-3, 0, "user", "n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Node", F.lit(1)).withColumn("words", F.lit(2)).withColumn("family", F.lit("x"))
    assert rows_of(trie.trie(df)) == plain([r for r in rows if r[0] is not None])
    # a hot node: blocks of ends, and a turn that ties with an equal one
    many = [(c, t, "user", "same text") for c in range(0, 300) for t in (0, 0)]
    before, trie.BLOCK = trie.BLOCK, 40
    try:
        assert rows_of(trie.trie(spark.createDataFrame(many, SCHEMA))) == plain(many)
    finally:
        trie.BLOCK = before
