"""Every stage of the pipeline against a plain version of what it does, on a table with nulls, copies and clashing names."""

import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import common, mixing, pii, quality
from test_llm import brute_components


def odd_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = docs.collect()
    long = max(rows, key=lambda r: len(r.text or ""))
    near = long.asDict() | {"doc_id": 9001, "text": (long.text or "") + " tail"}
    more = [long.asDict(), near, near, long.asDict() | {"doc_id": None, "text": None}, long.asDict() | {"doc_id": 9003, "text": "", "source": None}, long.asDict() | {"doc_id": 9004, "text": "word " * 30000}]
    out = docs.union(spark.createDataFrame(more, docs.schema))
    for name in ("kept", "_place", "key", "size", "ids", "label"):
        out = out.withColumn(name, F.lit(name))
    return common.written(out.repartition(3), "odd")


def counted(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def test_stages_against_plain_versions(spark, sf):
    docs = odd_documents(spark, sf)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = common.written(stages["quality"](spark, docs, sf), "a")
    verdict = {(str(r.doc_id), r.text) for r in quality.judged(docs).where("kept_").collect()}
    assert good.columns == columns and counted(good) == Counter({k: n for k, n in counted(docs).items() if (k[columns.index("doc_id")], k[columns.index("text")]) in verdict})
    once = common.written(stages["near_copies"](spark, good, sf), "b")
    rows = good.collect()
    firsts = {c for _, n, c in brute_components(rows)}
    assert once.columns == columns and sorted(str(r.doc_id) for r in once.collect()) == sorted(firsts)
    safe = common.written(stages["pii"](spark, once, sf), "c")
    assert safe.columns == columns and counted(safe) == counted(pii.masked(once, pii.session_key(spark))) and safe.count() == once.count()
    mix = common.written(stages["mix"](spark, safe, sf), "d")
    times = Counter({tuple(map(str, r)): 0 for r in safe.collect()})
    taken = {str(r.doc_id): (r.taken, r["size"]) for r in mixing.mix_documents(safe).collect()}
    at = columns.index("doc_id")
    assert mix.columns == columns and all(n <= 3 and n * taken[row[at]][1] == taken[row[at]][0] for row, n in (times | counted(mix)).items())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in mix.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[str(r.doc_id), len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    pieces = stages["pack"](spark, mix, sf).collect()
    whole = Counter((str(r.doc_id), r.length, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
    assert not whole - want and sum(r.length for r in pieces) == sum(k[1] * n for k, n in want.items())
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert sorted(filled) == list(range(len(filled))) and all(n == 4096 for k, n in filled.items() if k < len(filled) - 1)


def test_stages_on_an_empty_table(spark, sf):
    docs = odd_documents(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf), name)
        assert out.count() == 0
        docs = out if name != "pack" else docs
