import random

from marketlens.llm import packing


def test_words_are_cut_where_the_vocabulary_cuts_and_pieces_are_remembered():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = random.Random(1)
    texts = ["".join(r.choice("ÀÖ×ØÞßàö÷ÿµªaZ's'LLre.,-_09\x1c\x00\x7f é½K<|endoftext|>D\"\t\nqR") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text, got in zip(texts, packing.encoded(texts, path)):
        ids = [i for w in text.encode().split() for i in plain.encode(w.decode(), add_special_tokens=False).ids]
        assert got == b"".join(i.to_bytes(4, "little") for i in [*ids, packing.END]), text
    packing.forget()
    packing.encoded(["(Straße, straße."], path)
    assert "straße".encode() in packing._state["memo"]
    packing.forget()


def test_words_are_remembered_by_the_next_task(spark, tmp_path):
    import public_tokenizers
    from pyspark import TaskContext

    def known(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([b"leftover" in packing._state.get("memo", {})])], names=["part", "known"])

    docs = spark.createDataFrame([(i, f"leftover word {i}") for i in range(64)], "doc_id long, text string").repartition(4)
    packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")).count()
    packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")).write.format("noop").mode("overwrite").save()
    assert any(r.known for r in spark.range(0, 64, 1, 4).mapInArrow(known, "part long, known boolean").collect())


def test_frequent_words_stay_when_the_memo_is_full(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "_MEMO_WORDS", 16)
    packing.forget()
    want = packing.encoded(["often met"], path)
    for i in range(40):
        got = packing.encoded([f"often rare{chr(97 + i % 26)}{'x' * (i % 7)}{chr(97 + i // 2)} met, {'long' * 9}{i}", "often met"], path)
        assert got[1:] == want
        assert {b"often", b"met"} <= set(packing._state["memo"]) and len(packing._state["memo"]) <= 16
    packing.forget()
