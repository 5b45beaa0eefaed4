from marketlens.llm import packing


def test_pass_two_holds_no_words_of_pass_one():
    import public_tokenizers

    packing.forget()
    packing.encoded(["some words"], public_tokenizers.path("word_bpe_49k.json"))
    assert packing._state["memo"] and not list(packing._cut(iter([]), "<u2")) and not packing._state["memo"]
