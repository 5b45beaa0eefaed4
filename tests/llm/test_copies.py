"""Groups of exact copies must not decide about other documents."""

import random

from marketlens.llm import quality


def test_copies_of_one_text_do_not_narrow_a_language(spark):
    rnd = random.Random(5)
    names = ["house", "river", "stone", "green", "walks", "under", "light", "seven", "maybe", "often", "quiet", "table", "north", "paper"]

    def clean(odd):  # texts differ in how many words are uncommon
        return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) if rnd.random() < odd else rnd.choice(names) for _ in range(120))

    texts = [(t, lang) for lang, k in (("en", 160), ("es", 40)) for t in (clean(0.4 * j / k) for j in range(k))]
    copies = [(texts[180][0], "es")] * 100  # a third of all rows, most of the small language
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*texts, *copies])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert len([i for i in range(160, 200) if i in kept]) >= 38 and len([i for i in range(160) if i in kept]) >= 152
