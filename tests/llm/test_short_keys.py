"""Keys that few sets share give pairs, once for each pair, and need no tile."""

import random

import numpy as np
import pytest

from marketlens.llm import jaccard


def _texts(n: int) -> list[tuple]:
    """Groups of four texts: two link, two share only a passage with them, which is most of a text."""
    r, out = random.Random(5), []
    for g in range(n):
        own = [f"g{g}-{k}" for k in range(200)]
        for m in range(4):
            w = list(own) if m < 2 else [*own[:120], *(f"m{g}-{m}-{k}" for k in range(80))]
            if m == 1:
                w[r.randrange(5, 195)] = "edited"
            out.append((4 * g + m, " ".join(w)))
    return out


def _links(rows: list[tuple]) -> list[tuple]:
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows if (w := t.split())]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return [(i, len(s), least[i]) for i, s in enumerate(sets)]


def _found(docs):
    packs = jaccard.packed_keys(docs, np.empty(0, np.uint64), 4).repartition("range").sortWithinPartitions("range")
    return packs.mapInArrow(jaccard._shared, "token long, sid long, lead long")


def test_a_passage_of_few_texts_is_a_pair_a_range_and_no_tile(spark):
    docs = spark.createDataFrame(_texts(20), "doc_id long, text string")
    rows = _found(docs).collect()
    assert not [r for r in rows if r.token is not None]
    assert 0 < len(rows) <= 20 * 6 * 4 and all(r.lead < r.sid for r in rows)


def test_longer_keys_are_whole_tiles(spark):
    r = random.Random(6)
    own = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(i, " ".join(own[:97] + [f"{r.random()}"])) for i in range(50)], "doc_id long, text string")
    tokens = [x.token for x in _found(docs).collect()]
    assert None not in tokens and max(map(tokens.count, set(tokens))) == 50


@pytest.mark.parametrize("short", [1, 3, 32])
def test_components_are_the_same_however_short_a_key_may_be(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "TRIES", 1)  # so that pairs are left after the first tries
    r = random.Random(7)
    rows = _texts(8)
    base = [f"c{k}" for k in range(60)]
    for i in range(len(rows), len(rows) + 30):  # a chain of edits at the limit
        base[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.joined(docs).collect()) == _links(rows)
