"""The Hamming join against all pairs."""

import hashlib
import itertools

from marketlens import registry


def test_every_pair_within_the_threshold(spark, tmp_path):
    names = [f"name {i}" for i in range(700)] + ["name 1", "name 2"]
    spark.createDataFrame(list(enumerate([*names, None])), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    h = [int(hashlib.sha1(n.encode()).hexdigest()[:15], 16) for n in names]
    want = {(a, b, d) for a, b in itertools.combinations(range(len(h)), 2) if (d := (h[a] ^ h[b]).bit_count()) <= 16}
    got = [tuple(r[c] for c in ("a", "b", "distance")) for r in registry.QUERIES["j12_hamming_join"](spark, str(tmp_path)).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want, (len(got), len(want))
