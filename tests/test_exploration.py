"""Exploration slots against the list built one place after another."""

import hashlib

from marketlens import registry


def test_one_slot_in_five_at_every_size(spark, tmp_path):
    for n in (3, 8, 700):
        folder = tmp_path / str(n)
        rows = [(i, float(i * 37 % 101)) for i in range(1, n + 1)]
        spark.createDataFrame(rows, "p_partkey long, p_retailprice double").write.parquet(str(folder / "part.parquet"))
        explore = sorted((i for i, _ in rows), key=lambda i: hashlib.sha1(f"u1:2024-01-31:{i}".encode()).hexdigest())[: round(0.2 * n)]
        main, want = [i for i, p in sorted(rows, key=lambda r: (-r[1], r[0])) if i not in explore], []
        while main or explore:
            picked = bool(explore) and ((len(want) + 1) % 5 == 0 or not main)
            want.append(((explore if picked else main).pop(0), len(want) + 1, picked))
        got = registry.QUERIES["w11_exploration_slots"](spark, str(folder)).collect()
        assert sorted((r.id, r.place, r.explored) for r in got) == sorted(want), n
