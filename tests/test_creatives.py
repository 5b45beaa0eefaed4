"""Nearness by bands, leaders, families, replication and observations against plain versions."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import creatives as C
from marketlens.operators import hamming as H


def flipped(h, n, rnd, bits=64):
    for i in rnd.sample(range(bits), n):
        h ^= 1 << i
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def planted(rnd, groups=25, bits=64):
    out = []
    for _ in range(groups):
        base = rnd.getrandbits(bits)
        out += [base, base, *(flipped(base, rnd.randrange(1, 9), rnd, bits) for _ in range(4))]
    return [signed(h) for h in out]


@pytest.mark.parametrize(("most", "bands"), [(6, None), (6, 3), (5, 2), (0, None), (14, 5), (3, 4)])
def test_no_pair_is_lost(spark, most, bands):
    h = sorted(set(planted(random.Random(most))))
    want = {(a, b, d) for a, b in itertools.permutations(h, 2) if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= most}
    rows = spark.createDataFrame([(x,) for x in [*h, *h[:5]]] + [(None,)], "hash long")
    got = [tuple(r) for r in H.near_hashes(rows, rows, most, bands=bands).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (most == 0 or len(want) > 20)
    with pytest.raises(ValueError):
        H.near_hashes(rows, rows, 9, bands=2)
    assert "NestedLoop" not in H.near_hashes(rows, rows, 3)._jdf.queryExecution().toString()


def test_leaders_in_order(spark):
    rnd = random.Random(5)
    rows = list(enumerate(planted(rnd, 30) + [signed(flipped(0x0F0F, i % 7, rnd)) for i in range(40)]))
    leaders, want = [], {}
    for i, h in rows:
        far = [((h ^ x) & (1 << 64) - 1).bit_count() for x in leaders]
        if far and min(far) <= 6:
            want[i] = leaders[far.index(min(far))]
        else:
            leaders.append(h)
            want[i] = h
    df = spark.createDataFrame([*rows, (999, None)], "id long, hash long").repartition(4)
    assert {r.id: r.leader for r in H.led(df).collect()} == want


def creative(i, kind="video", sha=None, fp=None, phash=None):
    return (i, kind, sha, fp, phash)


def test_families(spark):
    a, b = 0x1234567812345678, 0x0F0F0F0F0F0F0F0F
    rows = [
        creative(1, sha="x"), creative(2, sha="x", phash=a), creative(3, phash=a ^ 1), creative(4, kind="image", phash=a),  # file, then cover; another type is apart
        creative(10, fp="f1", phash=b), creative(11, fp="f2", phash=b), creative(12, phash=b ^ 3), creative(13, phash=b ^ 7 ^ 8),  # one cover of two cuts: apart; unknown frames go to the nearest, least
        creative(20, phash=0), creative(21, phash=0), creative(22), creative(23, fp="f1"), creative(30, phash=signed(0xFF << 50)), creative(31, phash=signed(0xFF << 50)),
    ]
    got = {r.id: r.family for r in C.families(spark.createDataFrame(rows, "id long, type string, sha256 string, video_fp string, phash long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 10: 10, 11: 11, 12: 10, 13: 10, 20: 20, 21: 21, 22: 22, 23: 10, 30: 30, 31: 30}


def picture(product, ad, phash, active=True, sha=None, url=None, family=None):
    return (product, ad, active, phash, sha, url, family)


def test_replication(spark):
    a, b, c = 0x1111111111111111, 0x2222222222222222, 0x4444444444444444
    rows = [
        picture(1, 1, a), picture(1, 2, b),  # two pictures on two ads
        picture(2, 1, a), picture(2, 1, b),  # both on one ad
        picture(3, 1, a), picture(3, 2, a ^ 0b111), picture(3, 3, a),  # one picture, recoded
        picture(4, 1, a, url="https://c.example/x.jpg?s=1"), picture(4, 2, b, url="https://c.example/x.jpg?s=2"),  # one address
        picture(5, 1, a, family=9), picture(5, 2, b, family=9, sha="q"), picture(5, 3, c, sha="q"),  # over two links
        picture(6, 1, a), picture(6, 2, b, active=False), picture(6, 3, 0), picture(6, 4, None),  # stopped, plain and unknown ones don't count
    ]
    df = spark.createDataFrame(rows, "product_id long, ad_id long, active boolean, phash long, sha256 string, source_url string, family long")
    got = {r.product_id: (r.distinct_creatives, r.visual_evidence, r.n_ads, r.confirmed) for r in C.replication(df).collect()}
    assert got == {1: (2, 2, 2, True), 2: (2, 2, 1, False), 3: (1, 3, 3, False), 4: (1, 2, 2, False), 5: (1, 3, 3, False), 6: (1, 1, 1, False)}


def test_observations_of_reuse(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = spark.createDataFrame([(1, 10, 7, None, None, 5), (2, 10, 7, None, "f", 5), (3, 11, 7, "v", None, 5), (4, 12, 7, None, None, None), (5, 13, None, "v", "f", 1)], "id long, ad_id long, family long, video_fp_v2 string, video_fp string, phash long")
    seen = spark.createDataFrame([(10, day(1), day(2)), (10, day(0), day(3)), (11, day(5), day(5))], "ad_id long, first_seen timestamp, last_seen timestamp")
    first = C.observations(rows, seen)
    table = lambda d: {(r.family, r.ad_id): (r.creative_id, r.kind, r.first_seen, r.last_seen) for r in d.collect()}
    assert table(first) == {(7, 10): (2, "video_fp_v1", day(0), day(3)), (7, 11): (3, "video_fp_v2", day(5), day(5)), (7, 12): (4, "same_file", None, None)}
    assert table(C.observations(rows, seen, first)) == table(first)
    later = spark.createDataFrame([(10, day(9), day(9))], seen.schema)
    again = table(C.observations(rows.where("ad_id = 10"), later, first))
    assert again[7, 10] == (2, "video_fp_v1", day(0), day(9)) and again[7, 11] == table(first)[7, 11]
    ads = spark.createDataFrame([(10, "p1", 1, 4), (11, "p1", 2, None), (12, "p2", None, 2)], "ad_id long, page_id string, store_id long, variants int")
    r = C.reuse(first, ads, F.lit(day(6))).first()
    assert (r.ad_count, r.collation_variants, r.distinct_pages, r.distinct_shops, r.new_pages, r.earliest) == (3, 7, 2, 2, 1, day(0))
