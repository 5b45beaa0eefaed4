import json

import pytest
from pyspark.sql import functions as F

from marketlens.sources import exports, feeds, lake


def test_exports_with_headers_of_any_spelling(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Ad-ID,Page Name,BODY,odd\n1,Ann,"two\nlines",x\n,Bob,text,y\n')
    (tmp_path / "b.json").write_text(json.dumps([{"id": 7, "advertiser": "Cy", "url": "http://x"}]))
    (tmp_path / "c.xml").write_text("<rows><row><id>9</id><seller>Di</seller></row></rows>")
    got = exports.read_export(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.external_id, r.advertiser, r.ad_text) for r in got] == [("1", "Ann", "two\nlines"), (None, "Bob", "text")] and json.loads(got[0].raw)["odd"] == "x"
    assert exports.read_export(spark, str(tmp_path / "b.json")).first().landing_page == "http://x"
    assert exports.read_export(spark, str(tmp_path / "c.xml")).first().advertiser == "Di"
    good, bad = exports.validated(exports.read_export(spark, str(tmp_path / "a.csv")), allowed={"country": ("PH",)})
    assert good.count() == 1 and bad.first().reasons == ["missing external_id"]
    lake.quarantine(bad, str(tmp_path / "q"), "1")
    assert spark.read.json(str(tmp_path / "q")).first().reason == "missing external_id"


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,seller\n1,Ann\n")
    stream = exports.watch_folder(spark, str(folder), "id string, seller string")
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    (folder / "b.csv").write_text("id,seller\n2,Bob\n")
    run()
    assert sorted(r.external_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_upserts_receipts_and_snapshots(spark, tmp_path):
    path, receipts = str(tmp_path / "t"), str(tmp_path / "r")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 3, "newest")], "id long, at long, v string")
    assert lake.ingest_once(first, path, receipts, ["id"], ["at"]) and not lake.ingest_once(first.orderBy(F.desc("at")), path, receipts, ["id"], ["at"])
    assert lake.ingest_once(spark.createDataFrame([(1, 2, "late"), (3, 1, "c")], first.schema), path, receipts, ["id"], ["at"])
    assert {(r.id, r.v) for r in lake.current(spark, path).collect()} == {(1, "newest"), (2, "b"), (3, "c")}
    assert lake.current(spark, str(tmp_path / "none")) is None
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        lake.snapshot(first, str(tmp_path / "s"), day)
        lake.raw(first, str(tmp_path / "raw"), "x", day)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6 and spark.read.json(str(tmp_path / "raw")).count() == 6
    second = spark.createDataFrame([(4, 1, '{"token": "abc", "x": 1}'), (5, 1, None)], first.schema)
    lake.raw(second, str(tmp_path / "raw"), "x", "2024-01-02")  # a second batch of a day loses nothing, and holds no secret
    kept = spark.read.json(str(tmp_path / "raw")).collect()
    assert len(kept) == 8 and {r.v for r in kept if r.id > 3} == {'{"token": "***", "x": 1}', None}
    moved = lake.changes(first.where("at = 1"), spark.createDataFrame([(1, 9, "z"), (3, 1, "c")], first.schema), ["id"], ["v"])
    assert {(r.id, r.change) for r in moved.collect()} == {(1, "changed"), (2, "gone"), (3, "new")}


def test_throttle_depends_on_what_was_kept(spark):
    rows = spark.sql("SELECT k, TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, h) AS at, p FROM VALUES (1, 0, 5.0), (1, 10, 5.0), (1, 20, 5.0), (1, 24, 5.0), (1, 30, 6.0), (1, 40, 6.0), (2, 1, 1.0) AS t(k, h, p)")
    kept = lake.kept_snapshots(rows, ["k"], "at", ["p"], 24).select("k", F.hour("at"), F.dayofmonth("at")).collect()
    assert sorted(map(tuple, kept)) == [(1, 0, 1), (1, 0, 2), (1, 6, 2), (2, 1, 1)]


def test_feeds(spark, tmp_path):
    (tmp_path / "fx.xml").write_text("<Envelope><Cube><Cube time='2024-01-02'><Cube currency='USD' rate='1.1'/><Cube currency='JPY' rate='150'/></Cube></Cube></Envelope>")
    assert sorted((str(r.day), r.currency, r.rate) for r in feeds.rates(spark, str(tmp_path / "fx.xml")).collect()) == [("2024-01-02", "JPY", 150.0), ("2024-01-02", "USD", 1.1)]
    page = '<meta property="og:title" content="Lamp"><script type="application/ld+json">{"price": "19.5", "priceCurrency": "EUR", "ratingValue": 4.5}</script>'
    r = feeds.landing_facts(spark.createDataFrame([(page,), ("<title> x </title>",)], "html string")).collect()
    assert (r[0].title, r[0].price, r[0].currency, r[0].rating) == ("Lamp", 19.5, "EUR", 4.5) and (r[1].title, r[1].price) == ("x", None)
    posts = spark.createDataFrame([("see", "https://www.tiktok.com/@a.b/video/123"), ("https://youtu.be/abcdefghijk", ""), ("none", "")], "a string, b string")
    assert [p and tuple(p) for (p,) in posts.select(feeds.post_reference(["a", "b"])).collect()] == [("tiktok", "123", "b"), ("youtube", "abcdefghijk", "a"), None]
