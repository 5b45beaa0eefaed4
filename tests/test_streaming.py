from marketlens import streaming


def test_dedup_stream_equals_batch(spark, sf, tmp_path):
    out = streaming.drained(streaming.deduplicated(streaming.event_stream(spark, sf)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_micro_batches_are_idempotent(spark, tmp_path):
    put = streaming.idempotent(str(tmp_path / "t"))
    for _ in range(2):
        put(spark.range(5), 0)
    put(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8
