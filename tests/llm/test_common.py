"""Batches of written tables: the session's setting comes back, smaller settings stay, failures too."""

import pyarrow as pa
import pytest

from marketlens.llm.common import ARROW_ROWS, small_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(("own", "inside"), [("10000", ARROW_ROWS), ("100", 100), ("0", ARROW_ROWS), ("-1", ARROW_ROWS)])
def test_setting_comes_back(spark, own, inside):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, own)
    try:
        with small_batches(spark):
            assert int(spark.conf.get(KEY)) == inside
        assert spark.conf.get(KEY) == own
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            1 / 0
        assert spark.conf.get(KEY) == own
    finally:
        spark.conf.set(KEY, before)


def test_batches_are_bounded(spark):
    with small_batches(spark):
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda rows: (pa.record_batch([pa.array([b.num_rows])], names=["id"]) for b in rows), "id long").collect()
    assert sum(r.id for r in sizes) == 5000 and max(r.id for r in sizes) == ARROW_ROWS
