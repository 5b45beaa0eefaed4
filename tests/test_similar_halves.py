"""Scores that are exact halves in tenths, and the least score itself, as the SQL has them."""

import duckdb
import pytest

from marketlens import registry


@pytest.mark.parametrize("shared, union", [(7, 10), (14, 20), (29, 40), (141, 200)])
def test_scores_of_documents_as_duckdb(spark, tmp_path, shared, union):
    word = lambda i: "w" + chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(20, " ".join(map(word, range(union))), "s"), (21, " ".join(map(word, range(shared))), "s"), (22, "apart from all", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["v04_similar_ads"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.ORACLES["v04_similar_ads"]).fetchall()) and len(got) == 1
