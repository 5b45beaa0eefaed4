"""Each portable operator against DuckDB on the same rows."""

import glob
import os

import duckdb
import pytest

from marketlens import registry
from marketlens.dialect import spell


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4)
    return str(v) if hasattr(v, "isoformat") else v


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 * max(1, abs(a))


@pytest.mark.parametrize("operator", registry.OPERATORS, ids=lambda o: o.name)
def test_same_rows(operator, spark, sf, other):
    df = operator.spark(spark, sf)
    if not operator.other():
        assert df.collect()
        return
    rel = other.execute(operator.other())
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = lambda r: [(x is None, str(x)) for x in r if not isinstance(x, float)] + [(x is None, 0) for x in r if isinstance(x, float)] + [x for x in r if isinstance(x, float)]
    ours = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=order)
    theirs = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(near(float(x) if isinstance(x, int) and isinstance(y, float) else x, y) for x, y in zip(a, b)), (a, b)


def test_flagship_has_rows(spark, sf):
    assert registry.flagship(spark, sf).count() == 200


def test_macros_nest_and_keep_quotes():
    assert spell("@str(@dbl(a))", 0) == "CAST(CAST(a AS DOUBLE) AS STRING)"
    assert spell("@rlike(url, '/(a|b)/')", 1) == "regexp_matches(url, '/(a|b)/')"
