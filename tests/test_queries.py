"""Every registered query of the library proper against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from lucerna.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, sql, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    text = registry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    r = sql.execute(text)
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(w[names.index(c)]) for c in cols) for w in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_every_query_on_empty_tables(spark, empty_sf):
    for name, query in registry.queries().items():
        assert query(spark, empty_sf).count() >= 0, name


def test_entry_without_training_package(spark, sf):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    flagship = e.entry(spark)
    assert flagship.columns == ["src_table", "ref_field", "period", "reason", "n_orphans"] and flagship.count() > 0
