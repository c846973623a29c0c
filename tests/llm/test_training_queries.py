"""The training-data queries on the smallest tables, against SQL where there is any."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

FOUND = {
    "p1_found": ["pair_id", "defect"], "p3_found": ["group_id", "member_table", "member_id"], "p5_found": ["record_id"], "p6_found": ["keep_id", "copy_id"],
    "p7_found": ["eval_table", "eval_id", "train_record_id"], "p10_found": ["doc_id_a", "doc_id_b"],
}


def names():
    from lucerna.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_runs(spark, sf, name):
    from lucerna.llm.queries import ORACLE, QUERIES

    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
    if name in ORACLE:
        c = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(ORACLE[name])
        cols = [d[0] for d in r.description]
        assert sorted(tuple(x[c] for c in cols) for x in rows) == sorted(r.fetchall())


def test_every_query_on_empty_tables(spark, empty_sf):
    from lucerna.llm.queries import QUERIES

    found = {name: query(spark, empty_sf).count() for name, query in QUERIES.items()}
    assert all(found[n] == 0 for n in FOUND)


def test_groups_never_divided(spark, sf):
    from lucerna.llm.queries import QUERIES

    a = {(r.member_table, r.member_id): r.split for r in QUERIES["p3_assignment"](spark, sf).collect()}
    groups = {}
    for r in QUERIES["p3_found"](spark, sf).collect():
        groups.setdefault(r.group_id, set()).add(a[r.member_table, r.member_id])
    assert groups and all(len(s) == 1 for s in groups.values())
