"""Every registered query of the engine against its SQL, on the small tables."""

import os

import duckdb
import pytest

from codeweir import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = [t for t in ("part", "events", "documents", "conversations", "benchmark", "pages") if os.path.exists(f"{SF}/{t}.parquet")]


def plain(v):
    return None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rows = duck.execute(engine.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rows.fetchall())
    assert got == want


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_rescore_takes_all_findings_of_the_category(spark):
    cents = {r["ord"]: r["cents"] for r in engine.QUERIES["score_per_finding"](spark, SF).collect()}
    left = {r["ord"] for r in engine.QUERIES["dedupe_events"](spark, SF).collect() if r["category"] == "leftovers"}
    got = engine.QUERIES["category_rescore_all"](spark, SF).first()
    assert len(left) > len([x for x in left if x % 50 == 0])
    assert got["penalty_cents"] == sum(cents[x] for x in left)


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_components_take_all_nodes_that_nothing_reaches(spark, duck):
    keys = {k for (k,) in duck.execute("SELECT p_partkey FROM part").fetchall()}
    alive, new = set(), {1, 3}
    while new:
        alive |= new
        new = {2 * k for k in new} & keys
    got = {r["path"]: r["component"] for r in engine.QUERIES["unreached_components_part"](spark, SF).collect()}
    assert set(got) == keys - alive and any(k % 3 == 0 for k in got)
    # Chains double their key, and what an unreached key halves to is not reached either.
    first = lambda k: first(k // 2) if k and k % 2 == 0 and k // 2 in got else k
    assert got == {k: first(k) for k in got}
