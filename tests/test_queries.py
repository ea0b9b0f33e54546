"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from voxloom.oracle import SQL
from voxloom.queries import QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "-"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    names, columns = [d[0] for d in rel.description], sorted(df.columns)
    assert sorted(names) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = flagship(spark, SF).collect()
    assert rows and all(r["content"].startswith("1\n00:00:00,000 --> ") for r in rows)


def test_no_cross_join_in_plans(spark):
    for name, f in QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_sums_near_a_half_are_those_of_the_sql_however_the_table_is_split(spark, tmp_path):
    """Hundredths whose sum is a half: its last bits, and so the rounding, depend on the order of addition."""
    import datetime
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, rows = random.Random(7), []
    for user in range(300):
        values = [rng.randrange(50_000) for _ in range(59)]
        values.append((50 - sum(values)) % 100)
        rows += [(user, v / 100) for v in values]
    users, values = zip(*rows)
    ids = list(range(len(rows)))
    everything = pa.table({"event_id": ids, "ts": [datetime.datetime(2024, 1, 1)] * len(ids), "user_id": users, "event_type": ["view"] * len(ids), "value": values})
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(4):  # every user's rows are in four files, in runs
        pq.write_table(everything.filter(pa.array([i % 60 // 15 == k for i in ids])), folder / f"part-{k}.parquet")
    pq.write_table(everything, tmp_path / "whole.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/whole.parquet'")
    want = {(r[0], r[1]) for r in con.sql(SQL["hopping_windows_full_tail"]).fetchall()}
    got = {(r["file_id"], r["n_samples"]) for r in QUERIES["hopping_windows_full_tail"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 300
