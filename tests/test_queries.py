"""Queries against their SQL, and the streaming forms against the batch ones."""

import glob
import os

import duckdb
import pytest

from tideglass.operators import control
from tideglass.plans import more_queries, registry
from tideglass.streaming import loops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    return float(x) if hasattr(x, "__float__") and not isinstance(x, (bool, str)) else x


@pytest.mark.parametrize("name", sorted(set(more_queries.ORACLE_SQL) - {"run_metrics", "benchmark_cagr", "fit_audits", "trust_context"}) + ["response_metrics"])
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(registry.ORACLE_SQL[name])
    order = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str) == want


@pytest.mark.parametrize("looped", [False, True])
def test_streamed_actions_equal_the_batch_form(spark, tmp_path, looped):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(user_id as string) as key", "event_id as seq", "value / 4 as gain").where("user_id < 20")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = loops.gain_actions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), looped=looped)
    name = f"actions_{looped}".lower()
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    want = control.gain_actions(rows, "key", "seq", looped=looped).select("key", "seq", "low_run", "action")
    got = spark.table(name).select("key", "seq", "low_run", "action")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
