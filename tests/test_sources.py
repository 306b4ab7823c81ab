"""Sources that fail, and checkpoints under two writers, held against plain Python."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideglass.plans import source_queries
from tideglass.sources import commits, price_files
from tideglass.sources.tables import daily_panel, table

SF = "/root/testdata/sf0.001"


def test_panel_of_files_lacks_only_what_is_broken(spark):
    panel = {(str(r.dt), r.asset): r.price for r in daily_panel(spark, SF, by_status=True).collect()}
    names = sorted({a for _, a in panel})
    got = source_queries.QUERIES["failing_sources"](spark, SF)
    assert got.columns == ["dt", *names, "gone"]
    good = [n for n in names if n != names[1]]
    want = {d: tuple(panel.get((d, n)) if n in good else None for n in names) for d in {d for d, a in panel if a in good}}
    assert {str(r.dt): tuple(r[n] for n in names) for r in got.collect()} == want and {r.gone for r in got.collect()} == {None}


def test_a_source_retries_and_waits(tmp_path, monkeypatch):
    slept, path = [], tmp_path / "a.csv"
    monkeypatch.setattr(price_files.time, "sleep", lambda s: (slept.append(s), path.write_text("date,close\n2024-01-02,5\n2024-01-03,x\nnever,7\n,8\n") if len(slept) == 2 else None))
    reader = price_files.PriceReader({"assets": json.dumps([["A", str(path)]])})
    part = reader.partitions()[0]
    assert list(reader.read(part)) == [(date(2024, 1, 2), "A", 5.0), (date(2024, 1, 3), "A", None)] and slept == [0.5, 1.0]
    for text in ("", "date,close\n", "date,open\n2024-01-01,3\n"):
        path.write_text(text)
        slept[:] = [0, 0]
        assert list(reader.read(part)) == [] and slept[2:] == [0.5, 1.0, 1.5]


def test_all_sources_absent(spark, tmp_path):
    found = price_files.load(spark, [("A", f"{tmp_path}/none")], wait=0)
    assert found.count() == 0 and price_files.wide(found, ["A", "B"]).columns == ["dt", "A", "B"]


def test_restored_tasks(spark):
    events = sorted(((r.ts, r.event_id, r.user_id, r.value, r.event_type) for r in table(spark, SF, "events").collect()), key=lambda e: e[:2])
    by = {}
    for e in events:
        by.setdefault(e[2], []).append(e)
    log = [e[1] for e in events[-100:]]
    want = {}
    for u, own in by.items():
        own = sorted(own[-3:], key=lambda e: e[1])
        status = {"error": "failed", "purchase": "completed", "view": "pending"}.get(own[-1][4], "running")
        if u % 5:
            want[u] = (status, u % 4, own[-1][3], [e[3] for e in own], len(own))
        want[u + 1_000_000] = ("pending", 9, -1.0, [-1.0], -1)
    rows = source_queries.QUERIES["checkpoint_restore"](spark, SF).collect()
    assert {r.id: (r.status, r.current_strategy_index, r.current_completion, json.loads(r.completion_history), r.budget_used) for r in rows} == want
    assert {(r.version, r.current_index, r.quota_total_used, r.quota_remaining, r.quota_next_refresh, r.n_log, r.first_log, r.last_log) for r in rows} == {(2, 3, len(events), max(0, 1000 - len(events)), 18000.0, 100, min(log), max(log))}


def test_two_writers_and_a_torn_manifest(spark, tmp_path):
    path, one = f"{tmp_path}/c", spark.range(3)
    assert commits.restore(spark, path) is None and commits.latest(spark, path) == 0
    assert [commits.commit(spark, path, {"t": one.withColumn("v", F.lit(i))}, {"i": i}, max_versions=3) for i in (1, 2)] == [1, 2]
    base = commits.latest(spark, path)
    assert commits.commit(spark, path, {"t": one}, {"i": 3}, base=base) == 3
    before = sorted(os.listdir(f"{path}/data"))
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"t": one}, {"i": 4}, base=base)
    assert sorted(os.listdir(f"{path}/data")) == before and commits.restore(spark, path)[1] == {"i": 3}
    # both saw the same versions, so only the rename can tell
    real = commits.versions
    try:
        commits.versions = lambda *_: [base]
        with pytest.raises(commits.Conflict):
            commits.commit(spark, path, {"t": one}, {"i": 5}, base=base)
    finally:
        commits.versions = real
    assert sorted(os.listdir(f"{path}/data")) == before and not [f for f in os.listdir(f"{path}/manifests") if f.startswith(".") and not f.endswith(".crc")]
    with open(f"{path}/manifests/v4.json", "w") as f:
        f.write('{"version": 4, "fac')
    version, facts, tables = commits.restore(spark, path)
    assert (version, facts, tables["t"].count()) == (3, {"i": 3}, 3)
    assert commits.commit(spark, path, {"t": one}, {"i": 6}, max_versions=3) == 5
    assert commits.versions(spark, path) == [3, 4, 5] and commits.restore(spark, path, 1) is None and commits.restore(spark, path, 3)[1] == {"i": 3}
