"""Snapshot jobs: claims, failures, restarts, and the connector on top of them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.connector import Connector, is_transient, retry
from tidelog.operators import snapshot
from tidelog.operators.jobs import SnapshotJob
from tidelog.sources import config

T0 = datetime(2025, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def planned(spark, n=100, size=20):
    return snapshot.plan_chunks(spark.range(n), snapshot.TableSpec("t", key=("id",)), size, "slot", 7)


def test_claims_heartbeats_and_takeover(spark, tmp_path):
    job = SnapshotJob(spark, f"file://{tmp_path}/job")
    assert job.header() is None and job.create(planned(spark), "slot", 7, T0) and not job.create(planned(spark), "slot", 8, T0)
    a = job.claim("a", 2, at(1), 30)
    b = job.claim("b", 2, at(2), 30)
    assert [c["chunk_index"] for c in (*a, *b)] == [0, 1, 2, 3]
    job.heartbeat("a", at(25))
    job.complete("a", spark.createDataFrame([(a[0]["id"], 20)], "id int, rows int"), at(26))
    # b wasn't heard of for over 30 seconds; a was
    c = job.claim("c", 9, at(40), 30)
    assert [x["chunk_index"] for x in c] == [2, 3, 4]
    job.complete("b", spark.createDataFrame([(b[0]["id"], 20)], "id int, rows int"), at(41))  # too late: it is c's now
    job.release("a")
    state = {r["chunk_index"]: (r["status"], r["claimed_by"] and r["claimed_by"].split("/")[0], r["rows_processed"]) for r in job.chunks().collect()}
    assert state == {0: ("completed", "a", 20), 1: ("pending", None, None), 2: ("in_progress", "c", None), 3: ("in_progress", "c", None), 4: ("in_progress", "c", None)}
    assert not job.finish()
    d = job.claim("c", 9, at(42), 30)
    job.complete("c", spark.createDataFrame([(x["id"], 20) for x in (*c, *d)], "id int, rows int"), at(50))
    assert job.finish() and job.header()["completed"] and job.claim("a", 9, at(99), 30) == []
    job.drop()
    assert job.header() is None


def test_old_metadata_is_adopted(spark, tmp_path):
    job = SnapshotJob(spark, f"file://{tmp_path}/job")
    old = planned(spark).drop("range_start", "range_end", "block_start", "block_end", "is_last_chunk", "partition_strategy")
    assert job.adopt(old, "slot", 7, T0) and job.chunks().filter("partition_strategy is null").count() == 5


def base(mode="snapshot_only", **more):
    tables = [{"name": "people", "columns": ["id", "name"]}, {"name": "keyless"}, {"name": "people", "schema": "other", "snapshotPartitionStrategy": "offset", "queryCondition": "id > 3"}]
    return config.from_dict({"host": "h", "username": "u", "password": "p", "database": "d", "snapshot": {"enabled": True, "mode": mode, "chunkSize": 10, "tables": tables, **more}})


def people(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("string").alias("note"))


@pytest.fixture()
def tables(spark, tmp_path):
    people(spark, 45).drop("id").write.parquet(f"{tmp_path}/keyless")
    return {"public.people": people(spark, 25), "other.people": people(spark, 14), "keyless": spark.read.parquet(f"{tmp_path}/keyless")}


def test_a_job_that_failed_goes_on_where_it_was(spark, tmp_path, tables):
    keys = {"public.people": ["id"], "other.people": ["id"]}
    seen, calls = [], []

    def handler(df, n):
        calls.append(n)
        if len(calls) == 4:
            raise ValueError("broken")  # not of the kind that passes
        seen.extend((r["event_type"], r["table_schema"], r["table_name"], r["row_key"], (r["row_data"] or {}).get("name"), r["chunk_index"], r["is_last"]) for r in df.collect())

    path = f"file://{tmp_path}/job"
    with pytest.raises(ValueError):
        Connector(spark, base(), tables=tables, keys=keys).run_snapshot(9, handler, SnapshotJob(spark, path), wave=2)
    job = SnapshotJob(spark, path)
    assert not job.header()["completed"] and 0 < job.chunks().filter("status = 'completed'").count() < 10
    assert job.chunks().filter("status = 'in_progress'").count() == 0
    again = Connector(spark, base(), tables=tables, keys=keys)
    assert again.start(handler, snapshot_lsn=11, job_path=path) is None
    assert job.header()["completed"] and job.header()["snapshot_lsn"] == 9
    assert [x[0] for x in seen if x[0] != "DATA"] == ["BEGIN", "END"] and seen[0][0] == "BEGIN" and seen[-1][0] == "END"
    rows = [x[1:] for x in seen if x[0] == "DATA"]
    assert len(rows) == 25 + 45 + 10 and len({(s, t, n) for s, t, _, n, _, _ in rows}) == len(rows)
    assert {(k, c) for s, t, k, _, c, _ in rows if (s, t) == ("public", "people")} == {(str(i), i // 10) for i in range(25)}
    assert {(k, c) for s, t, k, _, c, _ in rows if s == "other"} == {(str(i), 0) for i in range(4, 14)}
    assert {k for s, t, k, _, _, _ in rows if t == "keyless"} == {None}
    # the last row of a chunk that isn't full
    assert [k for s, t, k, _, _, last in rows if last and (s, t) == ("public", "people")] == ["24"]
    # a completed job is not taken again, unless that is asked for
    n = len(seen)
    assert again.start(handler, job_path=path) is None and len(seen) == n
    Connector(spark, base(resnapshot=True), tables=tables, keys=keys).start(handler, snapshot_lsn=20, job_path=path)
    assert len(seen) == 2 * n and SnapshotJob(spark, path).header()["snapshot_lsn"] == 20


def test_ranges_of_the_key_reach_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rows = snapshot.chunk_rows(df, snapshot.TableSpec("t", key=("id",)), 10, only=[3, 4, 5, 90])
    assert sorted(r["id"] for r in rows.collect()) == [*range(30, 60), *range(900, 910)]
    assert "GreaterThanOrEqual(id,30)" in rows._jdf.queryExecution().executedPlan().toString()


def test_every_strategy_reads_each_row_once(spark, tmp_path):
    people(spark, 333).repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for strategy in (snapshot.RANGE, snapshot.BLOCK, snapshot.OFFSET):
        spec = snapshot.TableSpec("t", key=("id",), strategy=strategy)
        chunks = snapshot.plan_chunks(df, spec, 50, "s", 1, rows_per_block=10).collect()
        got = [r["id"] for c in chunks for r in snapshot.read_chunk(df, spec, c.asDict(), 10).collect()]
        assert sorted(got) == list(range(333)), strategy
        whole = snapshot.chunk_rows(df, spec, 50, 10)
        assert whole.count() == 333 and whole.select("__chunk").distinct().count() == len(chunks) == 7 and whole.filter("__last").count() == 1
    odd = {"partition_strategy": "somehow", "chunk_start": 300, "chunk_size": 50}
    assert sorted(r["id"] for r in snapshot.read_chunk(df, snapshot.TableSpec("t", key=("id",)), odd).collect()) == list(range(300, 333))


def test_which_failures_pass():
    class Coded(Exception):
        def __init__(self, state):
            self.sqlstate = state

    assert all(is_transient(e) for e in (ConnectionError(), TimeoutError(), OSError("x"), RuntimeError("Connection refused by peer"), Coded("08006"), Coded("40001"), Coded("57P01")))
    assert not any(is_transient(e) for e in (ValueError("timeout"), RuntimeError("no such column"), Coded("42703"), Coded("22023")))
    calls = []

    def work():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        retry(work, sleep=lambda s: calls.append(s))
    assert calls == [1]
