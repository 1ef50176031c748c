"""Chunks claimed a few at a time, from tables that are read once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog import storage
from tidelog.connector import Connector
from tidelog.operators import jobs, scan, snapshot
from tidelog.operators.jobs import SnapshotJob
from tidelog.sources import config

T0 = datetime(2025, 1, 1)


def people(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"))


def test_a_table_is_read_once_however_small_the_waves(spark, tmp_path, monkeypatch):
    people(spark, 950).repartition(3).write.parquet(f"{tmp_path}/blocks")
    tables = {"offsets": people(spark, 73), "blocks": spark.read.parquet(f"{tmp_path}/blocks"), "ranges": people(spark, 41)}
    specs = [{"name": "offsets", "snapshotPartitionStrategy": "offset", "queryCondition": "id <> 5"}, {"name": "blocks", "queryCondition": "id % 20 = 0", "snapshotPartitionStrategy": "ctid_block"}, {"name": "ranges", "queryCondition": "id < 10 or id > 29"}]
    c = config.from_dict({"host": "h", "username": "u", "password": "p", "database": "d", "snapshot": {"enabled": True, "mode": "snapshot_only", "chunkSize": 10, "tables": specs}})
    sorts, numbered = [], scan.numbered
    monkeypatch.setattr(scan, "numbered", lambda df, *a: sorts.append("id" in df.columns and "status" not in df.columns) or numbered(df, *a))
    monkeypatch.setattr(snapshot, "GROUP", 2)
    seen, calls = [], []

    def handler(df, n):
        calls.append(n)
        if len(calls) == 6:
            raise ValueError("broken")
        seen.extend((r["table_name"], int(r["row_key"]), r["chunk_index"], r["is_last"]) for r in df.filter("op = 'r'").collect())

    connector = Connector(spark, c, tables=tables, keys={t: ["id"] for t in tables})
    job = SnapshotJob(spark, f"file://{tmp_path}/job")
    with pytest.raises(ValueError):
        connector.run_snapshot(1, handler, job, wave=2)
    connector.run_snapshot(1, handler, job, wave=2)  # goes on with the rows that were laid out
    assert job.header()["completed"] and sorts.count(True) == 1
    want = []
    for t, spec in zip(tables, connector._specs()[1]):
        want += [(t, r["id"], r["__chunk"], r["__last"]) for r in snapshot.chunk_rows(tables[t], spec, 10).collect()]
    assert sorted(seen) == sorted(want)
    by_chunk = {(r["table_name"], r["chunk_index"]): r["rows_processed"] for r in job.chunks().collect()}
    assert len(by_chunk) == 8 + 10 + 5 and by_chunk == {k: sum(w[0] == k[0] and w[2] == k[1] for w in want) for k in by_chunk}
    assert by_chunk["ranges", 1] == 0 and not [n for n in storage.children(spark, job.path) if n.startswith(("rows-", "R-"))]


def test_small_steps_write_no_table(spark, tmp_path, monkeypatch):
    job = SnapshotJob(spark, f"file://{tmp_path}/job")
    job.create(snapshot.plan_chunks(spark.range(200), snapshot.TableSpec("t", key=("id",)), 10, "slot", 7), "slot", 7, T0)
    tables = lambda: [n for n in storage.children(spark, job.path) if n.startswith("chunks-")]
    first = tables()
    a = job.claim("a", 3, T0, 30)
    assert [x["chunk_index"] for x in a] == [0, 1, 2] and a[0]["heartbeat_at"] == T0 and a[0]["status"] == "in_progress"
    job.complete("a", {a[0]["id"]: 10}, T0)
    assert tables() == first
    # what a worker left comes to the next in its place, also where the table doesn't know of it
    b = job.claim("b", 3, T0 + timedelta(seconds=31), 30)
    assert [x["chunk_index"] for x in b] == [1, 2, 3] and tables() == first
    job.complete("a", {a[1]["id"]: 9}, T0)  # too late
    rows = {r["chunk_index"]: r for r in job.chunks().collect()}
    assert rows[0]["completed_at"] == T0 and rows[0]["rows_processed"] == 10 and rows[1]["status"] == "in_progress" and rows[4]["status"] == "pending"
    monkeypatch.setattr(jobs, "SMALL", 5)
    c = job.claim("c", 4, T0, 30)
    assert [x["chunk_index"] for x in c] == [4, 5, 6, 7] and tables() != first and job.header()["changed"] == {}
    rows = {r["chunk_index"]: (r["status"], (r["claimed_by"] or "").split("/")[0]) for r in job.chunks().collect()}
    assert [rows[i] for i in range(9)] == [("completed", "a"), *[("in_progress", "b")] * 3, *[("in_progress", "c")] * 4, ("pending", "")]
    job.release("b")
    assert [x["chunk_index"] for x in job.claim("d", 9, T0, 30)] == [1, 2, 3, 8, 9, 10, 11, 12, 13]
