import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from tidelog.operators import apply, monitor, publication, scan, snapshot
from tidelog.sources import config


def people(spark, n, key="id"):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias(key), F.concat(F.lit("User_"), F.col("id")).alias("name"))


def test_range_chunks(spark):
    chunks = snapshot.plan_chunks(people(spark, 100), snapshot.TableSpec("people", key=("id",)), 25, "slot", 7).orderBy("chunk_index").collect()
    assert [(c["chunk_index"], c["chunk_start"], c["range_start"], c["range_end"]) for c in chunks] == [(0, 0, 1, 25), (1, 25, 26, 50), (2, 50, 51, 75), (3, 75, 76, 100)]
    assert [c["is_last_chunk"] for c in chunks] == [False, False, False, True] and {c["status"] for c in chunks} == {"pending"}
    for c in chunks:
        assert snapshot.read_chunk(people(spark, 100), snapshot.TableSpec("people", key=("id",)), c.asDict()).count() == 25


def test_empty_table_has_one_open_chunk(spark):
    spec = snapshot.TableSpec("people", key=("id",))
    chunks = snapshot.plan_chunks(people(spark, 0), spec, 100, "slot", 7).collect()
    assert len(chunks) == 1 and chunks[0]["range_start"] is None
    assert snapshot.read_chunk(people(spark, 3), spec, chunks[0].asDict()).count() == 3
    for strategy in (snapshot.BLOCK, snapshot.OFFSET):
        assert snapshot.plan_chunks(people(spark, 0), snapshot.TableSpec("p", key=("id",), strategy=strategy), 100, "s", 7).count() == 1


def test_strategies_and_counts(spark):
    whole = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("k", T.StringType())])
    assert snapshot.choose_strategy(whole, ["id"]) == snapshot.RANGE and snapshot.choose_strategy(whole, ["k"]) == snapshot.BLOCK
    assert snapshot.choose_strategy(whole, ["id"], "auto") == snapshot.RANGE and snapshot.choose_strategy(whole, ["id"], "offset") == snapshot.OFFSET
    assert snapshot.choose_strategy(whole, []) == snapshot.BLOCK
    with pytest.raises(ValueError):
        snapshot.choose_strategy(whole, ["id"], "nothing")
    # three tables of 60, 40 and 15 rows by 25: 3, 2 and 1 chunks
    assert [snapshot.plan_chunks(people(spark, n), snapshot.TableSpec("t", key=("id",)), 25, "s", 1).count() for n in (60, 40, 15)] == [3, 2, 1]
    assert snapshot.plan_chunks(people(spark, 75), snapshot.TableSpec("t"), 25, "s", 1).count() == 1  # no key: blocks of 100 rows
    blocks = snapshot.plan_chunks(people(spark, 200).select("name"), snapshot.TableSpec("t", key=("name",)), 50, "s", 1, rows_per_block=10).orderBy("chunk_index").collect()
    assert [(b["block_start"], b["block_end"]) for b in blocks] == [(0, 5), (5, 10), (10, 15), (15, None)]
    spec = snapshot.TableSpec("t", key=("id",), strategy=snapshot.OFFSET, condition="id > 50")
    chunks = snapshot.plan_chunks(people(spark, 100), spec, 20, "s", 1).orderBy("chunk_index").collect()
    assert len(chunks) == 3 and sorted(r["id"] for c in chunks for r in snapshot.read_chunk(people(spark, 100), spec, c.asDict()).collect()) == list(range(51, 101))


def test_events_markers_and_job_state(spark):
    specs = [snapshot.TableSpec("a", key=("id",), columns=("id",)), snapshot.TableSpec("b", key=("id",), condition="id = 2")]
    events = snapshot.take_snapshot({"a": people(spark, 3), "b": people(spark, 3)}, specs, "slot", 9, general_condition="id <> 3").collect()
    assert [e["event_type"] for e in events].count("DATA") == 3 and events[0]["event_type"] == "BEGIN" and events[-1]["event_type"] == "END"
    assert {tuple(e["row_data"].items()) for e in events if e["table_name"] == "a"} == {(("id", "1"),), (("id", "2"),)}
    chunks = snapshot.plan_chunks(people(spark, 100), snapshot.TableSpec("people", key=("id",)), 25, "slot", 7)
    done = chunks.withColumn("status", F.when(F.col("chunk_index") < 3, "completed").otherwise("in_progress")).withColumn("heartbeat_at", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    assert snapshot.job_of(done).first().asDict()["completed"] is False and snapshot.job_of(done.withColumn("status", F.lit("completed"))).first()["completed"]
    late, soon = (F.lit(f"2025-01-01 00:00:{s}").cast("timestamp_ntz") for s in ("31", "29"))
    free = lambda now: snapshot.next_claims(done, snapshot.claimable(F.col("status"), F.col("heartbeat_at"), now, 30), "slot_name", "chunk_index").collect()
    assert [tuple(r) for r in free(late)] == [("slot", 3)] and free(soon) == []
    old = chunks.drop("range_start", "range_end", "block_start", "block_end", "is_last_chunk", "partition_strategy")
    once = snapshot.migrate_chunks(old)
    assert once.columns == list(snapshot.CHUNK_COLUMNS) and snapshot.migrate_chunks(once).dtypes == once.dtypes
    assert snapshot.without_slot(chunks, "slot").count() == 0 and snapshot.without_slot(chunks, "other").count() == 4
    assert [snapshot.should_snapshot(*a) for a in (("never", True, None), ("initial", True, None), ("initial", True, True), ("snapshot_only", True, True), ("initial", False, None))] == [False, True, False, False, False]
    assert snapshot.should_snapshot("initial", True, True, resnapshot=True)
    last = snapshot.mark_last(snapshot.with_chunk(people(spark, 60), "id", F.lit(1), 25), "chunk_index", "id", 25).filter("is_last").collect()
    assert [r["id"] for r in last] == [60]


def test_shared_folder(spark):
    from tidelog import storage

    path = storage.fresh_dir(spark, "test")
    assert path.startswith(storage.shared_root(spark)) and not storage.exists(spark, path)
    assert storage.read_text(spark, f"{path}/x") is None and storage.children(spark, path) == []
    storage.swap_text(spark, f"{path}/x", "one")
    storage.swap_text(spark, f"{path}/x", "twö")
    assert storage.read_text(spark, f"{path}/x") == "twö" and [c for c in storage.children(spark, path) if not c.endswith(".crc")] == ["x"]
    assert storage.is_file(spark, f"{path}/x") and not storage.is_file(spark, path)
    made = storage.materialize(spark.range(3), "test")
    assert made.count() == 3
    storage.delete(spark, path)
    assert not storage.exists(spark, path)


def test_conditions():
    publication.check_condition(None), publication.check_condition("  "), publication.check_condition("updated_at > '2024'")
    for bad in ("a; b", "a -- b", "a /* b", "$$x$$", "x = 'drop'", "DO", "a or Delete"):
        with pytest.raises(publication.UnsafeCondition):
            publication.check_condition(bad)
    assert publication.both_conditions("a = 1", "b OR c") == "(a = 1) AND (b OR c)" and publication.both_conditions(None, " ") is None
    assert publication.condition_for("orders", {"public.orders": "x"}, "y") == "x" and publication.condition_for("ops.orders", {"orders": "x"}, "y") == "y"


def test_filters_of_changes(spark):
    rows = spark.createDataFrame([("I", "p1", {"a": "1", "b": None}), ("T", "hb", None), ("U", "hb", {"a": "2"}), (None, None, None)], "op string, table_name string, after map<string,string>")
    kept = rows.select("op", publication.keep_columns(F.col("after"), ["b"]).alias("after"))
    assert kept.first()["after"] == {"b": None}
    assert [r["op"] for r in publication.without_heartbeats(rows, F.col("table_name") == "hb").collect()] == ["I", "T", None]
    roots = spark.createDataFrame([("p1", "p"), ("p1", "p")], "child string, root string")
    assert sorted(str(r["table_name"]) for r in publication.to_root(rows, roots, "table_name").collect()) == ["None", "hb", "hb", "p"]
    a = spark.createDataFrame([("s", "t", None, ["x"]), ("s", "u", "FULL", None)], "table_schema string, table_name string, replica_identity string, column_list array<string>")
    assert publication.identity_differences(a, a).count() == 0 and publication.identity_differences(a, a.filter("table_name = 't'")).first()["table_name"] == "u"
    quoted = spark.createDataFrame([("s", 'a"b', "USING INDEX", "i", "p", ["x"], True), ("s", "c", "FULL", None, "p", None, None)], "table_schema string, table_name string, replica_identity string, replica_identity_index string, pub_name string, column_list array<string>, is_partitioned boolean")
    assert sorted(r["statement"] for r in publication.alter_statements(quoted).collect()) == ['ALTER TABLE "s"."a""b" REPLICA IDENTITY USING INDEX "i"', 'ALTER TABLE "s"."c" REPLICA IDENTITY FULL']
    assert publication.create_statements(quoted, ["INSERT"]).first()["statement"] == """CREATE PUBLICATION "p" FOR TABLE "s"."a""b" ("x"), "s"."c" WITH (publish = 'insert', publish_via_partition_root = true)"""


def test_running_values_in_blocks(spark):
    r = random.Random(2)
    rows = [(r.choice(("a", "b", None)), i * 7 + r.randint(0, 6), r.choice((None, r.randint(0, 99)))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at bigint, v int")
    for block in (10, 97, 1 << 20):
        known = {(x["k"], x["at"]): (x["last"], x["top"]) for x in scan.running_max(scan.last_known(df, ["k"], "at", {"last": F.col("v")}, block=block), ["k"], "at", F.col("v"), "top", block=block).collect()}
        for k in ("a", "b", None):
            last = top = None
            for _, at, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
                top = v if top is None else top if v is None else max(top, v)
                assert known[k, at] == (last, top)
                last = v if v is not None else last
        numbers = {(x["k"], x["at"]): x["n"] for x in scan.row_numbers(df, ["k"], "at", [], "n", block=block).collect()}
        for k in ("a", "b", None):
            assert [numbers[k, x[1]] for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1])] == list(range(1, sum(x[0] == k for x in rows) + 1))


def test_keyed_table_is_safe_to_repeat(spark, tmp_path):
    t = apply.CurrentTable(spark, f"file://{tmp_path}/t", ["id"], "seq")
    df = lambda rows: spark.createDataFrame(rows, "id string, seq bigint, op string, v string")
    assert t.rows() is None
    t.apply(df([("a", 1, "I", "x"), ("b", 2, "I", "y"), ("a", 3, "U", None)]), 0)
    t.apply(df([("a", 1, "I", "x"), ("b", 5, "D", None)]), 1)
    t.apply(df([("a", 99, "D", None)]), 1)  # the batch came already
    t.apply(df([("b", 4, "U", "late")]), 2)  # older than the delete
    assert [tuple(r) for r in t.rows().collect()] == [("a", 3, None)]
    key, value = apply.keyed_messages(df([("a", 1, "I", "x")]), ["id"]).first()
    assert key == "a" and json.loads(value) == {"id": "a", "seq": 1, "v": "x", "operation": "I"}
    both = apply.snapshot_then_changes(spark.createDataFrame([("a", "s"), ("c", "s")], "id string, v string"), df([("a", 5, "U", "n"), ("c", 6, "D", None)]), ["id"], "seq")
    assert [(r["id"], r["v"]) for r in both.collect()] == [("a", "n")]


def test_metrics(spark):
    chunks = snapshot.plan_chunks(people(spark, 100), snapshot.TableSpec("people", key=("id",)), 25, "slot", 7).withColumns({"status": F.lit("completed"), "rows_processed": F.lit(25).cast("bigint")})
    got = {r["name"]: r["value"] for r in monitor.snapshot_metrics(chunks, "h").collect()}
    assert got["cdc_snapshot_total_rows"] == 100 and got["cdc_snapshot_completed_tables"] == 1 and got["cdc_snapshot_active_workers"] == 0
    info = spark.createDataFrame([("s", True, "0/10", "0/20", "0/30", "reserved", "2025-01-01 00:00:00", 1), ("s", False, "0/40", "1/0", "0/50", "lost", "2025-01-02 00:00:00", 2)], "slot_name string, active boolean, restart_lsn string, confirmed_flush_lsn string, current_lsn string, wal_status string, polled_at string, poll_id bigint")
    got = {r["name"].rsplit("slot_", 1)[1]: r["value"] for r in monitor.slot_metrics(info, "h").collect()}
    lines = [r["line"] for r in monitor.exposition(spark.createDataFrame([("m", 'a"b', "h", 1.5), ("m", None, "h", None)], "name string, slot_name string, host string, value double")).collect()]
    assert lines == ['m{slot_name="a\\"b",host="h"} 1.5']
    assert got["lag"] == 0 and got["retained_wal_size"] == 0x10 and got["is_active"] == 0


def test_endpoint(spark):
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from tidelog.streaming.endpoint import Endpoint

    e = Endpoint(lambda: spark.createDataFrame([("m", "s", "h", 1.0)], "name string, slot_name string, host string, value double"), lambda: spark.createDataFrame([("s", 5)], "slot_name string, lag int"), port=0)
    get = lambda path: urlopen(f"http://127.0.0.1:{e.port}{path}").read().decode()
    assert get("/status") == "OK" and get("/metrics") == 'm{slot_name="s",host="h"} 1.0\n' and json.loads(get("/slot")) == [{"slot_name": "s", "lag": 5}]
    with pytest.raises(HTTPError):
        get("/other")
    e.close()


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = apply.CurrentTable(spark, f"file://{tmp_path}/t", ["id"], "seq", buckets=8)
    t.apply(spark.range(200).selectExpr("id", "1L AS seq", "'I' AS op"), 0)
    before = t._current()["folders"]
    t.apply(spark.createDataFrame([(5, 2, "D")], "id bigint, seq bigint, op string"), 1)
    after = t._current()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1 and t.rows().count() == 199
    t.apply(spark.createDataFrame([(5, 3, "I", "n")], "id bigint, seq bigint, op string, extra string"), 2)
    assert t.rows().count() == 200 and t.rows().filter("id = 5").first()["extra"] == "n"


def test_configuration(tmp_path):
    data = {"host": "h", "username": "u", "password": "p", "database": "d", "publication": {"name": "pub", "createIfNotExists": True, "operations": ["INSERT"], "tables": [{"name": "orders", "replicaIdentity": "FULL"}, {"name": "items", "replicaIdentity": "DEFAULT", "columns": ["id"]}]}, "slot": {"name": "s"}, "snapshot": {"enabled": True, "mode": "initial", "claimTimeout": "30s", "tables": [{"name": "items", "queryCondition": "id > 1"}]}, "heartbeat": {"table": {"name": "beat"}}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(data))
    with pytest.raises(config.ConfigError, match="heartbeat table public.beat"):
        config.read_config(str(path)).validate()
    data["publication"]["tables"].append({"name": "beat"})
    import yaml

    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(data))
    c = config.read_config(str(path)).validate()
    assert (c.port, c.slot.protoVersion, c.snapshot.chunkSize, c.snapshot.claimTimeout) == (5432, 2, 8000, 30.0)
    tables = c.snapshot_tables(c.publication)
    assert [(t.name, t.queryCondition, t.columns) for t in tables] == [("items", "id > 1", ("id",))]
    assert "password" not in c.shown() and c.dsn(replication="database") == "postgres://u:p@h:5432/d?replication=database"
    with pytest.raises(config.ConfigError, match="not in publication"):
        c.snapshot_tables(config.Publication("other", tables=(config.Table("x"),)))
    bad = config.from_dict({"slot": {"slotActivityCheckerInterval": 10, "protoVersion": 3}, "snapshot": {"enabled": True, "mode": "x", "chunkSize": -1}, "publication": {"tables": [{"name": "t", "replicaIdentity": "FULL", "columns": ["a"], "queryCondition": "a; b"}]}})
    with pytest.raises(config.ConfigError) as e:
        bad.validate()
    assert len(str(e.value).splitlines()) >= 10
    t = config.Table("t", columns=("a",))
    assert config.differing_tables([t], [t]) == [] and config.differing_tables([t], [config.Table("t")]) == [t]


def test_block_chunks_together_hold_each_row_once(spark, tmp_path):
    rows = people(spark, 95).select("name", F.create_map(F.lit("k"), "id").alias("m"))
    rows.repartition(3).write.parquet(f"{tmp_path}/t")
    want = sorted(r["name"] for r in rows.collect())
    for df in (spark.read.parquet(f"{tmp_path}/t"), rows):
        for key, condition in ((("name",), None), ((), "name <> 'User_7'")):
            spec = snapshot.TableSpec("t", key=key, columns=("name",), condition=condition)
            chunks = snapshot.plan_chunks(df, spec, 40, "s", 1, rows_per_block=10).orderBy("chunk_index").collect()
            read = [[r["name"] for r in snapshot.read_chunk(df, spec, c.asDict(), 10).collect()] for c in chunks]
            assert len(chunks) == 3 and all(len(x) in (39, 40) for x in read[:2])
            assert sorted(x for part in read for x in part) == [x for x in want if condition is None or x != "User_7"]


def test_a_snapshot_marks_the_last_row_of_chunks_that_are_not_full(spark, tmp_path):
    people(spark, 95).repartition(3).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    specs = [snapshot.TableSpec("range", key=("id",)), snapshot.TableSpec("block", key=("name",)), snapshot.TableSpec("offset", key=("id",), strategy=snapshot.OFFSET, condition="id > 20")]
    events = snapshot.take_snapshot({s.name: files for s in specs}, specs, "slot", 9, size=40, rows_per_block=10).filter("event_type = 'DATA'").collect()
    last = {s.name: [e["row_data"]["id"] for e in events if e["table_name"] == s.name and e["is_last"]] for s in specs}
    assert len(events) == 95 + 95 + 75 and last["range"] == ["95"] and len(last["block"]) == 1 and last["offset"] == ["95"]
