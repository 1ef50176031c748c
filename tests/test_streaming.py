"""Source, assembly and sinks together, with a restart in between."""

import json
import os

from pyspark.sql import functions as F

from tidelog.connector import Connector, retry
from tidelog.operators import decode
from tidelog.operators.apply import CurrentTable, upsert
from tidelog.sources import config, synthetic
from tidelog.sources.replication import ReplicationReader
from tidelog.streaming.sinks import into_table, to_topic

CONFIG = {"host": "h", "username": "u", "password": "p", "database": "d", "publication": {"name": "p", "operations": ["INSERT", "UPDATE", "DELETE"], "tables": [{"name": "events"}]}, "slot": {"name": "s"}}


def write_frames(spark, folder):
    events = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000 + 1_700_000_000_000_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.element_at(F.array(*map(F.lit, ("signup", "view", "click", "error"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"), (F.col("id") / 2).alias("value"), F.concat(F.lit("p"), F.col("id")).alias("props"))
    frames = synthetic.frames_of(events).cache()
    for k in range(4):
        frames.filter((F.col("frame_seq") >= k * 400) & (F.col("frame_seq") < (k + 1) * 400)).coalesce(1).sortWithinPartitions("frame_seq").write.mode("append").parquet(folder)
    return frames


def test_follow_a_slot_into_a_table(spark, tmp_path):
    folder, ack = str(tmp_path / "frames"), str(tmp_path / "ack")
    frames = write_frames(spark, folder)
    changes = decode.change_events(frames).filter("op IN ('I', 'U', 'D')").withColumn("id", F.coalesce(F.try_element_at("after", F.lit("id")), F.try_element_at("before", F.lit("id"))))
    ordered = changes.withColumn("seq", F.col("emit_seq") * 10_000 + F.col("frame_seq") % 10_000)
    want = sorted(tuple(r) for r in upsert(ordered.select("id", "seq", "op"), ["id"], "seq").select("id", "seq").collect())
    table = CurrentTable(spark, f"file://{tmp_path}/table", ["id"], "seq")
    for _ in range(2):  # the second run goes on from the checkpoint and finds nothing new to apply
        connector = Connector(spark, config.from_dict(CONFIG), folder)
        stream = connector.changes(ack_file=ack, max_files=1)
        keyed = stream.withColumn("id", F.coalesce(F.get_json_object("after", "$.id"), F.get_json_object("before", "$.id"))).withColumn("seq", F.col("emit_seq") * 10_000 + F.col("frame_seq") % 10_000).select("id", "seq", "op")
        q = into_table(keyed, table, str(tmp_path / "cp"), once=False)
        q.processAllAvailable()
        q.stop()
        assert sorted(tuple(r) for r in table.rows().select("id", "seq").collect()) == want
    # the position is confirmed once a batch is durable
    assert json.load(open(ack))["confirmed"] > 0 and len(bytes.fromhex(json.load(open(ack))["report"])) == 34


def test_reader_ranges(spark, tmp_path):
    folder = str(tmp_path / "frames")
    frames = write_frames(spark, folder)
    reader = ReplicationReader({"path": folder, "maxfiles": "1"})
    seen, at = 0, reader.initialOffset()
    for _ in range(20):
        end = reader.latestOffset()
        if end == at:
            break
        for p in reader.partitions(at, end):
            seen += sum(b.num_rows for b in reader.read(p))
        at = end
    assert seen == frames.count()


def test_connector_snapshot_then_changes(spark, tmp_path):
    folder = str(tmp_path / "frames")
    write_frames(spark, folder)
    got = []
    c = config.from_dict({**CONFIG, "snapshot": {"enabled": True, "mode": "initial", "queryCondition": "id < 2"}})
    connector = Connector(spark, c, folder, {"events": spark.range(3)}, checkpoint=str(tmp_path / "cp"))
    query = connector.start(lambda df, n: got.append((n, df.count())))
    query.processAllAvailable()
    assert connector.wait_until_ready(5)
    connector.close()
    assert got[0] == (-1, 4) and sum(n for b, n in got if b >= 0) > 0
    only = config.from_dict({**CONFIG, "snapshot": {"enabled": True, "mode": "snapshot_only", "tables": [{"name": "events"}]}})
    got.clear()
    assert Connector(spark, only, tables={"events": spark.range(3)}).start(lambda df, n: got.append(df.count())) is None and got == [5]
    assert Connector(spark, only, tables={"events": spark.range(3)}).start(lambda df, n: got.append(0), job_completed=True) is None and got == [5]


def test_topic_and_retry(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "I"), ("b", "D")], "id string, op string").write.parquet(folder)
    q = to_topic(spark.readStream.schema("id string, op string").parquet(folder), ["id"], str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 4:
            raise OSError

    retry(work, sleep=waits.append)
    assert waits == [10.0, 20.0, 40.0] and os.path.isdir(folder)
