"""Frames in arrays against the rules frame by frame, cut into micro-batches anywhere."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_assembly import consistent, random_frames
from tidelog.sources import wire
from tidelog.sources.frames import FRAMES
from tidelog.sources.synthetic import SCENE, _encoded_scene, scenario_frames
from tidelog.streaming.assembly import SlotArrays, SlotAssembler, _decoded, _headed, _ipc, assemble_stream


def one_by_one(frames):
    rules = SlotAssembler(None, lambda x: [], lambda x: None)
    return sorted(row for seq, payload in frames for row in rules.frame("s", seq, seq * 10, payload))


def in_arrays(frames, cut, again=0):
    """``again``: so many frames of the batch before come once more, out of order."""
    state, kept, out = None, {}, []
    for a in range(0, len(frames), cut):
        part = frames[max(0, a - again) : a + cut]
        random.Random(a).shuffle(part)
        rules = SlotArrays(state, lambda x, n: kept[x, n], lambda x, n, piece: kept.__setitem__((x, n), piece), lambda x, n: kept.pop((x, n)))
        batch = _headed(pa.array([s for s, _ in part], pa.int64()), pa.array([s * 10 for s, _ in part], pa.int64()), pa.array([p for _, p in part], pa.binary()))
        for table in rules.batch(pa.Table.from_batches([batch])):
            packed = pa.RecordBatch.from_pydict({"slot": ["s"], "frames": pa.array([_ipc(table.combine_chunks().to_batches()[0])], pa.binary())})
            out += [tuple(r.values()) for b in _decoded(iter([packed])) for r in b.to_pylist()]
        state = json.loads(json.dumps(rules.state))
    return sorted(out)


@pytest.mark.parametrize("cut,again", [(1, 0), (7, 3), (10_000, 0)])
def test_random_frames(cut, again):
    for i in range(100):
        frames = [(seq, wire.encode(m)) for seq, m in consistent(random_frames(i))]
        assert in_arrays(frames, cut, again) == one_by_one(frames), i


@pytest.mark.parametrize("cut", [1, 5, 64, 10_000])
def test_scenes_and_what_cannot_be_read(cut):
    """Tables defined anew or not at all, truncates, interleaved streams, broken and unknown messages."""
    frames = [(k * SCENE + place, payload) for k in range(48) for place, payload in _encoded_scene(k, "O", None if k % 5 == 0 else "nöte", k == 0)]
    top = frames[-1][0]
    broken = [b"", b"Q", b"M", b"B\0", b"C", b"S\0\0\0\1", b"E", b"A\0", b"c\0", b"R", b"T\0\0", b"I\0", b"I\0\0\1\xf4N\0\1t\0\0\0\1x", b"U\0\0\1\xf4Z"]
    frames += [(top + 1 + i, payload) for i, payload in enumerate(broken)]
    frames += [(top + 50, wire.encode(wire.Boundary("S", xid=9, first=True))), (top + 51, b"T\0\0\0\x09\0\0\0\1\0\0\0\1\xf4"), (top + 52, b"D\0\0\0\x09\0\0"), (top + 53, wire.encode(wire.Boundary("c", xid=9, lsn=1, end_lsn=77, time_micros=0)))]
    got, want = in_arrays(frames, cut), one_by_one(frames)
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 70


def test_one_slot_is_decoded_in_many_tasks(spark, tmp_path):
    orders = spark.range(8000).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("n").alias("o_orderpriority"))
    scenario_frames(orders).coalesce(1).write.parquet(f"{tmp_path}/frames")
    stream = assemble_stream(spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/frames")).groupBy(F.spark_partition_id().alias("task")).count()
    q = stream.writeStream.outputMode("complete").format("memory").queryName("by_task").trigger(availableNow=True).start()
    q.awaitTermination()
    tasks = spark.table("by_task").collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 12_000  # twelve in eight scenes, definitions included
