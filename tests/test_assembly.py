"""Batch plan and stateful stream against a small interpreter of the rules, over random frames."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import assemble, decode
from tidelog.sources import wire
from tidelog.sources.frames import FRAMES
from tidelog.streaming.assembly import SlotAssembler, assemble_stream


def interpret(messages):
    """(frame, ack) in order of delivery."""
    out, active, buffers, ahead = [], None, {}, None

    def release(ack):
        nonlocal ahead
        if ahead is not None:
            out.append((ahead, ahead * 10 if ack is None else ack))
            ahead = None

    for seq, m in messages:
        tag = getattr(m, "tag", None)
        if tag is None:
            if active is not None:
                buffers.setdefault(active, []).append(seq)
            else:
                release(None)
                ahead = seq
        elif tag == "B":
            ahead = None
        elif tag == "C":
            release(m.end_lsn)
        elif tag == "S":
            active = m.xid
        elif tag == "E":
            active = None
        else:
            active = None
            frames = buffers.pop(m.xid, [])
            if tag == "c":
                out += [(f, m.end_lsn if i == len(frames) - 1 else f * 10) for i, f in enumerate(frames)]
    return out


def random_frames(seed, close=0.7):
    r = random.Random(seed)
    out, seq = [(0, wire.Relation(1, "public", "t", "d", [wire.Column("id", 23)]))], 1

    def add(m):
        nonlocal seq
        out.append((seq, m))
        seq += r.choice((1, 1, 3))

    text = lambda: [("t", str(seq).encode())]
    for _ in range(r.randint(3, 14)):
        if r.random() < 0.5:
            xid = r.randint(100, 110)
            add(wire.Boundary("B", lsn=1, time_micros=0, xid=xid))
            for _ in range(r.randint(0, 3)):
                add(wire.Change("I", 1, None, None, None, text()))
            if r.random() < 0.75:
                add(wire.Boundary("C", flags=0, lsn=1, end_lsn=seq * 1000, time_micros=0))
        else:
            xid = r.randint(1, 3)
            add(wire.Boundary("S", xid=xid, first=True))
            for _ in range(r.randint(0, 3)):
                add(wire.Change("I", 1, xid, None, None, text()))
            if r.random() < close:
                add(wire.Boundary("E"))
            if r.random() < 0.6:
                add(wire.Boundary("c", xid=xid, flags=0, lsn=1, end_lsn=seq * 1000, time_micros=0) if r.random() < 0.7 else wire.Boundary("A", xid=xid, sub_xid=xid))
    # the first relation is delivered like any content
    return out


def frames_df(spark, slots):
    rows = [(slot, seq, seq * 10, seq * 10, None, bytearray(wire.encode(m))) for slot, ms in slots.items() for seq, m in ms]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "slot string, frame_seq bigint, wal_start bigint, wal_end bigint, server_time timestamp_ntz, payload binary")
    return df.select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]) for c in FRAMES.split(", ")))


def consistent(messages):
    """Content is encoded as the stream's state demands: an xid inside, none outside."""
    out, active = [], None
    for seq, m in messages:
        if isinstance(m, wire.Change):
            m = wire.Change(m.op, m.oid, active, m.old_kind, m.old, m.new)
        elif isinstance(m, wire.Boundary):
            active = m.xid if m.tag == "S" else None if m.tag in "EcA" else active
        out.append((seq, m))
    return out


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_batch_plan_equals_the_interpreter(spark, block):
    slots = {f"s{i}": consistent(random_frames(i, 0.7 if i % 2 else 1.0)) for i in range(40)}
    events = assemble.delivery_order(decode.change_events(frames_df(spark, slots), block=block), block=block)
    got = {}
    for r in events.orderBy("slot", "deliver_pos").collect():
        got.setdefault(r["slot"], []).append((r["frame_seq"], int(r["ack_lsn"])))
        assert r["op"] == "R" or (r["error"] is None and r["after"] == {"id": r["after"]["id"]})
    for slot, ms in slots.items():
        assert got.get(slot, []) == interpret(ms), slot


@pytest.mark.parametrize("cut", [1, 7, 10_000])
def test_stream_rules_equal_the_interpreter(cut):
    for i in range(150):
        ms, state, kept, out = consistent(random_frames(i)), None, {}, []
        for a in range(0, len(ms), cut):
            rules = SlotAssembler(state, lambda x: kept.get(x, []), lambda x: kept.pop(x, None))
            for seq, m in ms[a : a + cut]:
                out += [(row[1], row[9]) for row in rules.frame("s", seq, seq * 10, wire.encode(m))]
            for xid, part in rules.pending.items():
                kept.setdefault(xid, []).extend(part)
            state = rules.state
        assert out == interpret(ms)


def test_stateful_stream_equals_batch(spark, tmp_path):
    slots = {f"s{i}": consistent(random_frames(i + 500)) for i in range(6)}
    frames = frames_df(spark, slots).cache()
    top = frames.agg(F.max("frame_seq")).first()[0]
    folder = str(tmp_path / "frames")
    for k in range(3):  # three files, three micro-batches
        part = frames.filter((F.col("frame_seq") >= top * k // 3 + (1 if k else 0)) & (F.col("frame_seq") <= top * (k + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = assemble_stream(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("slot", "emit_seq", "frame_seq").collect():
        got.setdefault(r["slot"], []).append((r["frame_seq"], r["ack_lsn"]))
    for slot, ms in slots.items():
        assert got.get(slot, []) == interpret(ms), slot


def test_subtransaction_abort_and_dead_letters(spark):
    t = [("t", b"1")]
    ms = [(0, wire.Relation(1, "public", "t", "d", [wire.Column("id", 23)])), (1, wire.Boundary("S", xid=5, first=True)), (2, wire.Change("I", 1, 5, None, None, t)), (3, wire.Change("I", 1, 6, None, None, t)), (4, wire.Boundary("E")), (5, wire.Boundary("A", xid=5, sub_xid=6)), (6, wire.Boundary("c", xid=5, flags=0, lsn=1, end_lsn=99, time_micros=0)), (7, wire.Boundary("B", lsn=1, time_micros=0, xid=9)), (8, wire.Change("I", 77, None, None, None, t)), (9, wire.Truncate([1, 2], True, False)), (10, wire.Boundary("C", flags=0, lsn=1, end_lsn=100, time_micros=0))]
    df = frames_df(spark, {"s": ms})
    whole = {r["frame_seq"] for r in decode.change_events(df).collect()}
    part = decode.change_events(df, abort_scope="subtransaction")
    # frame 0 was still held back when a transaction began, and is dropped
    assert whole == {8, 9} and {r["frame_seq"] for r in part.collect()} == {2, 8, 9}
    assert part.filter("frame_seq = 8").first()["error"].startswith("no relation 77")
    cut = part.filter("op = 'T'").first()
    assert (cut["oids"], cut["truncated"], cut["cascade"], cut["restart_identity"]) == ([1, 2], ["public.t", "oid:2"], True, False)
    broken = frames_df(spark, {"s": []}).unionByName(spark.createDataFrame([("s", 1, 0, 0, None, bytearray(b"Q"))], "slot string, frame_seq bigint, wal_start int, wal_end int, server_time timestamp_ntz, payload binary"))
    assert decode.dead_letters(broken).first()["reason"] == "unsupported message Q"
    assert decode.change_events(frames_df(spark, {"s": []})).count() == 0
