"""A change log and captured frames made from the ``events`` table.

Offline there is no server to capture from. Each event becomes one change: ten
consecutive events form a transaction, every third transaction is streamed, some
streamed ones are aborted. ``frames_of`` encodes it all in the wire format.

``scenario_frames`` makes one short scene of each row of ``orders``, of eight kinds:
what the log of a busy server holds besides well-behaved transactions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.sources import wire
from tidelog.sources.frames import FRAMES

LSN_STEP = 1 << 24


def log_of(events: DataFrame) -> DataFrame:
    """(frame_seq, xid, pk, lsn, ts, value, props, event_type, op, streamed, aborted)."""
    e, xid = F.col("event_id"), F.floor(F.col("event_id") / 10).cast("bigint")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return events.select(e.alias("frame_seq"), xid.alias("xid"), F.col("user_id").alias("pk"), (e * LSN_STEP + F.col("user_id")).alias("lsn"), "ts", "value", "props", "event_type", op.alias("op"), (xid % 3 == 0).alias("streamed"), (xid % 21 == 0).alias("aborted"))


#: Frame positions: each change has room for the control frames around it.
ROOM = 8
OID, TABLE = 16384, "events"
_COLUMNS = ["id", "value", "props"]
_FRAME = pa.schema([("slot", pa.string()), ("frame_seq", pa.int64()), ("wal_start", pa.decimal128(20, 0)), ("wal_end", pa.decimal128(20, 0)), ("server_time", pa.timestamp("us")), ("payload", pa.binary())])


def _payloads(seq: int, xid: int, first: bool, last: bool, op: str, streamed: bool, aborted: bool, lsn: int, end: int, pk: int, value: str | None, props: str | None, micros: int) -> Iterator[tuple[int, bytes]]:
    at = seq * ROOM
    if seq == 0:
        columns = [wire.Column("id", 20, -1, 1), wire.Column("value", 701), wire.Column("props", 25)]
        yield at, wire.encode(wire.Relation(OID, "public", TABLE, "d", columns))
    if first:
        yield at + 1, wire.encode(wire.Boundary("S", xid=xid + 1, first=True) if streamed else wire.Boundary("B", lsn=end, time_micros=micros, xid=xid + 1))
    text = lambda x: ("t", str(x).encode()) if x is not None else ("n", None)
    own = xid + 1 if streamed else None
    if op == "D":
        yield at + 2, wire.encode(wire.Change("D", OID, own, "K", [text(pk), ("n", None), ("n", None)]))
    else:
        # every third row's props travel, the others are unchanged
        unchanged = op == "U" and seq % 3 != 0
        yield at + 2, wire.encode(wire.Change(op, OID, own, None, None, [text(pk), text(value), ("u", None) if unchanged else text(props)]))
    if last:
        if streamed:
            yield at + 3, wire.encode(wire.Boundary("E"))
            yield at + 4, wire.encode(wire.Boundary("A", xid=xid + 1) if aborted else wire.Boundary("c", xid=xid + 1, flags=0, lsn=end - 1, end_lsn=end, time_micros=micros))
        else:
            yield at + 4, wire.encode(wire.Boundary("C", flags=0, lsn=end - 1, end_lsn=end, time_micros=micros))


def _spread(rows: DataFrame) -> DataFrame:
    """Encoding takes Python long for few bytes: rows are dealt out in a number of tasks, not by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def frames_of(events: DataFrame, slot: str = "events_slot") -> DataFrame:
    """The change log as captured frames."""
    log = log_of(events)
    ends = log.groupBy("xid").agg(F.max("lsn").alias("top"), F.min("frame_seq").alias("first_seq"), F.max("frame_seq").alias("last_seq"))
    rows = log.join(ends, "xid").select("frame_seq", "xid", (F.col("frame_seq") == F.col("first_seq")).alias("first"), (F.col("frame_seq") == F.col("last_seq")).alias("last"), "op", "streamed", "aborted", "lsn", (F.col("top") + 1).alias("end"), "pk", F.col("value").cast("string").alias("value"), "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _FRAME.names}
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for at, payload in _payloads(*row):
                    for n, v in zip(_FRAME.names, (slot, at, row[7], row[7], row[12], payload)):
                        out[n].append(v)
            columns = [pa.array(out["slot"]), pa.array(out["frame_seq"], pa.int64()), pa.array(out["wal_start"], pa.int64()).cast(pa.decimal128(20, 0)), pa.array(out["wal_end"], pa.int64()).cast(pa.decimal128(20, 0)), pa.array(out["server_time"], pa.int64()).cast(pa.timestamp("us")), pa.array(out["payload"], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_FRAME)

    return _spread(rows).mapInArrow(encode, FRAMES)


#: Frame positions of one scene, and the positions that its plain and its streamed commit end at.
SCENE, PLAIN_END, STREAM_END = 64, 40, 41
SCENE_OID, UNKNOWN_OID = 500, 999


def _scene(key: int, status: str, note: str, first: bool) -> Iterator[tuple[int, object]]:
    """(place in the scene, message)."""
    text = lambda x: ("t", str(x).encode()) if x is not None else ("n", None)
    relation = lambda second: wire.Relation(SCENE_OID, "public", "orders", "d", [wire.Column("id", 20, -1, 1), wire.Column(second, 25), wire.Column("note", 25)])
    row, null, same = [text(key), text(status), text(note)], ("n", None), ("u", None)
    change = lambda op, new=None, old=None, kind=None, xid=None, oid=SCENE_OID: wire.Change(op, oid, xid, kind, old, new)
    begin, end = wire.Boundary("B", lsn=key, time_micros=wire.EPOCH_MICROS, xid=4 * key + 1), wire.Boundary("C", flags=0, lsn=key, end_lsn=key * SCENE + PLAIN_END, time_micros=wire.EPOCH_MICROS)
    start = lambda x, first=True: wire.Boundary("S", xid=4 * key + x, first=first)
    stop = wire.Boundary("E")
    if first:
        yield 0, relation("status")
    kind = key % 8
    if kind == 2:  # two streamed transactions, one between the chunks of the other; one commits, one aborts
        yield from enumerate([start(1), change("I", row, xid=4 * key + 1), stop, start(2), change("I", row, xid=4 * key + 2), stop, start(1, False), change("U", row, xid=4 * key + 1), stop, wire.Boundary("c", xid=4 * key + 2, flags=0, lsn=key, end_lsn=key * SCENE + STREAM_END, time_micros=wire.EPOCH_MICROS), wire.Boundary("A", xid=4 * key + 1)], 1)
        return
    content = {
        0: [change("I", row), change("U", [text(key), text("X"), same])],  # a column unchanged, nothing said of the old row
        1: [change("I", row), change("I", row)],  # never committed
        3: [wire.Truncate([SCENE_OID, UNKNOWN_OID], True, key % 16 == 3)],
        4: [change("U", [text(key), text("X"), same], row, "O")],
        5: [change("U", [text(key), text("X"), same], [text(key), null, null], "K")],
        6: [relation("state"), change("I", row), relation("status")],  # the table is defined anew, and back
        7: [change("I", row, oid=UNKNOWN_OID), change("D", None, [text(key), null, null], "K")],
    }[kind]
    yield from enumerate([begin, *content, *([] if kind == 1 else [end])], 1)


def _encoded_scene(*row) -> list[tuple[int, bytes]]:
    return [(place, wire.encode(message)) for place, message in _scene(*row)]


def scenario_frames(orders: DataFrame, slot: str = "orders_slot") -> DataFrame:
    """One scene a row of ``orders``, as captured frames."""
    least = orders.agg(F.min("o_orderkey")).first()[0]
    rows = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderkey") == F.lit(least))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, payloads = [], []
            for key, status, note, first in zip(*(c.to_pylist() for c in batch.columns)):
                for place, payload in _encoded_scene(key, status, note, first):
                    at.append(key * SCENE + place)
                    payloads.append(payload)
            place = pa.array(at, pa.int64()).cast(pa.decimal128(20, 0))
            yield pa.RecordBatch.from_arrays([pa.array([slot] * len(at)), pa.array(at, pa.int64()), place, place, pa.array([0] * len(at), pa.int64()).cast(pa.timestamp("us")), pa.array(payloads, pa.binary())], schema=_FRAME)

    return _spread(rows).mapInArrow(encode, FRAMES)
