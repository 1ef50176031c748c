import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidelog.functions import lsn, naming, pgtypes
from tidelog.sources import wire
from tidelog.operators import decode, monitor
from tidelog.sources.frames import headers, split_packets


def test_relation_bytes():
    data = b"R" + struct.pack(">I", 16390) + b"public\0t\0d" + struct.pack(">H", 2) + b"\x01id\0" + struct.pack(">Ii", 23, -1) + b"\x00name\0" + struct.pack(">Ii", 25, -1)
    r = wire.decode(data)
    assert (r.oid, r.namespace, r.name, r.identity) == (16390, "public", "t", "d")
    assert [(c.name, c.type_oid, c.type_mod, c.flags) for c in r.columns] == [("id", 23, -1, 1), ("name", 25, -1, 0)]
    assert wire.encode(r) == data


def test_insert_update_delete_bytes():
    t = lambda s: b"t" + struct.pack(">I", len(s)) + s
    head = struct.pack(">I", 16390)
    m = wire.decode(b"I" + head + b"N" + struct.pack(">H", 2) + t(b"605") + t(b"foo"))
    assert wire.named(m.new, ["id", "name"]) == {"id": "605", "name": "foo"}
    m = wire.decode(b"U" + head + b"O" + struct.pack(">H", 2) + t(b"53") + t(b"bar2") + b"N" + struct.pack(">H", 2) + t(b"53") + t(b"bar5"))
    assert m.old_kind == "O" and wire.named(m.old, ["id", "name"])["name"] == "bar2" and wire.named(m.new, ["id", "name"])["name"] == "bar5"
    m = wire.decode(b"D" + head + b"K" + struct.pack(">H", 2) + t(b"7") + b"n")
    assert wire.named(m.old, ["id", "name"]) == {"id": "7", "name": None}
    inside = wire.decode(b"I" + struct.pack(">I", 1234) + head + b"N" + struct.pack(">H", 0), True)
    assert inside.xid == 1234 and inside.oid == 16390


def test_null_is_a_value_but_unchanged_and_binary_are_absent():
    values = [("n", None), ("u", None), ("b", b"\x00"), ("t", b"x")]
    assert wire.named(values, ["a", "b", "c", "d"]) == {"a": None, "d": "x"}
    assert wire.fill_unchanged([("u", None), ("t", b"2")], [("t", b"1"), ("t", b"0")]) == [("t", b"1"), ("t", b"2")]
    assert wire.fill_unchanged([("t", b"1"), ("u", None)], [("t", b"1"), ("n", None)])[1] == ("n", None)


def test_truncate_and_boundaries():
    m = wire.decode(b"T" + struct.pack(">IBI", 1, 2, 42))
    assert m.oids == [42] and m.restart_identity and not m.cascade
    top = (1 << 64) - 1
    c = wire.decode(b"C" + struct.pack(">BQQq", 0, top, top, 0))
    assert c.lsn == top and c.end_lsn == top and c.time_micros == wire.EPOCH_MICROS
    assert wire.decode(b"S" + struct.pack(">IB", 9, 1)).first is True
    assert wire.decode(b"A" + struct.pack(">II", 9, 10)).sub_xid == 10
    assert wire.decode(b"c" + struct.pack(">IBQQq", 9, 0, 1, 2, 3)).end_lsn == 2


@pytest.mark.parametrize("data", [b"", b"B", b"C" + b"\0" * 24, b"Z", b"M\0", b"I\0\0\0\1X", b"I\0\0\0\1N\0\1t\0\0\0\5ab", b"R\0\0\0\1abc", b"T\0\0\0\2\0\0\0\0\1", b"I\0\0\0\1N\0\1q"])
def test_broken_messages_are_errors(data):
    with pytest.raises(wire.WireError):
        wire.decode(data)


def test_envelopes():
    tag, x = wire.decode_envelope(b"w" + struct.pack(">QQq", 5, 6, 7) + b"E")
    assert (tag, x["wal_start"], x["wal_end"], x["payload"]) == ("w", 5, 6, b"E")
    assert wire.decode_envelope(b"k" + struct.pack(">QqB", 9, 0, 1))[1]["reply"] is True
    with pytest.raises(wire.WireError):
        wire.decode_envelope(b"k" + b"\0" * 16)
    assert len(wire.status_update(1, 1, 0)) == 34


_value = st.one_of(st.just(("n", None)), st.just(("u", None)), st.binary(max_size=20).map(lambda b: ("t", b)))


@settings(max_examples=100, deadline=None)
@given(st.sampled_from("IUD"), st.lists(_value, max_size=5), st.one_of(st.none(), st.integers(0, 2**32 - 1)), st.integers(0, 2**32 - 1))
def test_changes_survive_a_round_trip(op, values, xid, oid):
    m = wire.Change(op, oid, xid, "K" if op == "D" else None, values if op == "D" else None, None if op == "D" else values)
    assert wire.decode(wire.encode(m), xid is not None) == m


def test_headers_agree_with_the_walker(spark):
    top = (1 << 64) - 2
    messages = [wire.Boundary("B", lsn=top, time_micros=wire.EPOCH_MICROS - 5_000_000, xid=4_000_000_000), wire.Boundary("C", flags=0, lsn=5, end_lsn=top, time_micros=wire.EPOCH_MICROS + 1), wire.Boundary("S", xid=3, first=True), wire.Boundary("E"), wire.Boundary("A", xid=3, sub_xid=4), wire.Boundary("c", xid=3, flags=0, lsn=7, end_lsn=8, time_micros=wire.EPOCH_MICROS)]
    rows = [("s", i, 0, 0, None, bytearray(wire.encode(m))) for i, m in enumerate(messages)] + [("s", 90, 0, 0, None, bytearray(b"C\0")), ("s", 91, 0, 0, None, bytearray(b"")), ("s", 92, 0, 0, None, bytearray(b"Zx")), ("s", 93, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "slot string, frame_seq bigint, wal_start int, wal_end int, server_time timestamp_ntz, payload binary")
    got = {r["frame_seq"]: r for r in headers(df).withColumn("micros", F.unix_micros("commit_time")).collect()}
    assert got[0]["xid"] == 4_000_000_000 and int(got[1]["end_lsn"]) == top and got[1]["micros"] == wire.EPOCH_MICROS + 1
    assert (got[4]["xid"], got[4]["sub_xid"]) == (3, 4) and int(got[5]["commit_lsn"]) == 7
    assert all(got[i]["header_error"] for i in (90, 91, 92, 93)) and not any(got[i]["header_error"] for i in range(6))


def test_positions(spark):
    assert lsn.parse_lsn(" 16/b374D848 ") == 0x16B374D848 and lsn.format_lsn(0x16B374D848) == "16/B374D848"
    with pytest.raises(ValueError):
        lsn.parse_lsn("16")
    values = [0, 1, 0xFFFFFFFF, 1 << 32, (1 << 63) + 5, (1 << 64) - 1]
    df = spark.createDataFrame([(str(v), lsn.format_lsn(v)) for v in values], "n string, t string")
    for r in df.select("n", "t", lsn.lsn_format(F.col("n").cast("decimal(20,0)")).alias("text"), lsn.lsn_parse("t").cast("string").alias("number")).collect():
        assert r["text"] == r["t"] and r["number"] == r["n"]
    bad = spark.createDataFrame([("",), (None,), ("x/1",), ("1",), ("123456789/1",), ("0000000001/0A",)], "t string")
    assert [r[0] for r in bad.select(lsn.lsn_parse("t")).collect()][:5] == [None] * 5


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(pgtypes.parse_timestamp(F.lit("2025-01-02T03:04:05Z")), pgtypes.parse_timestamp(F.lit("2025-01-02 03:04:05.5"))).first()[1].microsecond == 500000
    assert one.select(pgtypes.parse_nullable_bigint(F.lit(" ")), pgtypes.parse_nullable_bigint(F.lit("7")), pgtypes.parse_nullable_bigint(F.lit("z"))).first()[:] == (None, 7, None)
    assert one.select(naming.qualified(F.lit(None), F.lit("t")), naming.replica_identity(F.lit("f")), naming.replica_identity(F.lit("z"))).first()[:] == ("public.t", "FULL", "z")
    assert pgtypes.spark_type(1700, (10 << 16) + 2 + 4) == "decimal(10,2)" and pgtypes.spark_type(999999) == "string"
    assert one.select(pgtypes.typed(F.lit("x"), 23), pgtypes.typed(F.lit("12"), 23), pgtypes.typed(F.lit("t"), 16)).first()[:] == (None, 12, True)
    assert naming.ceil_div(101, 25) == 5 and naming.next_delay(40, 2, 60) == 60
    assert naming.dsn("h", 1, "u@x", "p/w", "d") == "postgres://u%40x:p%2Fw@h:1/d"
    from tidelog.sources.frames import status_report

    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert bytes(one.select(status_report(F.lit(str((1 << 63) + 5)).cast("decimal(20,0)"), F.lit(3), now)).first()[0]) == wire.status_update((1 << 63) + 5, 3, 1735689600000000)


def test_packets_identity_and_typed_rows(spark):
    rows = [("s", 1, bytearray(b"w" + struct.pack(">QQq", 5, 6, -1_000_000) + b"Exy")), ("s", 2, bytearray(b"k" + struct.pack(">QqB", 9, 0, 1))), ("s", 3, bytearray(b"k" + b"\0" * 16)), ("s", 4, None), ("s", 5, bytearray(b""))]
    got = {r["frame_seq"]: r for r in split_packets(spark.createDataFrame(rows, "slot string, packet_seq bigint, data binary")).collect()}
    assert (got[1]["kind"], int(got[1]["wal_start"]), int(got[1]["wal_end"]), bytes(got[1]["payload"])) == ("log", 5, 6, b"Exy") and got[1]["server_time"].year == 1999
    assert got[2]["kind"] == "keepalive" and int(got[2]["wal_end"]) == 9 and got[2]["reply_wanted"]
    assert [got[i]["kind"] for i in (3, 4, 5)] == ["error"] * 3
    one = monitor.system_identity(spark.createDataFrame([("7", "1", "16/B374D848", "db")], "systemid string, timeline string, xlogpos string, dbname string")).first()
    assert (one["system_id"], one["timeline"], int(one["position"]), one["database"]) == ("7", 1, 0x16B374D848, "db")
    df = spark.createDataFrame([({"id": "1", "n": None},), ({"id": "x"},), (None,)], "after map<string,string>")
    got = decode.typed_rows(df, [("id", 23, -1), ("n", 25, -1)], strict=True).collect()
    assert [(r["id"], r["present"], r["error"]) for r in got] == [(1, ["id", "n"], None), (None, ["id"], "not of its type: id"), (None, None, None)]
    assert naming.lock_key("ab") == 97 * 31 + 98 and naming.lock_key("x" * 50) >= 0
