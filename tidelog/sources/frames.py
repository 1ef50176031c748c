"""Captured frames: the schema they are kept in, and the fixed-size parts read as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.pgtypes import source_time, to_source_time

FRAMES = "slot string, frame_seq bigint, wal_start decimal(20,0), wal_end decimal(20,0), server_time timestamp_ntz, payload binary"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def number(payload: Column, position: int, width: int) -> Column:
    """Unsigned big-endian number at a 1-based position, as decimal(20,0)."""
    return F.conv(F.hex(F.substring(payload, position, width)), 16, 10).cast("decimal(20,0)")


def tag_of(payload: Column) -> Column:
    return F.decode(F.substring(payload, 1, 1), "ISO-8859-1")


# Full lengths of the fixed-size messages, by tag.
_LENGTH = {"B": 21, "C": 26, "S": 6, "E": 1, "A": 9, "c": 30}
CONTENT = ("I", "U", "D", "T", "R")


def headers(frames: DataFrame) -> DataFrame:
    """Adds tag, xid, sub_xid, end_lsn, commit_lsn, commit_time and header_error, all in the JVM."""
    p, tag = F.col("payload"), F.col("tag")
    whole = F.lit(False)
    for t, n in _LENGTH.items():
        whole = whole | ((tag == t) & (F.length(p) >= n))
    at = lambda places, width, cast: _at(tag, whole, p, places, width).cast(cast)
    time = at({"C": 19, "c": 23}, 8, "decimal(20,0)")
    # times before the format's epoch are negative: numbers from 2^63 on
    signed = F.when(time >= F.lit(str(1 << 63)).cast("decimal(20,0)"), time - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(time)
    known = tag.isin(*_LENGTH, *CONTENT)
    return frames.withColumn("tag", tag_of(p)).withColumns({
        "xid": at({"B": 18, "S": 2, "A": 2, "c": 2}, 4, "bigint"),
        "sub_xid": at({"A": 6}, 4, "bigint"),
        "commit_lsn": at({"C": 3, "c": 7}, 8, "decimal(20,0)"),
        "end_lsn": at({"C": 11, "c": 15}, 8, "decimal(20,0)"),
        "commit_time": source_time(signed),
        "header_error": F.when(p.isNull() | (F.length(p) == 0), "empty message").when(~known, F.concat(F.lit("unsupported message "), tag)).when(~tag.isin(*CONTENT) & ~whole, "message too short"),
    })


def _at(tag: Column, whole: Column, payload: Column, places: dict[str, int], width: int) -> Column:
    out = None
    for t, position in places.items():
        value = number(payload, position, width)
        out = F.when((tag == t) & whole, value) if out is None else out.when((tag == t) & whole, value)
    return out


def split_packets(packets: DataFrame) -> DataFrame:
    """Copy-data packets (slot, packet_seq, data) to rows with ``kind``: log data, keepalive or an error.

    Log data become frames (wal_start, wal_end, server_time, payload); keepalives only
    move the received position and may ask for a reply.
    """
    d, tag = F.col("data"), F.decode(F.substring("data", 1, 1), "ISO-8859-1")
    log, alive = (tag == "w") & (F.length(d) >= 25), (tag == "k") & (F.length(d) == 18)
    kind = F.when(log, "log").when(alive, "keepalive").otherwise("error")
    signed = lambda c: F.when(c >= F.lit(str(1 << 63)).cast("decimal(20,0)"), c - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(c)
    return packets.select(
        "slot",
        F.col("packet_seq").alias("frame_seq"),
        kind.alias("kind"),
        F.when(log, number(d, 2, 8)).alias("wal_start"),
        F.when(log, number(d, 10, 8)).when(alive, number(d, 2, 8)).alias("wal_end"),
        source_time(signed(F.when(log, number(d, 18, 8)).when(alive, number(d, 10, 8)))).cast("timestamp_ntz").alias("server_time"),
        F.when(alive, F.substring(d, 18, 1) == F.unhex(F.lit("01"))).alias("reply_wanted"),
        F.when(log, F.substring(d, 26, 2147483647)).alias("payload"),
    )


def status_report(received: Column, flushed: Column, now: Column) -> Column:
    """A consumer's report of its positions, as it goes to the server (34 bytes)."""
    wide = lambda c: F.lpad(F.conv(c.cast("string"), 10, 16), 16, "0")
    time = F.lpad(F.hex(to_source_time(now)), 16, "0")
    return F.unhex(F.concat(F.lit("72"), wide(received), wide(flushed), wide(flushed), time, F.lit("00")))
