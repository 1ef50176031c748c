"""Committed transactions from a log of frames, as a batch plan.

A slot's frames are one total order, and how to read a frame depends on what came
before it: content between a stream start and its stop belongs to an open streamed
transaction, other content to the transaction begun last. Both are carried along
the order in blocks (tidelog.operators.scan), so no slot becomes one task. From
there on transactions are keys, and all work is joins on them.

Delivered are: content of streamed transactions that commit, at the place of the
commit; other content at its own place, except the last message of a transaction
that never commits. The last message of a transaction acknowledges its end, the
others their own position. An aborted streamed transaction is dropped whole; with
``abort_scope="subtransaction"`` only what its aborted part wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.operators import scan
from tidelog.sources.frames import CONTENT, headers, number


def in_context(frames: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Headers, plus ``active_xid`` (of the open streamed chunk) and ``txn`` (the position of the last begin)."""
    h = headers(frames)
    tag = F.col("tag")
    marker = F.when(tag == "S", F.col("xid")).when(tag.isin("E", "c", "A"), F.lit(-1))
    rows = scan.last_known(h, ["slot"], "frame_seq", {"active_xid": marker, "txn": F.when(tag == "B", F.col("frame_seq"))}, block=block)
    return rows.withColumns({"active_xid": F.coalesce("active_xid", F.lit(-1)), "txn": F.coalesce("txn", F.lit(-1))}).withColumn("in_stream", F.col("active_xid") >= 0)


def assemble(rows: DataFrame, *, abort_scope: str = "transaction") -> DataFrame:
    """Delivered content of frames in context, with streamed, is_txn_last, ack_lsn, emit_seq, end_lsn and commit_time."""
    if abort_scope not in ("transaction", "subtransaction"):
        raise ValueError(f"unknown abort scope {abort_scope!r}")
    tag = F.col("tag")
    content = rows.filter(tag.isin(*CONTENT))
    row_columns = [c for c in rows.columns if c not in ("xid", "sub_xid", "end_lsn", "commit_lsn", "commit_time", "header_error", "active_xid", "txn")]

    # streamed: an xid may come again, so the first outcome after the row counts; there are few outcomes an xid
    part_only = F.lit(abort_scope == "subtransaction") & (tag == "A") & (F.col("sub_xid") != F.col("xid"))
    ends = rows.filter(tag.isin("c", "A") & F.col("header_error").isNull())
    end = F.struct("frame_seq", "tag", "end_lsn", "commit_time")
    outcomes = ends.groupBy("slot", F.col("xid").alias("active_xid")).agg(
        F.sort_array(F.collect_list(F.when(~part_only, end))).alias("outcomes"), F.collect_list(F.when(part_only, F.struct("frame_seq", "sub_xid"))).alias("parts")
    )
    streamed = content.filter("in_stream").join(outcomes, ["slot", "active_xid"])
    streamed = streamed.withColumn("outcome", F.get(F.filter("outcomes", lambda o: o["frame_seq"] > F.col("frame_seq")), 0)).filter("outcome.tag = 'c'")
    if abort_scope == "subtransaction":
        own_xid = number(F.col("payload"), 2, 4).cast("bigint")
        streamed = streamed.filter(~F.exists("parts", lambda p: (p["sub_xid"] == own_xid) & (p["frame_seq"] > F.col("frame_seq")) & (p["frame_seq"] < F.col("outcome.frame_seq"))))
    key = ["slot", "active_xid", "emit_seq"]
    streamed = streamed.withColumn("emit_seq", F.col("outcome.frame_seq"))
    last = streamed.groupBy(*key).agg(F.max("frame_seq").alias("last_seq"))
    streamed = streamed.join(last, key).select(*row_columns, F.col("active_xid").alias("xid"), F.lit(True).alias("streamed"), "emit_seq", "last_seq", F.col("outcome.end_lsn").alias("end_lsn"), F.col("outcome.commit_time").alias("commit_time"))

    # the others: the first commit after their begin
    plain = rows.filter((tag.isin(*CONTENT) & ~F.col("in_stream")) | ((tag == "C") & F.col("header_error").isNull()) | (tag == "B"))
    txns = plain.groupBy("slot", "txn").agg(F.max(F.when(tag.isin(*CONTENT), F.col("frame_seq"))).alias("last_seq"), F.min(F.when(tag == "C", F.struct("frame_seq", "end_lsn", "commit_time"))).alias("commit"))
    begins = rows.filter(tag == "B").select("slot", F.col("frame_seq").alias("txn"), F.col("xid").alias("begin_xid"))
    txns = txns.join(begins, ["slot", "txn"], "left")
    plain = content.filter(~F.col("in_stream")).join(txns, ["slot", "txn"])
    plain = plain.filter((F.col("frame_seq") != F.col("last_seq")) | F.col("commit").isNotNull())
    plain = plain.select(*row_columns, F.col("begin_xid").alias("xid"), F.lit(False).alias("streamed"), F.col("frame_seq").alias("emit_seq"), "last_seq", F.col("commit.end_lsn").alias("end_lsn"), F.col("commit.commit_time").alias("commit_time"))

    is_last = F.col("frame_seq") == F.col("last_seq")
    return streamed.unionByName(plain).withColumns({"is_txn_last": is_last, "ack_lsn": F.when(is_last, F.col("end_lsn")).otherwise(F.col("wal_start"))}).drop("last_seq")


def delivery_order(events: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``deliver_pos``, the place of each event in its slot's delivery."""
    return scan.row_numbers(events, ["slot"], "emit_seq", ["frame_seq"], "deliver_pos", block=block)


def received_position(frames: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``received``, the greatest log end seen so far in the slot."""
    return scan.running_max(frames, ["slot"], "frame_seq", F.col("wal_end"), "received", block=block)
