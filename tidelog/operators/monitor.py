"""Counts, positions and metrics as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.lsn import lsn_lag, lsn_parse
from tidelog.functions.naming import latency_micros

#: Before every metric's name.
PREFIX = "cdc"
# Names of the metrics, which dashboards rely on.
COUNTERS = {"I": "insert_total", "U": "update_total", "D": "delete_total"}
LATENCY_GAUGES = {"cdc": "cdc_latency_current", "process": "process_latency_current"}
SLOT_GAUGES = ["slot_is_active", "slot_confirmed_flush_lsn", "slot_current_lsn", "slot_retained_wal_size", "slot_lag"]
SNAPSHOT_GAUGES = ["in_progress", "total_tables", "completed_tables", "total_rows", "duration_seconds", "total_chunks", "completed_chunks", "active_workers"]


def op_counts(changes: DataFrame, op: str = "op") -> DataFrame:
    return changes.groupBy(F.col(op).alias("op")).agg(F.count(F.lit(1)).alias("n"))


def lag_behind_newest(changes: DataFrame, position: Column, out: str = "lag") -> DataFrame:
    """Adds how far each row's position is behind the newest of all (one number, read first)."""
    newest = changes.agg(F.max(position).cast("string")).first()[0]
    return changes.withColumn(out, F.greatest(F.lit(newest).cast("decimal(20,0)") - position.cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)"))


def slot_status(slot_info: DataFrame) -> DataFrame:
    """The newest poll of each slot with its positions as numbers, retained log size and lag."""
    newest = slot_info.filter("slot_name is not null").groupBy("slot_name").agg(F.max(F.struct("polled_at", "poll_id", "active", "restart_lsn", "confirmed_flush_lsn", "current_lsn", "wal_status"))["poll_id"].alias("poll_id"))
    rows = slot_info.join(newest, ["slot_name", "poll_id"], "left_semi").dropDuplicates(["slot_name"])
    restart, confirmed, current = (lsn_parse(c) for c in ("restart_lsn", "confirmed_flush_lsn", "current_lsn"))
    return rows.select("slot_name", "active", "wal_status", confirmed.alias("confirmed_flush_lsn"), current.alias("current_lsn"), lsn_lag(current, restart).alias("retained_wal_size"), lsn_lag(current, confirmed).alias("lag"))


def slot_metrics(slot_info: DataFrame, host: str) -> DataFrame:
    """(name, slot_name, host, value) of the slot gauges."""
    s = slot_status(slot_info)
    values = {"slot_is_active": F.col("active").cast("int"), "slot_confirmed_flush_lsn": F.col("confirmed_flush_lsn"), "slot_current_lsn": F.col("current_lsn"), "slot_retained_wal_size": F.col("retained_wal_size"), "slot_lag": F.col("lag")}
    pairs = F.array(*(F.struct(F.lit(f"{PREFIX}_replication_slot_{k}").alias("name"), v.cast("double").alias("value")) for k, v in values.items()))
    return s.select("slot_name", F.explode(pairs).alias("m")).select("m.name", "slot_name", F.lit(host).alias("host"), "m.value")


def change_metrics(changes: DataFrame, host: str) -> DataFrame:
    """(name, slot_name, host, value) of the change counters."""
    names = F.create_map(*(F.lit(x) for kv in COUNTERS.items() for x in kv))
    counted = changes.filter(F.col("op").isin(list(COUNTERS))).groupBy("slot_name", "op").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.concat(F.lit(f"{PREFIX}_"), names[F.col("op")]).alias("name"), "slot_name", F.lit(host).alias("host"), "value")


def latency_metrics(changes: DataFrame, host: str, kind: str, begin: str, end: str) -> DataFrame:
    """(name, slot_name, host, value): of each slot's last message, the milliseconds from ``begin`` to ``end``; ``kind`` is cdc or process."""
    last = F.max(F.struct(end, "delivery_id", begin))
    rows = changes.filter(F.col("slot_name").isNotNull() & F.col(begin).isNotNull() & F.col(end).isNotNull()).groupBy("slot_name").agg(last.alias("m"))
    value = latency_micros(F.col(f"m.{end}"), F.col(f"m.{begin}")) / 1000
    return rows.select(F.lit(f"{PREFIX}_{LATENCY_GAUGES[kind]}").alias("name"), "slot_name", F.lit(host).alias("host"), value.alias("value"))


def snapshot_metrics(chunks: DataFrame, host: str) -> DataFrame:
    """(name, slot_name, host, value) of the snapshot gauges, from chunk rows."""
    done = F.col("status") == "completed"
    per_table = chunks.groupBy("slot_name", "table_schema", "table_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("c"), F.sum("rows_processed").alias("rows"), F.min("claimed_at").alias("began"), F.max("completed_at").alias("ended"))
    per_slot = per_table.groupBy("slot_name").agg(F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("n") == F.col("c")).alias("completed_tables"), F.sum("n").alias("total_chunks"), F.sum("c").alias("completed_chunks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), (F.unix_micros(F.max("ended").cast("timestamp")) - F.unix_micros(F.min("began").cast("timestamp"))).alias("us"))
    workers = chunks.filter(F.col("status") == "in_progress").groupBy("slot_name").agg(F.count_distinct("claimed_by").alias("active_workers"))
    s = per_slot.join(workers, "slot_name", "left")
    values = {"in_progress": (F.col("completed_chunks") < F.col("total_chunks")).cast("int"), "total_tables": F.col("total_tables"), "completed_tables": F.col("completed_tables"), "total_rows": F.col("total_rows"), "duration_seconds": F.col("us") / 1e6, "total_chunks": F.col("total_chunks"), "completed_chunks": F.col("completed_chunks"), "active_workers": F.coalesce("active_workers", F.lit(0))}
    pairs = F.array(*(F.struct(F.lit(f"{PREFIX}_snapshot_{k}").alias("name"), v.cast("double").alias("value")) for k, v in values.items()))
    return s.select("slot_name", F.explode(pairs).alias("m")).select("m.name", "slot_name", F.lit(host).alias("host"), "m.value")


def system_identity(rows: DataFrame) -> DataFrame:
    """(system_id, timeline, position, database) from the one row of text that a server identifies itself with."""
    return rows.select("systemid", F.col("timeline").try_cast("int").alias("timeline"), lsn_parse("xlogpos").alias("position"), F.col("dbname").alias("database")).withColumnRenamed("systemid", "system_id")


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) of metrics (name, slot_name, host, value) in the text format that scrapers read."""
    label = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), '"', r'\\"')
    return metrics.filter("value is not null").select(F.concat(F.col("name"), F.lit('{slot_name="'), label(F.col("slot_name")), F.lit('",host="'), label(F.col("host")), F.lit('"} '), F.col("value").cast("string")).alias("line"))
