"""Queries of the change-data operators over the star tables and the log made from ``events``."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.connector import Connector
from tidelog.functions.lsn import lsn_format, lsn_parse
from tidelog.functions.naming import dsn, latency_micros, lock_key, qualified, quote_identifier, replica_identity, snapshot_slot_name
from tidelog.functions.pgtypes import parse_nullable_bigint, parse_timestamp
from tidelog.operators import apply, assemble, decode, monitor, publication, replay, scan, snapshot
from tidelog.operators.jobs import SnapshotJob
from tidelog.plans.source_tables import table
from tidelog.sources import statements
from tidelog.sources.config import MODES, from_dict
from tidelog.sources.frames import FRAMES, split_packets, status_report
from tidelog.sources.synthetic import LSN_STEP, ROOM, SCENE, frames_of, log_of, scenario_frames

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_LOG = """log AS (SELECT event_id AS frame_seq, event_id//10 AS xid, user_id AS pk,
  event_id*16777216 + user_id AS lsn, ts, value, props, event_type,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
  (event_id//10)%3 = 0 AS streamed, (event_id//10)%21 = 0 AS aborted FROM events)"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("$LOG", _LOG)
        return f

    return add


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of(table(spark, sf, "events"))


# --- snapshots ---------------------------------------------------------------


@_query("SELECT i AS chunk_index, lo + i*100 AS range_start, least(lo + i*100 + 99, hi) AS range_end FROM (SELECT min(o_orderkey) lo, max(o_orderkey) hi FROM orders) b, range(0, (hi - lo + 100)//100) r(i)")
def snapshot_range_chunks(spark, sf):
    return snapshot.range_chunks(snapshot.key_bounds(table(spark, sf, "orders"), "o_orderkey"), 100)


@_query("SELECT (o_orderkey - (SELECT min(o_orderkey) FROM orders))//100 AS chunk_index, count(*) AS rows_processed FROM orders GROUP BY 1")
def snapshot_range_chunk_rows(spark, sf):
    orders = table(spark, sf, "orders")
    lo = orders.agg(F.min("o_orderkey")).first()[0]  # the planner's bound
    return snapshot.with_chunk(orders, "o_orderkey", F.lit(lo), 100).groupBy("chunk_index").agg(F.count(F.lit(1)).alias("rows_processed"))


@_query("SELECT i AS chunk_index, i*80 AS block_start, CASE WHEN i < n-1 THEN (i+1)*80 END AS block_end, i = n-1 AS is_last_chunk FROM (SELECT ((count(*)+99)//100 + 79)//80 AS n FROM lineitem) b, range(0, n) r(i)")
def snapshot_block_chunks(spark, sf):
    return snapshot.block_chunks(snapshot.blocks_of(table(spark, sf, "lineitem")), 8000)


@_query("SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1)//100 AS chunk_index FROM orders")
def snapshot_offset_chunk(spark, sf):
    """All offset chunks of the table, in one pass."""
    spec = snapshot.TableSpec("orders", key=("o_orderkey",), strategy=snapshot.OFFSET)
    return snapshot.chunk_rows(table(spark, sf, "orders"), spec, 100).withColumnRenamed("__chunk", "chunk_index").drop("__last")


@_query("SELECT (o_orderkey - (SELECT min(o_orderkey) FROM orders))//8000 AS chunk_index, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F'")
def snapshot_query_condition(spark, sf):
    """All range chunks of the table with the condition, in one pass."""
    spec = snapshot.TableSpec("orders", key=("o_orderkey",), columns=("o_orderkey", "o_orderstatus"), condition="o_orderstatus = 'O' OR o_orderstatus = 'F'")
    return snapshot.chunk_rows(table(spark, sf, "orders"), spec, 8000).withColumnRenamed("__chunk", "chunk_index").drop("__last")


@_query("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE (o_orderstatus <> 'F') UNION ALL SELECT 'customer', count(*) FROM customer WHERE (c_acctbal >= 0)")
def snapshot_condition_override(spark, sf):
    own, general = {"public.orders": "o_orderstatus <> 'F'"}, "c_acctbal >= 0"
    count = lambda t: publication.filter_rows(table(spark, sf, t), publication.condition_for(t, own, general)).agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"))
    return count("orders").unionByName(count("customer"))


@_query("SELECT c_custkey, c_name FROM customer")
def snapshot_column_list(spark, sf):
    return publication.select_columns(table(spark, sf, "customer"), ["c_custkey", "c_name"])


@_query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey//128 ORDER BY o_orderkey DESC) = 1 AND count(*) OVER (PARTITION BY o_orderkey//128) < 128 AS is_last FROM orders")
def snapshot_is_last(spark, sf):
    rows = snapshot.with_chunk(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", F.lit(0), 128)
    return snapshot.mark_last(rows, "chunk_index", "o_orderkey", 128).select("o_orderkey", "is_last")


_EVENTS = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, sum(n)::BIGINT AS rows_read, count(*) FILTER (WHERE n < 8000) AS last_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY ({k} - (SELECT min({k}) FROM {t}))//8000)" for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))]
    + ["SELECT 'lineitem', count(*), (count(*) % 8000 > 0)::INT FROM lineitem"]
)


@_query(_EVENTS)
def snapshot_events_of_job(spark, sf):
    """The snapshot of all star tables: rows, and last rows of chunks that aren't full."""
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
    specs = [*(snapshot.TableSpec(t, key=(k,)) for t, k in keys.items()), snapshot.TableSpec("lineitem", key=("l_orderkey", "l_linenumber"))]
    events = snapshot.take_snapshot({s.name: table(spark, sf, s.name) for s in specs}, specs, "job", 1 << 40)
    return events.filter("op = 'r'").groupBy("table_name").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if("is_last").alias("last_rows"))


_PLAN = """
WITH c AS (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer), l AS (SELECT ((count(*) + 99)//100 + 79)//80 AS n FROM lineitem),
 o AS (SELECT greatest((count(*) + 7999)//8000, 1) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT 'customer' AS table_name, 'integer_range' AS partition_strategy, i AS chunk_index, i*8000 AS chunk_start, lo + i*8000 AS range_start, least(lo + i*8000 + 7999, hi) AS range_end, NULL::BIGINT AS block_start, NULL::BIGINT AS block_end, i = (hi - lo + 8000)//8000 - 1 AS is_last_chunk FROM c, range(0, (hi - lo + 8000)//8000) r(i)
UNION ALL SELECT 'lineitem', 'ctid_block', i, i*8000, NULL, NULL, i*80, CASE WHEN i < n - 1 THEN (i + 1)*80 END, i = n - 1 FROM l, range(0, n) r(i)
UNION ALL SELECT 'orders', 'offset', i, i*8000, NULL, NULL, NULL, NULL, NULL FROM o, range(0, n) r(i)"""


def _planned(spark: SparkSession, sf: str) -> tuple[dict, list]:
    specs = [snapshot.TableSpec("customer", key=("c_custkey",)), snapshot.TableSpec("lineitem", key=("l_orderkey", "l_linenumber")), snapshot.TableSpec("orders", key=("o_orderkey",), condition="o_orderstatus <> 'F'", strategy="offset")]
    return {s.name: table(spark, sf, s.name) for s in specs}, specs


@_query(_PLAN)
def snapshot_plan(spark, sf):
    """Strategies chosen by the key, or asked for, and the chunks of each table, written to the job's record and read back."""
    tables, specs = _planned(spark, sf)
    chunks = reduce(DataFrame.unionByName, (snapshot.plan_chunks(tables[s.name], s, 8000, "job", 1 << 40) for s in specs))
    job = SnapshotJob(spark, storage.fresh_dir(spark, "job"))
    job.create(chunks, "job", 1 << 40, datetime(2025, 1, 1))
    return job.chunks().select("table_name", "partition_strategy", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_start", "range_start", "range_end", "block_start", "block_end", "is_last_chunk")


@_query("""
SELECT 'customer' AS table_name, (c_custkey - (SELECT min(c_custkey) FROM customer))//8000 AS chunk_index, 'completed' AS status, count(*) AS rows_processed FROM customer GROUP BY 2
UNION ALL SELECT 'lineitem', i, 'completed', least(8000, n - i*8000) FROM (SELECT count(*) AS n FROM lineitem) t, range(0, (n + 7999)//8000) r(i)
UNION ALL SELECT 'orders', i, 'completed', least(8000, n - i*8000) FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F') t, range(0, (n + 7999)//8000) r(i)""")
def snapshot_job_run(spark, sf):
    """A job of three tables claimed in waves, read by every strategy, and completed chunk by chunk."""
    tables, specs = _planned(spark, sf)
    config = from_dict({"host": "h", "username": "u", "password": "p", "database": "d", "snapshot": {"enabled": True, "mode": "snapshot_only", "tables": [{"name": s.name, "queryCondition": s.condition, "snapshotPartitionStrategy": s.strategy} for s in specs]}})
    job = SnapshotJob(spark, storage.fresh_dir(spark, "job"))
    delivered = []
    Connector(spark, config, tables=tables, keys={s.name: list(s.key) for s in specs}).run_snapshot(1 << 40, lambda df, n: delivered.append(df.filter("op = 'r'").count()), job, wave=30)
    assert sum(delivered) == job.chunks().agg(F.sum("rows_processed")).first()[0]
    return job.chunks().select("table_name", F.col("chunk_index").cast("bigint").alias("chunk_index"), "status", "rows_processed")


@_query("""
SELECT 'orders' AS table_name, o_orderkey::VARCHAR AS row_key, (row_number() OVER (ORDER BY o_orderkey) - 1)//8000 AS chunk_index, row_number() OVER (ORDER BY o_orderkey) = count(*) OVER () AND count(*) OVER () % 8000 > 0 AS is_last FROM orders
UNION ALL SELECT 'customer', c_custkey::VARCHAR, (c_custkey - min(c_custkey) OVER ())//8000, c_custkey = max(c_custkey) OVER (PARTITION BY (c_custkey - (SELECT min(c_custkey) FROM customer))//8000) AND count(*) OVER (PARTITION BY (c_custkey - (SELECT min(c_custkey) FROM customer))//8000) < 8000 FROM customer""")
def snapshot_rows(spark, sf):
    """Keys, chunks and last rows of snapshot events, by offset and by range."""
    specs = [snapshot.TableSpec("orders", key=("o_orderkey",), strategy="offset"), snapshot.TableSpec("customer", key=("c_custkey",))]
    events = snapshot.take_snapshot({s.name: table(spark, sf, s.name) for s in specs}, specs, "job", 1 << 40)
    return events.filter("op = 'r'").select("table_name", "row_key", F.col("chunk_index").cast("bigint").alias("chunk_index"), "is_last")


@_query("SELECT n_nationkey::VARCHAR AS row_key, n_name AS name, n_regionkey::VARCHAR AS region, NULL::VARCHAR AS missing FROM nation")
def snapshot_images(spark, sf):
    """Snapshot rows as maps of text."""
    spec = snapshot.TableSpec("nation", key=("n_nationkey",))
    rows = snapshot.take_snapshot({"nation": table(spark, sf, "nation")}, [spec], "job", 1).filter("op = 'r'")
    return rows.select("row_key", F.col("row_data")["n_name"].alias("name"), F.col("row_data")["n_regionkey"].alias("region"), F.try_element_at("row_data", F.lit("x")).alias("missing"))


@_query("""WITH r AS (SELECT coalesce(nullif(table_schema, ''), 'public') AS table_schema, table_name, arg_max(column_list, (lsn, relation_id)) AS c FROM relation_log WHERE column_list IS NOT NULL GROUP BY 1, 2)
SELECT table_schema, table_name, coalesce(list_aggregate(list_transform(list_filter(c, lambda x: x.flags = 1), lambda x: x.name), 'string_agg', ','), '') AS key_columns FROM r""")
def primary_keys(spark, sf):
    return snapshot.primary_keys(table(spark, sf, "relation_log")).select("table_schema", "table_name", F.concat_ws(",", "key_columns").alias("key_columns"))


@_query("SELECT slot_name, table_name, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) = count(*) FILTER (WHERE status = 'completed') AS done FROM snapshot_chunks GROUP BY 1, 2")
def chunk_completion(spark, sf):
    return snapshot.completion(table(spark, sf, "snapshot_chunks"), ["slot_name", "table_name"], F.col("status") == "completed")


@_query("SELECT table_name, count(*) AS chunks, round(100.0 * count(*) FILTER (WHERE status = 'completed') / nullif(count(*), 0), 2)::DOUBLE AS pct FROM snapshot_chunks GROUP BY 1")
def chunk_progress(spark, sf):
    return snapshot.progress(table(spark, sf, "snapshot_chunks"), ["table_name"], F.col("status") == "completed")


@_query("""WITH t AS (SELECT max(heartbeat_at) AS now FROM snapshot_chunks) SELECT slot_name AS slot, min(chunk_index)::INT AS chunk_index FROM snapshot_chunks, t
WHERE status = 'pending' OR (status = 'in_progress' AND (heartbeat_at IS NULL OR heartbeat_at < now - INTERVAL 30 SECOND)) GROUP BY 1""")
def chunk_claim_next(spark, sf):
    chunks = table(spark, sf, "snapshot_chunks")
    now = chunks.agg(F.max("heartbeat_at")).first()[0]
    return snapshot.next_claims(chunks, snapshot.claimable(F.col("status"), F.col("heartbeat_at"), F.lit(now).cast("timestamp_ntz"), 30), "slot_name", "chunk_index")


@_query("SELECT id, slot_name, chunk_index, NULL::BIGINT AS block_end, NULL::VARCHAR AS partition_strategy, status FROM snapshot_chunks WHERE slot_name <> 'snapshot_only_db000001'")
def chunk_metadata_migrated(spark, sf):
    """Chunk rows of an older layout under today's columns, after a slot was cleaned up."""
    old = table(spark, sf, "snapshot_chunks").drop("range_start", "range_end", "block_start", "block_end", "is_last_chunk", "partition_strategy")
    return snapshot.without_slot(snapshot.migrate_chunks(old), "snapshot_only_db000001").select("id", "slot_name", "chunk_index", "block_end", "partition_strategy", "status")


@_query("SELECT slot_name, snapshot_lsn::BIGINT AS snapshot_lsn, count(*) = count(*) FILTER (WHERE status = 'completed') AS completed, count(*)::INT AS total_chunks, (count(*) FILTER (WHERE status = 'completed'))::INT AS completed_chunks FROM snapshot_chunks GROUP BY 1, 2")
def snapshot_jobs(spark, sf):
    return snapshot.job_of(table(spark, sf, "snapshot_chunks")).withColumn("snapshot_lsn", F.col("snapshot_lsn").cast("bigint"))


# --- positions, filters, counts ----------------------------------------------


@_query("SELECT event_id, printf('%X/%X', (event_id*16777216 + user_id)//4294967296, (event_id*16777216 + user_id)%4294967296) AS lsn_text FROM events")
def lsn_format_text(spark, sf):
    return table(spark, sf, "events").select("event_id", lsn_format(F.col("event_id") * LSN_STEP + F.col("user_id")).alias("lsn_text"))


@_query("WITH $LOG SELECT frame_seq, greatest((SELECT max(lsn) FROM log) - lsn, 0) AS lag FROM log")
def lsn_lag(spark, sf):
    return monitor.lag_behind_newest(_log(spark, sf), F.col("lsn")).select("frame_seq", F.col("lag").cast("bigint").alias("lag"))


@_query("WITH $LOG SELECT op, count(*) AS n FROM log GROUP BY op")
def op_counts(spark, sf):
    return monitor.op_counts(_log(spark, sf))


@_query("WITH $LOG SELECT frame_seq, op FROM log WHERE op IN ('I','D')")
def op_filter(spark, sf):
    return publication.keep_operations(_log(spark, sf), ["INSERT", "DELETE"]).select("frame_seq", "op")


@_query("WITH $LOG SELECT frame_seq, op FROM log WHERE NOT (pk = 0 AND op IN ('I','U','D'))")
def heartbeat_suppression(spark, sf):
    return publication.without_heartbeats(_log(spark, sf), F.col("pk") == 0).select("frame_seq", "op")


@_query("SELECT e.event_id, CASE WHEN m.root IS NOT NULL THEN m.root ELSE e.event_type END AS table_name FROM events e LEFT JOIN (VALUES ('view','engagement'),('click','engagement')) m(child, root) ON e.event_type = m.child")
def partition_root_map(spark, sf):
    roots = spark.createDataFrame([("view", "engagement"), ("click", "engagement")], "child string, root string")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("table_name"))
    return publication.to_root(rows, roots, "table_name")


_NEWEST = "n AS (SELECT coalesce(nullif(table_schema, ''), 'public') AS table_schema, table_name, arg_max({'pub': pub_name, 'id': replica_identity, 'ix': replica_identity_index, 'part': is_partitioned, 'cols': column_list}, (config_rev, pub_row_id)) AS x FROM publication_tables GROUP BY 1, 2)"
_CATALOG = """c AS (SELECT coalesce(nullif(table_schema, ''), 'public') AS table_schema, table_name, arg_max(replica_id, (lsn, relation_id)) AS code FROM relation_log GROUP BY 1, 2),
k AS (SELECT table_schema, table_name, CASE code WHEN 'd' THEN 'DEFAULT' WHEN 'f' THEN 'FULL' WHEN 'n' THEN 'NOTHING' WHEN 'i' THEN 'USING INDEX' ELSE code END AS identity FROM c),
d AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.table_schema = n.table_schema AND k.table_name = n.table_name AND k.identity IS NOT DISTINCT FROM n.x.id))"""


@_query(f"WITH {_NEWEST} SELECT file_no, record_no FROM insert_files WHERE table_name IN (SELECT table_name FROM n WHERE x.pub = 'pub_shop')")
def publication_members(spark, sf):
    """Records of the tables that a publication names now."""
    members = publication.newest_tables(table(spark, sf, "publication_tables")).filter("pub_name = 'pub_shop'")
    return publication.keep_members(table(spark, sf, "insert_files"), members, ["table_name"]).select("file_no", "record_no")


def _to_alter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = publication.newest_tables(table(spark, sf, "publication_tables"))
    return publication.identity_differences(wanted, publication.catalog_identities(table(spark, sf, "relation_log")))


@_query(f"WITH {_NEWEST}, {_CATALOG} SELECT table_schema, table_name, x.id AS replica_identity FROM d")
def replica_identity_diff(spark, sf):
    return _to_alter(spark, sf).select("table_schema", "table_name", "replica_identity")


@_query(f"""WITH {_NEWEST}, {_CATALOG}
SELECT table_schema, table_name, 'ALTER TABLE "' || table_schema || '"."' || table_name || '" REPLICA IDENTITY ' || CASE WHEN x.id = 'USING INDEX' THEN 'USING INDEX "' || x.ix || '"' ELSE x.id END AS statement FROM d""")
def replica_identity_statements(spark, sf):
    return publication.alter_statements(_to_alter(spark, sf))


@_query(f"""WITH {_NEWEST}, e AS (SELECT x, '"' || table_schema || '"."' || table_name || '"' || CASE WHEN len(x.cols) > 0 THEN ' ("' || array_to_string(x.cols, '", "') || '")' ELSE '' END AS entry FROM n)
SELECT x.pub AS pub_name, 'CREATE PUBLICATION "' || x.pub || '" FOR TABLE ' || string_agg(entry, ', ' ORDER BY entry) || ' WITH (publish = ' || chr(39) || 'insert, update, delete' || chr(39) ||
 CASE WHEN bool_or(x.part) THEN ', publish_via_partition_root = true' ELSE '' END || ')' AS statement FROM e GROUP BY 1""")
def publication_statements(spark, sf):
    return publication.create_statements(publication.newest_tables(table(spark, sf, "publication_tables")), ["INSERT", "UPDATE", "DELETE"])


@_query(f"WITH {_NEWEST} SELECT x.pub AS pub_name, string_agg(table_schema || '.' || table_name, ',' ORDER BY table_schema || '.' || table_name) AS tables FROM n GROUP BY 1")
def table_list_agg(spark, sf):
    newest = publication.newest_tables(table(spark, sf, "publication_tables"))
    return publication.table_lists(newest, ["pub_name"], qualified(F.col("table_schema"), F.col("table_name")))


@_query("SELECT '_internal._hyper_' || p_size || '_' || p_partkey || '_chunk' AS child, 'public.size_' || p_size AS root FROM part WHERE p_partkey % 7 <> 0")
def hypertable_roots(spark, sf):
    """A catalog of hypertables, one a size of parts, with a chunk for each part; some chunks are dropped."""
    part = table(spark, sf, "part")
    hyper = part.select(F.col("p_size").alias("id")).distinct().select("id", F.lit("public").alias("schema_name"), F.concat(F.lit("size_"), "id").alias("table_name"))
    chunks = part.select(F.col("p_size").alias("hypertable_id"), F.lit("_internal").alias("schema_name"), F.concat(F.lit("_hyper_"), "p_size", F.lit("_"), "p_partkey", F.lit("_chunk")).alias("table_name"), (F.col("p_partkey") % 7 == 0).alias("dropped"))
    return publication.hypertable_roots(hyper, chunks)


@_query("WITH $LOG SELECT frame_seq, max(lsn) OVER (ORDER BY frame_seq ROWS UNBOUNDED PRECEDING) AS received FROM log")
def received_position(spark, sf):
    return scan.running_max(_log(spark, sf), [], "frame_seq", F.col("lsn"), "received").select("frame_seq", "received")


@_query("SELECT event_id, epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(ts) AS latency_us FROM events")
def latency_us(spark, sf):
    return table(spark, sf, "events").select("event_id", latency_micros(F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("latency_us"))


@_query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY slot_name ORDER BY polled_at DESC, poll_id DESC) rn FROM slot_info),
p AS (SELECT slot_name, active, wal_status, ('0x'||split_part(trim(current_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(current_lsn),'/',2))::BIGINT AS cur,
 CASE WHEN regexp_full_match(restart_lsn, '\\s*[0-9A-Fa-f]+/[0-9A-Fa-f]+\\s*') THEN ('0x'||split_part(trim(restart_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(restart_lsn),'/',2))::BIGINT END AS res,
 CASE WHEN regexp_full_match(confirmed_flush_lsn, '\\s*[0-9A-Fa-f]+/[0-9A-Fa-f]+\\s*') THEN ('0x'||split_part(trim(confirmed_flush_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(confirmed_flush_lsn),'/',2))::BIGINT END AS conf FROM s WHERE rn = 1)
SELECT slot_name, active, wal_status, CASE WHEN res IS NOT NULL THEN greatest(cur - res, 0) END AS retained_wal_size, CASE WHEN conf IS NOT NULL THEN greatest(cur - conf, 0) END AS lag FROM p""")
def slot_lag(spark, sf):
    return monitor.slot_status(table(spark, sf, "slot_info")).select("slot_name", "active", "wal_status", F.col("retained_wal_size").cast("bigint").alias("retained_wal_size"), F.col("lag").cast("bigint").alias("lag"))


@_query("SELECT 'cdc_' || CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END || '_total' AS name, slot_name, 'h' AS host, count(*)::DOUBLE AS value FROM change_log GROUP BY op, slot_name")
def change_metrics(spark, sf):
    return monitor.change_metrics(table(spark, sf, "change_log"), "h")


@_query("""WITH t AS (SELECT slot_name, table_schema, table_name, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c, sum(rows_processed) AS r, min(claimed_at) AS b, max(completed_at) AS e FROM snapshot_chunks GROUP BY 1, 2, 3),
s AS (SELECT slot_name, count(*) AS tables, count(*) FILTER (WHERE n = c) AS done_tables, sum(n) AS n, sum(c) AS c, coalesce(sum(r), 0) AS r, (epoch_us(max(e)) - epoch_us(min(b))) / 1e6 AS d FROM t GROUP BY 1),
w AS (SELECT slot_name, count(DISTINCT claimed_by) AS w FROM snapshot_chunks WHERE status = 'in_progress' GROUP BY 1)
SELECT 'cdc_snapshot_' || k AS name, slot_name, 'h' AS host, v AS value FROM (
 SELECT slot_name, unnest(['in_progress','total_tables','completed_tables','total_rows','duration_seconds','total_chunks','completed_chunks','active_workers']) AS k,
  unnest([(c < n)::INT::DOUBLE, tables::DOUBLE, done_tables::DOUBLE, r::DOUBLE, d::DOUBLE, n::DOUBLE, c::DOUBLE, coalesce(w, 0)::DOUBLE]) AS v FROM s LEFT JOIN w USING (slot_name))""")
def snapshot_metrics(spark, sf):
    return monitor.snapshot_metrics(table(spark, sf, "snapshot_chunks"), "h")


_LSN_TEXT = "'\\s*[0-9A-Fa-f]+/[0-9A-Fa-f]+\\s*'"


@_query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY slot_name ORDER BY polled_at DESC, poll_id DESC) rn FROM slot_info),
p AS (SELECT slot_name, active, list_transform([restart_lsn, confirmed_flush_lsn, current_lsn], lambda x: CASE WHEN regexp_full_match(x, {_LSN_TEXT}) THEN ('0x'||split_part(trim(x),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(x),'/',2))::BIGINT END) AS x FROM s WHERE rn = 1)
SELECT 'cdc_replication_slot_slot_' || k AS name, slot_name, 'h' AS host, value FROM (SELECT slot_name, unnest(['is_active', 'confirmed_flush_lsn', 'current_lsn', 'retained_wal_size', 'lag']) AS k,
 unnest([active::INT::DOUBLE, x[2]::DOUBLE, x[3]::DOUBLE, CASE WHEN x[1] IS NOT NULL THEN greatest(x[3] - x[1], 0) END::DOUBLE, CASE WHEN x[2] IS NOT NULL THEN greatest(x[3] - x[2], 0) END::DOUBLE]) AS value FROM p)""")
def slot_metrics(spark, sf):
    return monitor.slot_metrics(table(spark, sf, "slot_info"), "h")


@_query("""SELECT 'cdc_cdc_latency_current' AS name, slot_name, 'h' AS host, arg_max(epoch_us(received_at) - epoch_us(message_time), (received_at, delivery_id)) / 1000 AS value
FROM change_log WHERE message_time IS NOT NULL AND received_at IS NOT NULL GROUP BY slot_name""")
def latency_metrics(spark, sf):
    return monitor.latency_metrics(table(spark, sf, "change_log"), "h", "cdc", "message_time", "received_at")


@_query("""SELECT 'cdc_' || CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END || '_total{slot_name="' || slot_name || '",host="h"} ' || count(*) || '.0' AS line FROM change_log GROUP BY op, slot_name""")
def metrics_text(spark, sf):
    """The counters as scrapers read them."""
    return monitor.exposition(monitor.change_metrics(table(spark, sf, "change_log"), "h"))


@_query(f"""WITH p AS (SELECT poll_id, ('0x'||split_part(trim(confirmed_flush_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(confirmed_flush_lsn),'/',2))::BIGINT AS flushed,
 ('0x'||split_part(trim(current_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(current_lsn),'/',2))::BIGINT AS cur, epoch_us(polled_at) - 946684800000000 AS t FROM slot_info
 WHERE regexp_full_match(confirmed_flush_lsn, {_LSN_TEXT}) AND regexp_full_match(current_lsn, {_LSN_TEXT}) AND polled_at IS NOT NULL)
SELECT DISTINCT poll_id, '72' || printf('%016X', cur) || printf('%016X', flushed) || printf('%016X', flushed) || printf('%016X', t) || '00' AS report FROM p""")
def status_reports(spark, sf):
    """The report that would go to the server at each poll: received, written and flushed positions and the time."""
    rows = table(spark, sf, "slot_info").select("poll_id", lsn_parse("current_lsn").alias("cur"), lsn_parse("confirmed_flush_lsn").alias("flushed"), "polled_at").dropna().distinct()
    return rows.select("poll_id", F.hex(status_report(F.col("cur"), F.col("flushed"), F.col("polled_at"))).alias("report"))


@_query("SELECT event_id, ts AS with_zone, ts AS without_zone, NULL::TIMESTAMP AS unreadable FROM events")
def timestamps_parsed(spark, sf):
    """Both layouts of time, from text made of each event's time."""
    micros, day = F.date_format("ts", "HH:mm:ss.SSSSSS"), F.date_format("ts", "yyyy-MM-dd")
    read = lambda c: parse_timestamp(c).cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", read(F.concat(day, F.lit("T"), micros, F.lit("Z"))).alias("with_zone"), read(F.concat_ws(" ", day, micros)).alias("without_zone"), read(F.concat(F.lit("x"), day)).alias("unreadable"))


@_query("SELECT delivery_id, try_cast(nullif(trim(new_decoded['id']), '') AS BIGINT) AS id, try_cast(nullif(trim(new_decoded['status']), '') AS BIGINT) AS status FROM change_log")
def nullable_numbers(spark, sf):
    value = lambda k: parse_nullable_bigint(F.try_element_at("new_decoded", F.lit(k)))
    return table(spark, sf, "change_log").select("delivery_id", value("id").alias("id"), value("status").alias("status"))


@_query("""WITH h AS (SELECT slot_name, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(slot_name, ''), lambda c: ord(c)::HUGEINT)), lambda h, b: (h * 31 + b) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT slot_name FROM slot_info WHERE slot_name IS NOT NULL))
SELECT slot_name, '`' || slot_name || '`' AS quoted, 'snapshot_only_' || slot_name AS snapshot_name, 'postgres://u:p%40w@h:5432/' || slot_name || '?replication=database' AS dsn,
 (CASE WHEN h >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT - h ELSE h END)::BIGINT AS lock_key FROM h""")
def slot_names(spark, sf):
    """What is made of a slot's or database's name."""
    names = [r[0] for r in table(spark, sf, "slot_info").filter("slot_name is not null").select("slot_name").distinct().collect()]  # a few slots a server
    rows = [(n, quote_identifier(n), snapshot_slot_name(n), dsn("h", 5432, "u", "p@w", n, {"replication": "database"}), lock_key(n)) for n in names]
    return spark.createDataFrame(rows, "slot_name string, quoted string, snapshot_name string, dsn string, lock_key bigint")


@_query("WITH $LOG SELECT frame_seq, lsn, commit_time FROM log JOIN (SELECT xid, arg_max(ts, frame_seq) AS commit_time FROM log GROUP BY xid) USING (xid) WHERE NOT (streamed AND aborted)")
def wire_roundtrip_times(spark, sf):
    """Positions of the rows and times of their commits, through encoding and decoding."""
    return _delivered(spark, sf).select(F.col("event_seq").alias("frame_seq"), F.col("lsn").cast("bigint").alias("lsn"), F.col("commit_time").cast("timestamp_ntz").alias("commit_time"))


@_query("SELECT delivery_id, try_cast(new_decoded['id'] AS INTEGER) AS id, try_cast(new_decoded['user_id'] AS INTEGER) AS user_id, try_cast(new_decoded['amount'] AS DECIMAL(10,2)) AS amount, new_decoded['status'] AS status, len(map_keys(new_decoded))::INT AS n_present FROM change_log WHERE table_name = 'shop_orders' AND new_decoded IS NOT NULL")
def typed_change_rows(spark, sf):
    log = table(spark, sf, "change_log").filter("table_name = 'shop_orders' AND new_decoded IS NOT NULL")
    typed = decode.typed_rows(log, [("id", 23, -1), ("user_id", 23, -1), ("amount", 1700, 655366), ("status", 25, -1)], image="new_decoded")
    return typed.select("delivery_id", "id", "user_id", "amount", "status", F.size("present").alias("n_present"))


@_query("SELECT delivery_id, list_sort(list_filter(map_keys(new_decoded), lambda k: k IN ('id', 'name', 'status')))::VARCHAR[] AS kept FROM change_log WHERE new_decoded IS NOT NULL")
def change_column_list(spark, sf):
    log = table(spark, sf, "change_log").filter("new_decoded IS NOT NULL")
    return log.select("delivery_id", F.sort_array(F.map_keys(publication.keep_columns(F.col("new_decoded"), ["id", "name", "status"]))).alias("kept"))


@_query("SELECT coalesce(table_schema, 'public') || '.' || table_name AS full_name, count(*) AS n FROM relation_log GROUP BY 1")
def qualified_names(spark, sf):
    return table(spark, sf, "relation_log").groupBy(qualified(F.col("table_schema"), F.col("table_name")).alias("full_name")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT relation_id, CASE replica_id WHEN 'd' THEN 'DEFAULT' WHEN 'f' THEN 'FULL' WHEN 'n' THEN 'NOTHING' WHEN 'i' THEN 'USING INDEX' ELSE replica_id END AS identity FROM relation_log")
def replica_identity_names(spark, sf):
    return table(spark, sf, "relation_log").select("relation_id", replica_identity(F.col("replica_id")).alias("identity"))


# --- transactions ------------------------------------------------------------

_ACK = "WITH $LOG, t AS (SELECT *, max(lsn) OVER (PARTITION BY xid) + 1 AS end_lsn, row_number() OVER (PARTITION BY xid ORDER BY frame_seq DESC) = 1 AS is_txn_last FROM log WHERE NOT streamed) SELECT frame_seq, xid, is_txn_last, CASE WHEN is_txn_last THEN end_lsn ELSE lsn END AS ack_lsn FROM t"


@_query("SELECT slot_name, xid, count(*) AS n, max(lsn)::BIGINT AS last_lsn FROM change_log WHERE (slot_name, xid) IN (SELECT (slot_name, xid) FROM wal_commits) GROUP BY 1, 2")
def committed_transactions(spark, sf):
    rows = replay.committed(table(spark, sf, "change_log"), table(spark, sf, "wal_commits"))
    return rows.groupBy("slot_name", "xid").agg(F.count(F.lit(1)).alias("n"), F.max("lsn").cast("bigint").alias("last_lsn"))


_COMMITTED = "WITH $LOG SELECT frame_seq, xid, op FROM log WHERE NOT (streamed AND aborted)"


_ORDER = "WITH $LOG, e AS (SELECT *, CASE WHEN streamed THEN max(frame_seq) OVER (PARTITION BY xid) ELSE frame_seq END AS emit_seq FROM log WHERE NOT (streamed AND aborted)) SELECT frame_seq, row_number() OVER (ORDER BY emit_seq, frame_seq) AS deliver_pos FROM e"


@_query("WITH $LOG, r AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY frame_seq DESC) rn FROM log) SELECT pk, value, ts FROM r WHERE rn = 1 AND op <> 'D'")
def apply_upsert(spark, sf):
    return apply.upsert(_log(spark, sf).select("pk", "value", "ts", "op", "frame_seq"), ["pk"], "frame_seq").select("pk", "value", "ts")


@_query("WITH $LOG, u AS (SELECT c_custkey AS pk, c_acctbal AS value, -1 AS frame_seq, 'r' AS op FROM customer UNION ALL SELECT pk, value, frame_seq, op FROM log WHERE lsn > 83886080000), r AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY frame_seq DESC) rn FROM u) SELECT pk, value FROM r WHERE rn = 1 AND op <> 'D'")
def snapshot_plus_cdc(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_acctbal").alias("value"))
    return apply.snapshot_then_changes(base, _log(spark, sf), ["pk"], "frame_seq", F.col("lsn") > 83886080000).select("pk", "value")


@_query("WITH $LOG SELECT pk::VARCHAR AS key, count(*) AS n, count(DISTINCT op) AS operations FROM log GROUP BY 1")
def keyed_topic(spark, sf):
    messages = apply.keyed_messages(_log(spark, sf).select("pk", "value", "op"), ["pk"])
    return messages.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("value", "$.operation")).alias("operations"))


# --- the same over encoded frames: encode, decode, assemble -------------------


@_query("SELECT kind, count(*) AS n, max(wal_end) AS top FROM (SELECT 'log' AS kind, event_id + 1 AS wal_end FROM events UNION ALL SELECT 'keepalive', event_id + 5 FROM events WHERE event_id % 100 = 0 UNION ALL SELECT 'error', NULL FROM events WHERE event_id % 50 = 1 UNION ALL SELECT 'error', NULL FROM events WHERE event_id % 50 = 2) GROUP BY 1")
def packets_split(spark, sf):
    e, hex16 = F.col("event_id"), lambda c: F.lpad(F.hex(c), 16, "0")
    log = F.concat(F.lit("77"), hex16(e), hex16(e + 1), hex16(F.lit(0)), F.hex(F.lit("E")))
    alive = F.concat(F.lit("6B"), hex16(e + 5), hex16(F.lit(0)), F.lit("01"))
    events = table(spark, sf, "events")
    packet = lambda df, text: df.select(F.lit("s").alias("slot"), e.alias("packet_seq"), F.unhex(text).alias("data"))
    packets = packet(events, log).unionByName(packet(events.filter(e % 100 == 0), alive))
    # an unknown tag, and log data cut off in its header
    packets = packets.unionByName(packet(events.filter(e % 50 == 1), F.concat(F.lit("78"), hex16(e)))).unionByName(packet(events.filter(e % 50 == 2), F.concat(F.lit("77"), hex16(e))))
    return split_packets(packets).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("wal_end").cast("bigint").alias("top"))


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    return decode.change_events(frames_of(table(spark, sf, "events"))).filter("op IN ('I', 'U', 'D')").withColumn("event_seq", F.floor(F.col("frame_seq") / ROOM).cast("bigint"))


@_query("WITH $LOG SELECT op, count(*) AS n FROM log WHERE NOT (streamed AND aborted) GROUP BY op")
def wire_roundtrip_ops(spark, sf):
    return monitor.op_counts(_delivered(spark, sf).filter("error IS NULL"))


@_query(_COMMITTED.replace("SELECT frame_seq, xid", "SELECT frame_seq, xid + 1 AS xid"))
def wire_roundtrip_committed(spark, sf):
    return _delivered(spark, sf).select(F.col("event_seq").alias("frame_seq"), "xid", "op")


@_query(_ACK.replace("frame_seq, xid, is_txn_last, CASE", "frame_seq, xid + 1 AS xid, is_txn_last, CASE"))
def wire_roundtrip_ack(spark, sf):
    plain = _delivered(spark, sf).filter("NOT streamed")
    return plain.select(F.col("event_seq").alias("frame_seq"), "xid", "is_txn_last", F.col("ack_lsn").cast("bigint").alias("ack_lsn"))


@_query(_ORDER)
def wire_roundtrip_commit_order(spark, sf):
    return assemble.delivery_order(_delivered(spark, sf)).select(F.col("event_seq").alias("frame_seq"), "deliver_pos")


@_query("""WITH $LOG SELECT frame_seq, op, CASE WHEN op = 'D' THEN pk END AS old_pk, CASE WHEN op <> 'D' THEN pk END AS new_pk, CASE WHEN op <> 'D' THEN value END AS value,
 CASE WHEN op = 'I' OR (op = 'U' AND frame_seq % 3 = 0) THEN props END AS props FROM log WHERE NOT (streamed AND aborted)""")
def wire_roundtrip_images(spark, sf):
    after = lambda k: F.try_element_at("after", F.lit(k))
    return _delivered(spark, sf).select(F.col("event_seq").alias("frame_seq"), "op", F.try_element_at("before", F.lit("id")).cast("bigint").alias("old_pk"), after("id").cast("bigint").alias("new_pk"), after("value").cast("double").alias("value"), after("props").alias("props"))


# --- the same as streams: frames in files, stateful assembly, sinks ------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Captured frames of the whole table, followed as a stream."""
    return _as_stream(spark, frames_of(table(spark, sf, "events")))


def _as_stream(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """Frames laid out in order, followed as a stream in micro-batches of some files, with transactions assembled."""
    from tidelog.sources.replication import ReplicationSource
    from tidelog.streaming.assembly import ROCKSDB, assemble_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.dataSource.register(ReplicationSource)
    folder = storage.fresh_dir(spark, "frames")
    captured = storage.materialize(frames, "captured")  # they are counted, sampled and laid out, but encoded once
    files = -(-captured.count() // 60_000)
    captured.repartitionByRange(max(1, files), "frame_seq").sortWithinPartitions("frame_seq").write.parquet(folder)
    storage.discard(captured)
    return assemble_stream(spark.readStream.format(ReplicationSource.name()).option("path", folder).option("maxFiles", "4").load())


def _until_read(spark: SparkSession, writer) -> None:
    """A source without the AvailableNow trigger is followed until it has nothing new. The frames are of one slot."""
    from tidelog.streaming.assembly import state_of

    with state_of(spark, 1):
        query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@_query(_COMMITTED.replace("SELECT frame_seq, xid", "SELECT frame_seq, xid + 1 AS xid"))
def stream_roundtrip_committed(spark, sf):
    out = storage.fresh_dir(spark, "delivered")
    _until_read(spark, _stream(spark, sf).writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.fresh_dir(spark, "stream")))
    rows = spark.read.parquet(out).filter("op IN ('I', 'U', 'D')")
    return rows.select(F.floor(F.col("frame_seq") / ROOM).cast("bigint").alias("frame_seq"), "xid", "op")


@_query("""WITH $LOG, e AS (SELECT *, CASE WHEN streamed THEN max(frame_seq) OVER (PARTITION BY xid) ELSE frame_seq END AS emit_seq FROM log WHERE NOT (streamed AND aborted)),
 r AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY emit_seq DESC, frame_seq DESC) rn FROM e) SELECT pk, value FROM r WHERE rn = 1 AND op <> 'D'""")
def stream_into_table(spark, sf):
    current = apply.CurrentTable(spark, storage.fresh_dir(spark, "table"), ["pk"], "seq")
    changes = _stream(spark, sf).filter("op IN ('I', 'U', 'D')")
    image = F.coalesce("after", "before")
    # the place in delivery: first the commit, then the frame
    seq = F.struct("emit_seq", "frame_seq")
    keyed = changes.select(F.get_json_object(image, "$.id").cast("bigint").alias("pk"), F.get_json_object(image, "$.value").cast("double").alias("value"), "op", seq.alias("seq"))
    _until_read(spark, keyed.writeStream.foreachBatch(current.apply).option("checkpointLocation", storage.fresh_dir(spark, "stream")))
    return current.rows().select("pk", "value")


# --- scenes: what a log holds besides well-behaved transactions, as a batch and as a stream ----

_SCENES = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS note FROM orders),
e(kind, step, op, own, streamed, last, old_kind, before, after, failed) AS (VALUES
  (0, 2, 'I', 1, false, false, NULL, NULL, 'i,s,n', false), (0, 3, 'U', 1, false, true, NULL, NULL, 'i,X', false),
  (1, 2, 'I', 1, false, false, NULL, NULL, 'i,s,n', false), (2, 5, 'I', 2, true, true, NULL, NULL, 'i,s,n', false),
  (3, 2, 'T', 1, false, true, NULL, NULL, NULL, false), (4, 2, 'U', 1, false, true, 'O', 'i,s,n', 'i,X,n', false),
  (5, 2, 'U', 1, false, true, 'K', 'i,0', 'i,X,0', false), (6, 3, 'I', 1, false, false, NULL, NULL, 'i,z,n', false),
  (7, 2, 'I', 1, false, false, NULL, NULL, NULL, true), (7, 3, 'D', 1, false, true, 'K', 'i,0', NULL, false)),
f AS (SELECT *, 'id=' || k AS i FROM o JOIN e ON k % 8 = kind)
SELECT k AS o_orderkey, step, op, 4*k + own AS xid, streamed, last AS is_txn_last, old_kind,
  CASE WHEN last THEN k*64 + CASE WHEN streamed THEN 41 ELSE 40 END ELSE k*64 + step END AS ack_lsn,
  CASE WHEN op <> 'T' THEN k*64 + step END AS lsn, k*64 + CASE WHEN streamed THEN 10 ELSE step END AS emit_seq,
  CASE before WHEN 'i,s,n' THEN i || ';note=' || note || ';status=' || st WHEN 'i,0' THEN i || ';note=<null>;status=<null>' END AS before,
  CASE after WHEN 'i,s,n' THEN i || ';note=' || note || ';status=' || st WHEN 'i,X' THEN i || ';status=X' WHEN 'i,X,n' THEN i || ';note=' || note || ';status=X'
    WHEN 'i,X,0' THEN i || ';note=<null>;status=X' WHEN 'i,z,n' THEN i || ';note=' || note || ';state=' || st END AS after,
  CASE WHEN op = 'T' THEN 'public.orders,oid:999' END AS truncated, CASE WHEN op = 'T' THEN true END AS cascade, CASE WHEN op = 'T' THEN k % 16 = 3 END AS restart_identity, failed
FROM f"""


def _scenes(events: DataFrame) -> DataFrame:
    """Delivered rows of the scenes, with images (maps) as sorted text."""
    entries = lambda c: F.concat_ws(";", F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>")))))
    text = lambda c: F.when(F.col(c).isNotNull(), entries(c)).alias(c)
    k = F.floor(F.col("frame_seq") / SCENE).cast("bigint")
    names = F.when(F.col("truncated").isNotNull(), F.concat_ws(",", "truncated")).alias("truncated")
    return events.filter("op <> 'R'").select(k.alias("o_orderkey"), (F.col("frame_seq") - k * SCENE).cast("int").alias("step"), "op", "xid", "streamed", "is_txn_last", "old_kind", F.col("ack_lsn").cast("bigint").alias("ack_lsn"), F.col("lsn").cast("bigint").alias("lsn"), "emit_seq", text("before"), text("after"), names, "cascade", "restart_identity", F.col("error").isNotNull().alias("failed"))


@_query(_SCENES)
def scenes_delivered(spark, sf):
    """Uncommitted and interleaved transactions, truncates, unchanged columns, tables defined anew or not at all."""
    return _scenes(decode.change_events(scenario_frames(table(spark, sf, "orders"))))


@_query(_SCENES)
def scenes_streamed(spark, sf):
    out = storage.fresh_dir(spark, "delivered")
    frames = scenario_frames(table(spark, sf, "orders"))
    _until_read(spark, _as_stream(spark, frames).writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.fresh_dir(spark, "stream")))
    image = lambda c: F.from_json(c, "map<string,string>").alias(c)
    return _scenes(spark.read.parquet(out).withColumns({"before": image("before"), "after": image("after"), "truncated": F.from_json("truncated", "array<string>")}))


@_query("""WITH e(kind, step, cols) AS (VALUES (0, 2, 'id,status,note'), (0, 3, 'id,status,note'), (1, 2, 'id,status,note'), (1, 3, 'id,status,note'), (2, 2, 'id,status,note'), (2, 5, 'id,status,note'), (2, 8, 'id,status,note'),
 (4, 2, 'id,status,note'), (5, 2, 'id,status,note'), (6, 3, 'id,state,note'), (7, 2, NULL), (7, 3, 'id,status,note')) SELECT o_orderkey, step, cols FROM orders JOIN e ON o_orderkey % 8 = kind""")
def relation_asof(spark, sf):
    """The columns of the last Relation message before each row, where tables are defined anew."""
    rows = storage.materialize(assemble.in_context(scenario_frames(table(spark, sf, "orders"))), "frames")
    named = decode.with_relation(rows.filter("tag IN ('I', 'U', 'D')"), decode.relations(rows))
    k = F.floor(F.col("frame_seq") / SCENE).cast("bigint")
    columns = F.when(F.col("relation").isNotNull(), F.concat_ws(",", "relation.columns"))
    return named.select(k.alias("o_orderkey"), (F.col("frame_seq") - k * SCENE).cast("int").alias("step"), columns.alias("cols"))


@_query(f"SELECT o_orderkey, step, after FROM ({_SCENES}) WHERE op = 'U'")
def toast_merge(spark, sf):
    """Unchanged columns under a full old row, under a key, and without any."""
    return _scenes(decode.change_events(scenario_frames(table(spark, sf, "orders")))).filter("op = 'U'").select("o_orderkey", "step", "after")


@_query(f"SELECT o_orderkey, step, old_kind, before FROM ({_SCENES}) WHERE old_kind IS NOT NULL")
def old_image(spark, sf):
    return _scenes(decode.change_events(scenario_frames(table(spark, sf, "orders")))).filter("old_kind IS NOT NULL").select("o_orderkey", "step", "old_kind", "before")


@_query(f"SELECT op, coalesce(old_kind, '-') AS old_kind, count(*) AS n, count(before) AS with_old FROM ({_SCENES}) GROUP BY 1, 2")
def replica_identity_images(spark, sf):
    rows = _scenes(decode.change_events(scenario_frames(table(spark, sf, "orders"))))
    return rows.groupBy("op", F.coalesce("old_kind", F.lit("-")).alias("old_kind")).agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("with_old"))


# --- entry points -------------------------------------------------------------


@_query("WITH $LOG SELECT op, count(*) AS n, count(*) FILTER (WHERE lsn >= 16777216000) AS later FROM log WHERE NOT (streamed AND aborted) AND op <> 'D' GROUP BY op")
def connector_follow(spark, sf):
    """A configured connector follows the slot and hands batches to a callback; deletes aren't published."""
    folder, frames = storage.fresh_dir(spark, "frames"), frames_of(table(spark, sf, "events"))
    frames.repartitionByRange(max(1, -(-frames.count() // 60_000)), "frame_seq").sortWithinPartitions("frame_seq").write.parquet(folder)
    config = from_dict({"host": "h", "username": "u", "password": "p", "database": "d", "slot": {"name": "s"}, "publication": {"name": "p", "operations": ["INSERT", "UPDATE"], "tables": [{"name": "events"}]}})
    counts: dict[str, list[int]] = {}

    def handler(batch: DataFrame, _: int) -> None:
        for r in batch.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lsn") >= LSN_STEP * 1000).alias("later")).collect():
            had = counts.get(r["op"], [0, 0])
            counts[r["op"]] = [had[0] + r["n"], had[1] + r["later"]]

    connector = Connector(spark, config, folder, checkpoint=storage.fresh_dir(spark, "stream"))
    query = connector.start(handler)
    try:
        query.processAllAvailable()
    finally:
        connector.close()
    return spark.createDataFrame([(op, *n) for op, n in counts.items()], "op string, n bigint, later bigint")


@_query("""SELECT mode, enabled, completed, again, enabled AND mode <> 'never' AND (again OR completed IS NOT TRUE) AS due
FROM (VALUES ('initial'), ('never'), ('snapshot_only')) m(mode), (VALUES (true), (false)) e(enabled), (VALUES (true), (false), (NULL)) c(completed), (VALUES (true), (false)) r(again)""")
def snapshot_due(spark, sf):
    """When a snapshot is taken, by mode and by what is on record."""
    cases = [(m, e, c, r) for m in MODES for e in (True, False) for c in (True, False, None) for r in (True, False)]
    return spark.createDataFrame([(*x, snapshot.should_snapshot(*x)) for x in cases], "mode string, enabled boolean, completed boolean, again boolean, due boolean")


@_query("""SELECT DISTINCT '7' || poll_id AS system_id, 1 AS timeline, ('0x'||split_part(trim(current_lsn),'/',1))::BIGINT*4294967296 + ('0x'||split_part(trim(current_lsn),'/',2))::BIGINT AS position, slot_name AS database
FROM slot_info WHERE regexp_full_match(current_lsn, '\\s*[0-9A-Fa-f]+/[0-9A-Fa-f]+\\s*')""")
def system_identity(spark, sf):
    """What servers say of themselves, one answer a poll."""
    said = table(spark, sf, "slot_info").select(F.concat(F.lit("7"), "poll_id").alias("systemid"), F.lit("1").alias("timeline"), F.col("current_lsn").alias("xlogpos"), F.col("slot_name").alias("dbname"))
    return monitor.system_identity(said).filter("position is not null").distinct().withColumn("position", F.col("position").cast("bigint"))


@_query("""SELECT * FROM (VALUES ('a = 1', true), ('  ', true), ('updated_at > now()', true), ('a; b', false), ('a -- b', false), ('a /* b', false), ('a = $$x$$', false), ('x = ''drop''', false), ('DO', false), ('a OR Delete', false), ('dropped = 1', true), ('a = 1 AND created > 2', true)) t(condition, safe)""")
def conditions_checked(spark, sf):
    """Which row conditions are let through."""

    def safe(condition: str) -> bool:
        try:
            publication.check_condition(condition)
            return True
        except publication.UnsafeCondition:
            return False

    texts = ["a = 1", "  ", "updated_at > now()", "a; b", "a -- b", "a /* b", "a = $$x$$", "x = 'drop'", "DO", "a OR Delete", "dropped = 1", "a = 1 AND created > 2"]
    return spark.createDataFrame([(c, safe(c)) for c in texts], "condition string, safe boolean")


@_query("""SELECT id, 'SELECT * FROM "' || table_schema || '"."' || table_name || '"' || CASE partition_strategy
  WHEN 'integer_range' THEN CASE WHEN range_start IS NOT NULL THEN ' WHERE "id" BETWEEN ' || range_start || ' AND ' || range_end ELSE '' END
  WHEN 'ctid_block' THEN ' WHERE ctid >= ' || chr(39) || '(' || block_start || ',0)' || chr(39) || '::tid' || CASE WHEN block_end IS NOT NULL AND NOT is_last_chunk THEN ' AND ctid < ' || chr(39) || '(' || block_end || ',0)' || chr(39) || '::tid' ELSE '' END
  ELSE ' ORDER BY "id" LIMIT ' || chunk_size || ' OFFSET ' || chunk_start END AS query FROM snapshot_chunks""")
def chunk_queries(spark, sf):
    """What each chunk on record asks of the server, for Spark's JDBC source."""
    spec = lambda c: snapshot.TableSpec(c["table_name"], c["table_schema"], key=("id",))
    chunks = table(spark, sf, "snapshot_chunks").select("id", "table_schema", "table_name", "partition_strategy", "range_start", "range_end", "block_start", "block_end", "is_last_chunk", "chunk_start", "chunk_size")

    def ask(batches):
        for frame in batches:
            rows = [{k: None if pd.isna(v) else int(v) if isinstance(v, float) else v for k, v in r.items()} for r in frame.to_dict("records")]
            yield pd.DataFrame({"id": frame["id"], "query": [statements.chunk_query(spec(r), r) for r in rows]})

    return chunks.mapInPandas(ask, "id int, query string")
