"""Consistent chunked snapshots: planning, reading, markers, job state."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from itertools import accumulate

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidelog.functions.naming import ceil_div, quote_identifier
from tidelog.operators import scan
from tidelog.operators.publication import both_conditions, filter_rows, select_columns

RANGE, BLOCK, OFFSET = "integer_range", "ctid_block", "offset"
DEFAULT_ROWS_PER_BLOCK = 100

CHUNK_COLUMNS = {
    "id": "int", "slot_name": "string", "table_schema": "string", "table_name": "string", "snapshot_lsn": "decimal(20,0)", "chunk_index": "int", "chunk_start": "bigint", "chunk_size": "bigint",
    "range_start": "bigint", "range_end": "bigint", "block_start": "bigint", "block_end": "bigint", "is_last_chunk": "boolean", "partition_strategy": "string", "status": "string", "claimed_by": "string",
    "claimed_at": "timestamp_ntz", "heartbeat_at": "timestamp_ntz", "completed_at": "timestamp_ntz", "rows_processed": "bigint",
}


# --- planning ----------------------------------------------------------------


def choose_strategy(schema: T.StructType, key: list[str], wanted: str | None = None) -> str:
    """The strategy asked for (blank and ``auto`` ask for none); else ranges for a single integer key, else blocks."""
    if wanted and wanted != "auto":
        if wanted not in (RANGE, BLOCK, OFFSET):
            raise ValueError(f"unknown partition strategy {wanted!r}")
        return wanted
    whole = (T.ShortType, T.IntegerType, T.LongType)
    return RANGE if len(key) == 1 and isinstance(schema[key[0]].dataType, whole) else BLOCK


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """(lo, hi) of the key; any row filter is left out on purpose, so that bounds don't depend on it."""
    return df.agg(F.min(F.col(key).cast("bigint")).alias("lo"), F.max(F.col(key).cast("bigint")).alias("hi"))


def range_chunks(bounds: DataFrame, size: int) -> DataFrame:
    """(chunk_index, range_start, range_end): inclusive ranges, the last one clipped; one open chunk for an empty table."""
    return _range_chunks(bounds, size).drop("is_last_chunk")


def _range_chunks(bounds: DataFrame, size: int) -> DataFrame:
    n = F.when(F.col("lo").isNull(), F.lit(1).cast("bigint")).otherwise(ceil_div(F.col("hi") - F.col("lo") + 1, size))
    i = F.col("chunk_index")
    chunks = bounds.select("lo", "hi", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_index"))
    # least() skips nulls, so an empty table's range is kept null by its start
    end = F.when(F.col("lo").isNotNull(), F.least(F.col("lo") + i * size + (size - 1), "hi"))
    return chunks.select("chunk_index", (F.col("lo") + i * size).alias("range_start"), end.alias("range_end"), (i == F.col("n") - 1).alias("is_last_chunk"))


def blocks_of(rows: DataFrame, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """(blocks): files have no physical blocks; a block is so many rows."""
    return rows.agg(ceil_div(F.count(F.lit(1)), max(1, rows_per_block)).alias("blocks"))


def block_chunks(blocks: DataFrame, size: int, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """(chunk_index, block_start, block_end, is_last_chunk): whole blocks; the last chunk is open at its end."""
    per = max(1, size // max(1, rows_per_block))
    n = F.greatest(ceil_div(F.col("blocks"), per), F.lit(1))
    chunks = blocks.select(n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_index"))
    last = F.col("chunk_index") == F.col("n") - 1
    return chunks.select("chunk_index", (F.col("chunk_index") * per).alias("block_start"), F.when(~last, (F.col("chunk_index") + 1) * per).alias("block_end"), last.alias("is_last_chunk"))


def offset_chunks(counted: DataFrame, size: int) -> DataFrame:
    """(chunk_index, chunk_start) from (rows): chunks of so many rows in key order; one for an empty table."""
    n = F.greatest(ceil_div(F.col("rows"), size), F.lit(1))
    return counted.select(F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_index")).withColumn("chunk_start", F.col("chunk_index") * size)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: str = "public"
    key: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    condition: str | None = None
    strategy: str | None = None


def plan_chunks(df: DataFrame, spec: TableSpec, size: int, slot: str, lsn: int, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Chunk rows of one table as they are kept in the job's metadata, all pending."""
    strategy = choose_strategy(df.schema, list(spec.key), spec.strategy)
    if strategy == RANGE:
        chunks = _range_chunks(key_bounds(df, spec.key[0]), size)
    elif strategy == BLOCK:
        chunks = block_chunks(blocks_of(df, rows_per_block), size, rows_per_block)
    else:
        chunks = offset_chunks(filter_rows(df, spec.condition).agg(F.count(F.lit(1)).alias("rows")), size)
    fixed = {"slot_name": slot, "table_schema": spec.schema, "table_name": spec.name, "snapshot_lsn": lsn, "chunk_size": size, "partition_strategy": strategy, "status": "pending"}
    row = chunks.withColumn("chunk_start", F.col("chunk_index") * size)
    have = set(row.columns)
    return row.select(*((F.col(n) if n in have else F.lit(fixed.get(n))).cast(t).alias(n) for n, t in CHUNK_COLUMNS.items()))


# --- reading -----------------------------------------------------------------


def chunk_condition(spec: TableSpec, chunk: dict) -> str | None:
    """The rows of a range chunk as the text of a condition: the table's own one and the range. Also for readers that take SQL."""
    if chunk.get("range_start") is None:
        return spec.condition
    return both_conditions(spec.condition, f"{quote_identifier(spec.key[0])} BETWEEN {chunk['range_start']:d} AND {chunk['range_end']:d}")


def _in_order(df: DataFrame, key: tuple[str, ...]) -> list[Column]:
    """An order that only identical rows leave open: the key, then all other columns (maps, which have no order, as JSON)."""
    rest = [f for f in df.schema if f.name not in key]
    return [*(F.col(f"`{k}`") for k in key), *(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rest)]


def _in_files(df: DataFrame) -> bool:
    try:
        return "_metadata" not in df.columns and bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def block_rows(df: DataFrame, key: tuple[str, ...], first: int, end: int | None) -> DataFrame:
    """Rows at positions ``first`` (inclusive) to ``end`` (exclusive; none: to the last row).

    Rows of files stand in order of path and place in the file, and only the files
    that the positions lie in are read. Other rows are sorted by the key and, as
    far as that leaves an order open, by their other columns.
    """
    if not _in_files(df):
        rows = df.orderBy(*_in_order(df, key)).offset(first)
        return rows if end is None else rows.limit(end - first)
    path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.select(path.alias("path"), at.alias("at")).groupBy("path").agg((F.max("at") + 1).alias("n")).orderBy("path").collect()
    wanted, start = F.lit(False), 0
    for file in files:
        lo, hi = max(first, start) - start, file["n"] if end is None else min(end - start, file["n"])
        if lo < hi:
            wanted = wanted | ((path == file["path"]) & (at >= lo) & (at < hi))
        start += file["n"]
    return df.filter(wanted)


def read_chunk(df: DataFrame, spec: TableSpec, chunk: dict, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Rows of one chunk. Ranges reach the scan as filters; offsets sort by the key.

    Blocks are positions in the table before its condition; ``rows_per_block`` is the one they were planned with.
    """
    kind = chunk.get("partition_strategy")
    kind = kind if kind in (RANGE, BLOCK) else OFFSET  # what isn't known is read by offset
    if kind == BLOCK and chunk.get("block_start") is not None:
        per = max(1, rows_per_block)
        last = chunk.get("block_end") is None or chunk.get("is_last_chunk")
        df = block_rows(df, spec.key, chunk["block_start"] * per, None if last else chunk["block_end"] * per)
    kept = filter_rows(df, chunk_condition(spec, chunk) if kind == RANGE else spec.condition)
    if kind == OFFSET:
        kept = kept.orderBy(*_in_order(kept, spec.key)).offset(chunk["chunk_start"]).limit(chunk["chunk_size"])
    return select_columns(kept, list(spec.columns))


def with_chunk(df: DataFrame, key: str, lo: Column, size: int) -> DataFrame:
    """Every row with the index of the range chunk that it belongs to: a whole table is read in one pass."""
    return df.withColumn("chunk_index", F.floor((F.col(key) - lo) / F.lit(size)).cast("bigint"))


def mark_last(df: DataFrame, chunk: str | list[str], key: str, size: int) -> DataFrame:
    """Adds ``is_last``: the last row of each chunk that isn't full. A chunk is one bounded window."""
    w = Window.partitionBy(chunk)
    return df.withColumn("is_last", (F.row_number().over(w.orderBy(F.desc(key))) == 1) & (F.count(F.lit(1)).over(w) < size))


def data_events(rows: DataFrame, spec: TableSpec, slot: str, lsn: int) -> DataFrame:
    """Snapshot rows as change events of kind ``r``, with text values by column name."""
    columns = [c for c in rows.columns if c not in ("__chunk", "__last")]
    image = F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in columns)))
    key = F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in spec.key)) if spec.key else F.lit(None).cast("string")
    marked = "__chunk" in rows.columns
    extra = [F.col("__last").alias("is_last") if marked else F.lit(False).alias("is_last"), F.col("__chunk").cast("int").alias("chunk_index") if marked else F.lit(None).cast("int").alias("chunk_index")]
    return rows.select(F.lit(slot).alias("slot_name"), F.lit("DATA").alias("event_type"), F.lit("r").alias("op"), F.lit(spec.schema).alias("table_schema"), F.lit(spec.name).alias("table_name"), F.lit(lsn).cast("decimal(20,0)").alias("lsn"), key.alias("row_key"), image.alias("row_data"), *extra)


def markers(spark: SparkSession, slot: str, lsn: int) -> tuple[DataFrame, DataFrame]:
    """BEGIN and END events around a snapshot's rows."""
    kind = "slot_name string, event_type string, op string, table_schema string, table_name string, lsn decimal(20,0), row_key string, row_data map<string,string>, is_last boolean, chunk_index int"
    one = lambda e: spark.createDataFrame([(slot, e, e, None, None, Decimal(lsn), None, None, False, None)], kind)
    return one("BEGIN"), one("END")


def _positions(df: DataFrame, out: str) -> DataFrame:
    """Adds the row's position: as ``block_rows`` has it for rows of files, else in the order in which tasks read."""
    if not _in_files(df):
        return df.withColumn(out, F.monotonically_increasing_id())
    path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.select(path.alias("__path"), at.alias("at")).groupBy("__path").agg((F.max("at") + 1).alias("n")).orderBy("__path").collect()
    starts = [0, *accumulate(f["n"] for f in files)]
    if len(files) < 2:
        return df.withColumn(out, at)
    # a local table has a size that Spark knows, so that rows don't move for a short one
    start = df.sparkSession.createDataFrame(pa.table({"__path": [f["__path"] for f in files], "__start": pa.array(starts[:-1], pa.int64())}))
    return df.select("*", path.alias("__path"), at.alias("__row")).join(start, "__path").withColumn(out, F.col("__start") + F.col("__row")).drop("__path", "__row", "__start")


def _stretches(numbers: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    out: list[list[int]] = []
    for n in sorted({*numbers}):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


def _in_chunks(df: DataFrame, spec: TableSpec, size: int, rows_per_block: int, only: list[int] | None) -> DataFrame:
    """Rows with ``__chunk``, and ``__at``, by which a chunk's rows are in order."""
    strategy = choose_strategy(df.schema, list(spec.key), spec.strategy)
    wanted = [*dict.fromkeys([*spec.columns, *spec.key])] if spec.columns else df.columns
    if strategy == RANGE:
        first, width = key_bounds(df, spec.key[0]).first()["lo"] or 0, size
        rows = filter_rows(df, spec.condition)
        at = F.col(f"`{spec.key[0]}`").cast("bigint")
    elif strategy == BLOCK:
        per = max(1, rows_per_block)
        first, width = 0, max(1, size // per) * per
        rows, at = filter_rows(_positions(df, "__at"), spec.condition), F.col("__at")
    else:  # offsets count the rows of one order
        kept = filter_rows(df, spec.condition)
        first, width = 0, size
        rows, at = scan.numbered(kept, _in_order(kept, spec.key), "__at"), F.col("__at")
    if only is not None:
        inside = F.lit(False)
        place = F.col(f"`{spec.key[0]}`") if strategy == RANGE else at  # without a cast, so that the scan can filter
        for a, b in _stretches(only):
            inside = inside | place.between(first + a * width, first + (b + 1) * width - 1)
        rows = rows.filter(inside)
    rows = select_columns(rows.withColumn("__at", at), [*wanted, "__at"])
    return rows.withColumn("__chunk", F.floor((F.col("__at") - F.lit(first)) / F.lit(width)).cast("bigint"))


def chunk_rows(df: DataFrame, spec: TableSpec, size: int, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK, only: list[int] | None = None) -> DataFrame:
    """The table's rows and columns for the snapshot, with ``__chunk`` and ``__last``, by the chunks that would be planned.

    All chunks, or those with the numbers in ``only``, are read in one pass; ranges of the key reach the scan as filters.
    """
    rows = _in_chunks(df, spec, size, rows_per_block, only)
    return mark_last(rows, "__chunk", "__at", size).withColumnRenamed("is_last", "__last").drop("__at")


#: Chunks that lie in one folder, and chunks of a table that are laid out in one pass.
GROUP, STRETCH = 32, 10_016


def lay_out(df: DataFrame, spec: TableSpec, size: int, folder: str, only: list[int], rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> dict:
    """Write the rows of ``chunk_rows`` by groups of chunks; gives their schema and the rows of each chunk.

    However few chunks are claimed at a time, the table is read once a stretch.
    Blocks of files lie in order already, so their rows stay where they are read.
    """
    rows = _in_chunks(df, spec, size, rows_per_block, only).withColumn("__group", F.floor(F.col("__chunk") / GROUP).cast("int"))
    if choose_strategy(df.schema, list(spec.key), spec.strategy) == BLOCK and _in_files(df):
        ends = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n"), F.max("__at").alias("end")).filter(F.col("n") < size).collect()  # one row a chunk
        last = df.sparkSession.createDataFrame(pa.table({"__at": pa.array([c["end"] for c in ends], pa.int64()), "__last": pa.array([True] * len(ends), pa.bool_())}))
        rows = rows.join(last, "__at", "left").withColumn("__last", F.coalesce("__last", F.lit(False)))
    else:
        rows = mark_last(rows.repartition("__group"), ["__group", "__chunk"], "__at", size).withColumnRenamed("is_last", "__last")
    rows = rows.drop("__at")
    rows.write.partitionBy("__group").parquet(folder)
    schema = rows.drop("__group").schema
    written = df.sparkSession.read.schema(rows.schema).parquet(folder)
    return {"schema": schema.jsonValue(), "rows": {str(c): n for c, n in written.groupBy("__chunk").count().collect()}}  # one row a chunk


def laid_rows(spark: SparkSession, laid: dict, numbers: list[int]) -> DataFrame:
    """The rows of some chunks from what ``lay_out`` wrote."""
    kind = T.StructType.fromJson(laid["schema"])
    groups = sorted({n // GROUP for n in numbers if str(n) in laid["rows"]})
    if not groups:
        return spark.createDataFrame([], kind)
    wanted = " OR ".join(f"__chunk BETWEEN {a} AND {b}" for a, b in _stretches(numbers))
    return spark.read.schema(kind).parquet(*(f"{laid['folder']}/__group={g}" for g in groups)).filter(wanted)




def take_snapshot(tables: dict[str, DataFrame], specs: list[TableSpec], slot: str, lsn: int, *, general_condition: str | None = None, size: int = 8000, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """All rows of all tables as one stream of events between markers.

    Parquet files never change, so all tasks see one state. Each table is scanned
    once with its filter and columns pushed down (and once for its bounds), and its
    rows meet by chunks of ``size`` to mark the last one of each that isn't full.
    ``tables`` goes by full name, or by the bare one where that is unique.
    """
    spark = next(iter(tables.values())).sparkSession
    begin, end = markers(spark, slot, lsn)
    out = begin
    for spec in specs:
        spec = spec if spec.condition else replace(spec, condition=general_condition)
        out = out.unionByName(data_events(chunk_rows(table_of(tables, spec), spec, size, rows_per_block), spec, slot, lsn))
    return out.unionByName(end)


def table_of(tables: dict[str, DataFrame], spec: TableSpec) -> DataFrame:
    return tables[full] if (full := f"{spec.schema}.{spec.name}") in tables else tables[spec.name]


# --- job state ---------------------------------------------------------------


def completion(chunks: DataFrame, by: list[str], done: Column) -> DataFrame:
    """(total, completed, done): a job is done if it has chunks and all of them are completed."""
    g = chunks.groupBy(*by) if by else chunks.groupBy()
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed")).withColumn("done", (F.col("total") > 0) & (F.col("total") == F.col("completed")))


def progress(chunks: DataFrame, by: list[str], done: Column) -> DataFrame:
    """(chunks, pct) of each group."""
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(done).alias("__done")).select(*by, "chunks", F.round(100.0 * F.col("__done") / F.nullif(F.col("chunks"), F.lit(0)), 2).cast("double").alias("pct"))


def claimable(status: Column, heartbeat: Column, now: Column, timeout_seconds: float) -> Column:
    """Pending chunks, and those in progress whose worker hasn't been heard of for too long."""
    stale = (status == "in_progress") & (F.coalesce(F.unix_micros(heartbeat.cast("timestamp")), F.lit(0)) < F.unix_micros(now.cast("timestamp")) - F.lit(int(timeout_seconds * 1e6)))
    return (status == "pending") | stale


def next_claims(chunks: DataFrame, free: Column, slot: str, index: str) -> DataFrame:
    """(slot, chunk_index): the claimable chunk with the smallest index, of each slot."""
    return chunks.filter(free).groupBy(F.col(slot).alias("slot")).agg(F.min(index).alias("chunk_index"))


def job_of(chunks: DataFrame) -> DataFrame:
    """Job rows from chunk rows."""
    agg = completion(chunks, ["slot_name", "snapshot_lsn"], F.col("status") == "completed")
    return agg.select("slot_name", "snapshot_lsn", F.col("done").alias("completed"), F.col("total").cast("int").alias("total_chunks"), F.col("completed").cast("int").alias("completed_chunks"))


def without_slot(metadata: DataFrame, slot: str) -> DataFrame:
    """Metadata after a slot's job was cleaned up for a new snapshot; other slots stay."""
    return metadata.filter(~F.col("slot_name").eqNullSafe(slot))


def migrate_chunks(old: DataFrame) -> DataFrame:
    """Old chunk metadata with the columns of today; what it lacks is null. Done twice it changes nothing."""
    have = set(old.columns)
    return old.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in CHUNK_COLUMNS.items()))


def primary_keys(relations: DataFrame) -> DataFrame:
    """(table_schema, table_name, key_columns): the key of each table by its newest Relation message, in column order; empty without one."""
    schema = F.coalesce(F.nullif(F.col("table_schema"), F.lit("")), F.lit("public"))
    newest = relations.filter("table_name is not null and column_list is not null").groupBy(schema.alias("table_schema"), "table_name").agg(F.max_by("column_list", F.struct("lsn", "relation_id")).alias("columns"))
    return newest.select("table_schema", "table_name", F.transform(F.filter("columns", lambda c: c["flags"] == 1), lambda c: c["name"]).alias("key_columns"))


def should_snapshot(mode: str, enabled: bool, job_completed: bool | None, resnapshot: bool = False) -> bool:
    """``never`` takes none; ``initial`` and ``snapshot_only`` take one unless a completed job is on record."""
    if not enabled or mode == "never":
        return False
    return resnapshot or not job_completed
