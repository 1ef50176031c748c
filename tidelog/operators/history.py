"""Full history of rows whose attributes change: insert-only satellites.

The attributes of a table are split into satellites by how often they change
(``change_rates``: distinct values a row, over all data). Each satellite holds one
row for each change of its own attributes: a row is appended only if its hash-diff
over those attributes differs from that of the row before it (within a task the
attributes themselves are compared, which comes to the same), so a table with one
busy attribute doesn't store the others again and again. Nothing is ever updated;
when a version ended follows from the next row (``with_end_times``, by ``lead``).
A delete, or an update that moves the row to another key, appends a closing row.

``satellite_rows`` gets there with the ordered replay of tidelog.operators.replay:
events are shuffled by row, sorted by sequence, and walked by a state machine that
knows the row's attributes. Rows with very many changes are cut into slices; a
first pass folds each slice, and each slice then starts from the fold of all
slices before it.

Defined cases: an insert always opens a version, also of a row that existed or was
deleted before; an update that alters nothing opens none; null is a value and
differs from an absent (unchanged) column; a first change that is an update is
compared with its full old image if it has one and opens a version otherwise;
repeated deliveries count once, with the time of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelog import storage
from tidelog.operators import replay
from tidelog.operators.replay import CARRY, DROP, PUT

FAST, SLOW = "fast", "slow"


def change_rates(change_log: DataFrame) -> DataFrame:
    """(table_name, column_name, rate): distinct values a row of each column, from sketches over all rows.

    The sketches merge map-side, so only (tables x columns) of them are shuffled.
    """
    entries = change_log.select("table_name", "row_key", F.explode("new_decoded").alias("column_name", "value"))
    sketch = lambda *c: F.approx_count_distinct(F.xxhash64(*c), 0.02)
    return entries.groupBy("table_name", "column_name").agg((sketch("row_key", F.col("value").isNull(), "value") / F.greatest(sketch("row_key"), F.lit(1))).alias("rate"))


def split_by_rate(rates: DataFrame, key_columns: dict[str, list[str]], fast_from: float = 1.5) -> dict[str, dict[str, str]]:
    """Table -> column -> satellite. Key columns identify the row and are in none. (Tables x columns: metadata.)"""
    out: dict[str, dict[str, str]] = {}
    for r in rates.collect():
        if r["table_name"] is not None and r["column_name"] not in key_columns.get(r["table_name"], ["id"]):
            out.setdefault(r["table_name"], {})[r["column_name"]] = FAST if r["rate"] >= fast_from else SLOW
    return out


_WALKED = "table_name string, row_key string, satellite string, slice int, lsn bigint, valid_from timestamp_ntz, attrs map<string,string>, opens_version boolean, closed boolean"
_WALKED_ARROW = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("satellite", pa.string()), ("slice", pa.int32()), ("lsn", pa.int64()), ("valid_from", pa.timestamp("us")), ("attrs", pa.map_(pa.string(), pa.string())), ("opens_version", pa.bool_()), ("closed", pa.bool_())])


def hash_diff(attrs: Column) -> Column:
    """MD5 of the attributes in order of name, each with its length, so that no two sets of attributes look alike; null for none."""
    sized = lambda c: F.concat(F.length(c), F.lit(":"), c)
    entries = F.transform(F.array_sort(F.map_keys(attrs)), lambda k: F.concat(sized(k), F.lit("="), F.coalesce(sized(attrs[k]), F.lit("-"))))
    return F.when(attrs.isNotNull(), F.md5(F.array_join(entries, ";")))


def _walker(split: dict[str, dict[str, str]]):
    """The state machine over events in order; one output row for each satellite row."""
    parts = {t: sorted({*cols.values()}) or [SLOW] for t, cols in split.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # known: nothing yet (0), the row is there (1) or gone (2); own: its attributes by satellite
        group, known, own, last, out = None, 0, {}, None, []
        of, names = {}, [SLOW]

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(_WALKED_ARROW.types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=_WALKED_ARROW)

        def parted(cols: dict) -> dict[str, dict]:
            new: dict[str, dict] = {s: {} for s in names}
            for k, v in cols.items():
                if (s := of.get(k)) is not None:
                    new[s][k] = v
            return new

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = [col[n].to_pylist() for n in ("table_name", "row_key", "slice", "seq", "kind")]
            times = col["message_time"].cast(pa.int64()).to_pylist()
            for table, key, part, seq, kind, new, old, full, time in zip(*lists, replay.map_lists(col["cols"]), replay.map_lists(col["old_decoded"]), col["full_old"].to_pylist(), times):
                if group != (table, key, part):
                    group, known, own, last = (table, key, part), 0, {}, None
                    of, names = split.get(table, {}), parts.get(table, [SLOW])
                if kind == CARRY:
                    known, own = (2, {}) if full else (1, parted(new))
                    continue
                if last is not None and (seq, kind) <= last:
                    continue
                last = (seq, kind)
                if kind == DROP:
                    if known != 2:
                        out.extend((table, key, s, part, seq, time, None, False, True) for s in names)
                    known, own = 2, {}
                    continue
                fresh = kind == PUT or known == 2
                if not fresh and known == 0:
                    if full:  # not seen before, but the old image is whole
                        own = parted(old)
                    else:
                        fresh = True
                if fresh:
                    own = parted(new)
                    out.extend((table, key, s, part, seq, time, list(own[s].items()), i == 0, False) for i, s in enumerate(names))
                else:
                    first = True
                    for s, changed in parted(new).items():
                        was = own[s]
                        if any(k not in was or was[k] != v for k, v in changed.items()):
                            own[s] = {**was, **changed}
                            out.append((table, key, s, part, seq, time, list(own[s].items()), first, False))
                            first = False
                known = 1
            if len(out) >= 4096:
                yield flush()
        if out:
            yield flush()

    return walk


def _ready_events(change_log: DataFrame, commits: DataFrame, key_columns: dict[str, list[str]], hot_rows: int, known: DataFrame | None = None) -> DataFrame:
    """Events in order for the walker. ``known`` (table_name, row_key, seq, gone, cols) is what earlier runs left of the rows concerned."""
    counts = replay.profile(change_log, key_columns).persist()
    try:
        hot, widths = replay.hot_rows_of(change_log, counts, hot_rows), replay.widths_of(counts, whole=known is None)
    finally:
        counts.unpersist()
    empty, none, zero = F.create_map().cast("map<string,string>"), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    full = (F.col("old_kind") == "O") & F.col("old_decoded").isNotNull()
    # the old image only matters where it is whole
    log = change_log.withColumns({"full_old": F.coalesce(full, F.lit(False)), "old_image": F.when(full, F.col("old_decoded")).otherwise(empty)})
    # slices are told before the shuffles, so that what only concerns hot rows shuffles only those
    events = replay.sliced(replay.row_events(log, key_columns, ["slot_name", "xid", "message_time", "full_old", "old_image"]), hot)
    events = replay.committed(events, commits).drop("slot_name", "xid")
    if known is not None:
        # to moves and slices a known row is a row put earlier; the walker is told that it isn't news
        before = known.select("table_name", "row_key", F.lit(0).alias("slice"), "seq", F.when(F.col("gone"), DROP).otherwise(PUT).alias("kind"), "cols", none.alias("moved_from"), F.lit(-1).cast("bigint").alias("tie"), F.lit(None).cast("timestamp_ntz").alias("message_time"), F.lit(False).alias("full_old"), empty.alias("old_image"))
        events = events.unionByName(replay.sliced(before, hot))
    events = replay.complete_moves(events, widths, hot).withColumnRenamed("old_image", "old_decoded")
    if hot is not None:
        carry = replay.carried(events).select("table_name", "row_key", "slice", "seq", F.lit(CARRY).alias("kind"), "cols", none.alias("moved_from"), zero.alias("tie"), F.lit(None).cast("timestamp_ntz").alias("message_time"), (F.col("last_kind") == DROP).alias("full_old"), empty.alias("old_decoded"))
        events = events.unionByName(carry)
    if known is not None:
        told = F.col("tie") == -1
        events = events.withColumns({"full_old": F.when(told, F.col("kind") == DROP).otherwise(F.col("full_old")), "kind": F.when(told, CARRY).otherwise(F.col("kind"))})
    return replay.in_order(events).select("table_name", "row_key", "slice", "seq", "kind", "cols", "message_time", "full_old", "old_decoded")


def satellite_rows(change_log: DataFrame, commits: DataFrame, key_columns: dict[str, list[str]], *, split: dict[str, dict[str, str]] | None = None, fast_from: float = 1.5, hot_rows: int = 50_000) -> DataFrame:
    """All satellite rows; see the module's text. ``opens_version`` marks one row a version."""
    split = split if split is not None else split_by_rate(change_rates(change_log), key_columns, fast_from)
    return _ready_events(change_log, commits, key_columns, hot_rows).mapInArrow(_walker(split), _WALKED).withColumn("hash_diff", hash_diff(F.col("attrs")))


# --- kept and appended to ------------------------------------------------------


class Satellites:
    """Satellite rows on record under a path of their own; each batch of changes appends to them.

    A column's satellite is chosen by the first batch that holds it and stays: one
    that changes its pace later keeps its place. Of the rows on record a batch only
    uses the newest of each satellite of the rows that it touches.

    Changes that lie before what is on record of their row can't be appended: they
    come back from ``append``, and ``satellite_rows`` over the log rebuilds their rows.
    Repeats of changes on record are left out of that; those of changes that altered
    nothing, and so left no row, can't be told from late ones and come back too.
    """

    def __init__(self, spark: SparkSession, path: str, key_columns: dict[str, list[str]], *, fast_from: float = 1.5, hot_rows: int = 50_000):
        self.spark, self.path, self.key_columns, self.fast_from, self.hot_rows = spark, path.rstrip("/"), key_columns, fast_from, hot_rows

    def _head(self) -> dict:
        v = max((int(n[1:]) for n in storage.children(self.spark, self.path) if n[0] == "V" and n[1:].isdigit()), default=0)
        return json.loads(storage.read_text(self.spark, f"{self.path}/V{v}")) if v else {"version": 0, "parts": [], "split": None}

    def rows(self) -> DataFrame:
        parts = self._head()["parts"]
        kind = f"{_WALKED}, hash_diff string".replace("slice int", "slice bigint")
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], kind)

    def append(self, changes: DataFrame, commits: DataFrame) -> DataFrame:
        """Add the rows that a batch of committed changes makes; the changes that came too late, if any."""
        head = self._head()
        split = split_by_rate(change_rates(changes), self.key_columns, self.fast_from)
        for table, columns in (head["split"] or {}).items():
            split[table] = {**split.get(table, {}), **columns}
        old_key = replay.key_from(F.col("old_decoded"), F.col("table_name"), self.key_columns)
        batch = storage.materialize(changes.withColumn("__old_key", F.when(F.col("op") == "U", old_key)), "batch")
        keys = batch.select("table_name", F.explode(F.array_distinct(F.array("row_key", F.coalesce("__old_key", "row_key")))).alias("row_key")).distinct()
        newest = self.rows().join(keys, ["table_name", "row_key"], "left_semi").groupBy("table_name", "row_key", "satellite").agg(F.max("lsn").alias("lsn"), F.max_by(F.struct("closed", "attrs"), F.struct("lsn", ~F.col("closed"))).alias("r"))
        merged = F.aggregate(F.collect_list(F.coalesce("r.attrs", F.create_map().cast("map<string,string>"))), F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(a, b))
        known = storage.materialize(newest.groupBy("table_name", "row_key").agg(F.max("lsn").alias("seq"), F.bool_or("r.closed").alias("gone"), merged.alias("cols")), "known")
        at = F.col("lsn").cast("bigint")
        here = known.select("table_name", "row_key", F.col("seq").alias("__here"))
        there = known.select("table_name", F.col("row_key").alias("__old_key"), F.col("seq").alias("__there"))
        placed = batch.join(here, ["table_name", "row_key"], "left").join(there, ["table_name", "__old_key"], "left")
        ahead = (at > F.coalesce("__here", at - 1)) & (at > F.coalesce("__there", at - 1))
        fresh = placed.filter(F.coalesce(ahead, F.lit(True))).drop("__old_key", "__here", "__there")
        number = head["version"] + 1
        part = f"part-{number}-{uuid.uuid4().hex}"
        events = _ready_events(fresh, commits, self.key_columns, self.hot_rows, known)
        # slices of later batches follow those of earlier ones
        place = F.shiftleft(F.lit(number).cast("bigint"), 32) + F.col("slice")
        events.mapInArrow(_walker(split), _WALKED).withColumns({"slice": place, "hash_diff": hash_diff(F.col("attrs"))}).write.parquet(f"{self.path}/{part}")
        if not storage.put_text(self.spark, f"{self.path}/V{number}", json.dumps({"version": number, "parts": [*head["parts"], part], "split": split})):
            storage.delete(self.spark, f"{self.path}/{part}")
            raise RuntimeError(f"{self.path}: another batch was appended since this one began")
        on_record = self.rows().select("table_name", "row_key", "lsn").distinct()
        late = replay.committed(placed.filter(~ahead), commits).drop("__old_key", "__here", "__there")
        return late.join(on_record, [late["table_name"] == on_record["table_name"], late["row_key"] == on_record["row_key"], late["lsn"].cast("bigint") == on_record["lsn"]], "left_anti")


def opened_versions(satellites: DataFrame) -> DataFrame:
    """(table_name, row_key, lsn) of every version, named by the change that opened it."""
    return satellites.filter("opens_version").select("table_name", "row_key", "lsn")


def with_end_times(satellites: DataFrame) -> DataFrame:
    """The view with ``valid_to``: the time of the satellite's next row of the same key, null while it is valid.

    Closing rows end versions and are left out. Rows that were cut into slices get
    the last row's end from the first row of the next slice.
    """
    key = ["table_name", "row_key", "satellite"]
    within = Window.partitionBy(*key, "slice").orderBy("lsn", F.col("closed").desc())
    firsts = satellites.filter("slice > 0").groupBy(*key, "slice").agg(F.min(F.struct("lsn", "valid_from"))["valid_from"].alias("first_time"))
    nexts = firsts.withColumn("next_time", F.lead("first_time").over(Window.partitionBy(*key).orderBy("slice"))).drop("first_time")
    rows = satellites.withColumn("valid_to", F.lead("valid_from").over(within)).join(nexts, [*key, "slice"], "left")
    return rows.filter(~F.col("closed")).withColumn("valid_to", F.coalesce("valid_to", "next_time")).drop("next_time", "closed", "slice")
