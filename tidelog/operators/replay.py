"""Ordered replay of inserts, updates and deletes into the current state of each table.

Each change becomes one or two *events* of a row: PUT (insert, or an update that
moves the row to this key), PATCH (update in place; columns that are absent stay
as they are) and DROP (delete, or an update that moves the row away). Events are
shuffled by row, sorted by sequence inside each partition and folded by a small
state machine that skips sequences already applied, so repeated and out-of-order
deliveries do no harm.

Folding is associative: the fold of a run of events is itself an event. Rows with
more than ``hot_rows`` events, however many there are, are therefore cut into slices
of consecutive sequences, the slices are folded in parallel, and their results are
folded once more in order. No task ever holds more than a slice of a hot row's
events, and the state machine itself streams.

A moved row whose update leaves columns out (they are unchanged) takes them from
the state its old key had at that sequence. ``complete_moves`` asks for all these
states in one walk over the old keys' events, and follows chains of such moves by
pointer doubling: a chain of any length takes the logarithm of it in rounds.

Defined cases: an update of a row that isn't known creates it with the columns
given; a delete of an unknown row leaves nothing; a null map counts as an empty
one; changes without table, key or sequence can't be placed and are left out;
events of one row at the same sequence apply as DROP, PUT, PATCH.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog import storage

DROP, PUT, PATCH = 0, 1, 2
#: Not changes: the state before a slice, and the question for the state before a sequence. They sort before changes of the same sequence.
CARRY, PROBE = -2, -1
EVENT_COLUMNS = ["table_name", "row_key", "slice", "seq", "kind", "cols", "moved_from", "tie"]


def committed(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows whose transaction (slot_name, xid) is among the commits. Spark broadcasts the commits only if they are small."""
    return rows.join(commits.select("slot_name", "xid"), ["slot_name", "xid"], "left_semi")


def key_from(image: Column, table: Column, key_columns: dict[str, list[str]]) -> Column:
    """The row key that an image holds: its key columns joined by ``|``; ``id`` where nothing else is given."""
    key = lambda names: F.when(reduce(lambda a, b: a & b, [image[n].isNotNull() for n in names]), F.concat_ws("|", *(image[n] for n in names)))
    out = None
    for name, names in sorted(key_columns.items()):
        out = F.when(table == name, key(names)) if out is None else out.when(table == name, key(names))
    return key(["id"]) if out is None else out.otherwise(key(["id"]))


def row_events(changes: DataFrame, key_columns: dict[str, list[str]], extra: list[str] | None = None) -> DataFrame:
    """Events of changes, with the ``extra`` columns carried along. Made before any shuffle, so that only what a replay needs travels."""
    extra = extra or []
    old_key = key_from(F.col("old_decoded"), F.col("table_name"), key_columns)
    moved = (F.col("op") == "U") & old_key.isNotNull() & (old_key != F.col("row_key"))
    empty = F.create_map().cast("map<string,string>")
    new, none = F.coalesce("new_decoded", empty), F.lit(None)
    event = lambda key, kind, cols, src: F.struct(key.alias("row_key"), F.lit(kind).cast("int").alias("kind"), cols.alias("cols"), src.cast("string").alias("moved_from"))
    here = F.col("row_key")
    events = (
        F.when(moved, F.array(event(old_key, DROP, empty, none), event(here, PUT, new, old_key)))
        .when(F.col("op") == "I", F.array(event(here, PUT, new, none)))
        .when(F.col("op") == "U", F.array(event(here, PATCH, new, none)))
        .when(F.col("op") == "D", F.array(event(here, DROP, empty, none)))
    )
    placed = changes.filter(F.col("table_name").isNotNull() & F.col("row_key").isNotNull() & F.col("lsn").isNotNull())
    flat = placed.select("table_name", F.col("lsn").cast("bigint").alias("seq"), F.col("delivery_id").alias("tie"), *extra, F.explode(events).alias("e"))
    return flat.select("table_name", F.col("e.row_key").alias("row_key"), F.lit(0).alias("slice"), "seq", F.col("e.kind").alias("kind"), F.col("e.cols").alias("cols"), F.col("e.moved_from").alias("moved_from"), "tie", *extra)


def profile(change_log: DataFrame, key_columns: dict[str, list[str]]) -> DataFrame:
    """(table_name, row_key, n, width, narrow): per row its changes, the columns of its widest insert and of its narrowest moving update.

    One pass from which hot rows and incomplete moves are read off; committed or not, so at worst too many are named.
    """
    moved = (F.col("op") == "U") & (key_from(F.col("old_decoded"), F.col("table_name"), key_columns) != F.col("row_key"))
    size = F.coalesce(F.size("new_decoded"), F.lit(0))
    named = change_log.filter(F.col("table_name").isNotNull() & F.col("row_key").isNotNull())
    return named.groupBy("table_name", "row_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("op") == "I", size)).alias("width"), F.min(F.when(moved, size)).alias("narrow"))


def hot_rows_of(change_log: DataFrame, counts: DataFrame, hot_rows: int) -> DataFrame | None:
    """(table_name, row_key, bounds) of rows with more than ``hot_rows`` changes (n in ``counts``), or None.

    ``bounds`` cut a row's changes into a power of two of slices of at most about
    ``hot_rows`` each, by its own quantiles. However many rows are hot, they stay a
    table; Spark broadcasts it only while it is small.
    """
    slices = F.ceil(F.log2(F.col("n") / F.lit(hot_rows))).cast("int")
    hot = storage.materialize(counts.filter(F.col("n") > hot_rows).select("table_name", "row_key", F.greatest(slices, F.lit(1)).alias("doublings")), "hot")
    most = hot.agg(F.max("doublings")).first()[0]
    if most is None:
        return None
    at = F.col("lsn").cast("bigint")
    cuts = [F.percentile_approx(F.when(F.col("doublings") == d, at), F.lit(np.arange(1, 2**d) / 2**d), max(10_000, 4 * 2**d)) for d in range(1, most + 1)]
    marks = change_log.select("table_name", "row_key", "lsn").join(hot, ["table_name", "row_key"]).groupBy("table_name", "row_key").agg(F.array_sort(F.array_distinct(F.coalesce(*cuts))).alias("bounds"))
    return storage.materialize(marks, "hot")


def sliced(events: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Events with their slice: 0 for rows that aren't hot, 1, 2, ... in order of sequence for those that are."""
    if hot is None:
        return events
    joined = events.join(hot, ["table_name", "row_key"], "left")
    return joined.withColumn("slice", F.when(F.col("bounds").isNull(), 0).otherwise(1 + F.size(F.filter("bounds", lambda b: b < F.col("seq")))).cast("int")).drop("bounds")


def in_order(events: DataFrame) -> DataFrame:
    """Each (row, slice) in one partition, in the order in which its events apply."""
    return events.repartition("table_name", "row_key", "slice").sortWithinPartitions("table_name", "row_key", "slice", "seq", "kind", "tie")


# --- the state machine -------------------------------------------------------


def map_lists(column: pa.Array) -> Iterator[dict]:
    """Arrow maps as dicts, by way of flat lists (much faster than to_pylist)."""
    offsets = column.offsets.to_pylist()
    keys, items = column.keys.to_pylist(), column.items.to_pylist()
    for a, b in zip(offsets, offsets[1:]):
        yield dict(zip(keys[a:b], items[a:b]))


class RowState:
    """Fold of a run of events of one row."""

    __slots__ = ("kind", "seq", "cols", "moved_from", "put_seq")

    def __init__(self) -> None:
        self.kind, self.seq, self.cols, self.moved_from, self.put_seq = -1, None, {}, None, None

    def apply(self, seq: int, kind: int, cols: dict, moved_from: str | None, put_seq: int | None = None) -> None:
        if kind == PATCH and self.kind != DROP:
            self.cols = {**self.cols, **cols}
            if self.kind < 0:
                self.kind = PATCH
        elif kind == DROP:
            self.cols, self.moved_from, self.put_seq = {}, None, None
            self.kind = DROP
        else:  # PUT, or a PATCH of a row that is gone
            self.cols, self.moved_from, self.put_seq = cols, moved_from, put_seq if put_seq is not None else seq
            self.kind = PUT
        self.seq = seq


SUMMARY_INPUT = ["table_name", "row_key", "slice", "seq", "kind", "cols", "moved_from"]
SUMMARY = "table_name string, row_key string, slice int, seq bigint, kind int, cols map<string,string>, moved_from string, put_seq bigint"
_SUMMARY_ARROW = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("slice", pa.int32()), ("seq", pa.int64()), ("kind", pa.int32()), ("cols", pa.map_(pa.string(), pa.string())), ("moved_from", pa.string()), ("put_seq", pa.int64())])


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary a (row, slice) from events in order; a repeated (sequence, kind) is skipped."""
    group, state, last = None, None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(_SUMMARY_ARROW.types)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_SUMMARY_ARROW)

    for batch in batches:
        names = batch.schema.names
        col = {n: batch.column(i) for i, n in enumerate(names)}
        puts = col["put_seq"].to_pylist() if "put_seq" in col else [None] * batch.num_rows
        for table, key, part, seq, kind, cols, moved, put in zip(col["table_name"].to_pylist(), col["row_key"].to_pylist(), col["slice"].to_pylist(), col["seq"].to_pylist(), col["kind"].to_pylist(), map_lists(col["cols"]), col["moved_from"].to_pylist(), puts):
            if group != (table, key, part):
                if group is not None:
                    out.append((*group, state.seq, state.kind, list(state.cols.items()), state.moved_from, state.put_seq))
                group, state, last = (table, key, part), RowState(), None
            if last is not None and (seq, kind) <= last:
                continue
            last = (seq, kind)
            state.apply(seq, kind, cols, moved, put)
        if len(out) >= 4096:
            yield flush()
    if group is not None:
        out.append((*group, state.seq, state.kind, list(state.cols.items()), state.moved_from, state.put_seq))
    if out:
        yield flush()


def fold(events: DataFrame, any_hot: bool) -> DataFrame:
    """The summary of every row over all its (sliced) events."""
    parts = in_order(events).select(*SUMMARY_INPUT).mapInArrow(fold_batches, SUMMARY)
    if not any_hot:
        return parts
    again = parts.repartition("table_name", "row_key").withColumn("slice", F.lit(0)).sortWithinPartitions("table_name", "row_key", "seq", "kind")
    return again.mapInArrow(fold_batches, SUMMARY)


# --- the state before a slice, and before a sequence ---------------------------

_CARRIED = "table_name string, row_key string, slice int, seq bigint, last_kind int, cols map<string,string>, moved_from string, put_seq bigint"
_CARRIED_ARROW = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("slice", pa.int32()), ("seq", pa.int64()), ("last_kind", pa.int32()), ("cols", pa.map_(pa.string(), pa.string())), ("moved_from", pa.string()), ("put_seq", pa.int64())])


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From slice summaries in order: for each slice, the fold of all slices before it (none for the first)."""
    row, state = None, None
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out = []
        for table, key, part, seq, kind, cols, moved, put in zip(*(col[n].to_pylist() for n in ("table_name", "row_key", "slice", "seq", "kind")), map_lists(col["cols"]), col["moved_from"].to_pylist(), col["put_seq"].to_pylist()):
            if row != (table, key):
                row, state = (table, key), RowState()
            elif state.kind >= 0:
                out.append((table, key, part, state.seq, state.kind, list(state.cols.items()), state.moved_from, state.put_seq))
            state.apply(seq, kind, cols, moved, put)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_CARRIED_ARROW.types)], schema=_CARRIED_ARROW)


def carried(events: DataFrame) -> DataFrame:
    """The state before each slice of hot rows, but their first. Its sequence lies before all of the slice."""
    summaries = in_order(events.select(*EVENT_COLUMNS).filter(F.col("slice") > 0)).select(*SUMMARY_INPUT).mapInArrow(fold_batches, SUMMARY)
    return summaries.repartition("table_name", "row_key").sortWithinPartitions("table_name", "row_key", "slice").mapInArrow(prefixes, _CARRIED)


_ANSWER = "table_name string, row_key string, seq bigint, source string, cols map<string,string>, moved_from string, put_seq bigint"
_ANSWER_ARROW = pa.schema([("table_name", pa.string()), ("row_key", pa.string()), ("seq", pa.int64()), ("source", pa.string()), ("cols", pa.map_(pa.string(), pa.string())), ("moved_from", pa.string()), ("put_seq", pa.int64())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each PROBE among events in order, the state its row has there, if the row exists."""
    group, state, last = None, None, None
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        lists = [col[n].to_pylist() for n in ("table_name", "row_key", "slice", "seq", "kind", "moved_from", "put_seq", "last_kind", "ask")]
        out = []
        for table, key, part, seq, kind, moved, put, before, ask, cols in zip(*lists, map_lists(col["cols"])):
            if group != (table, key, part):
                group, state, last = (table, key, part), RowState(), None
            if kind == PROBE:
                if state.kind in (PUT, PATCH):
                    out.append((table, ask, seq, key, list(state.cols.items()), state.moved_from, state.put_seq))
            elif kind == CARRY:
                state.kind, state.seq, state.cols, state.moved_from, state.put_seq = before, seq, cols, moved, put
            elif last is None or (seq, kind) > last:
                last = (seq, kind)
                state.apply(seq, kind, cols, moved)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_ANSWER_ARROW.types)], schema=_ANSWER_ARROW)


def widths_of(counts: DataFrame, whole: bool = True) -> dict[str, int]:
    """Tables in which a moving update leaves columns out, with the number of columns of their inserts. One row a table.

    Where the changes aren't the ``whole`` log, any moving update may leave out columns of earlier inserts.
    """
    rows = counts.groupBy("table_name").agg(F.max("width").alias("width"), F.min("narrow").alias("narrow")).filter("narrow < width" if whole else "narrow is not null").collect()
    return {r["table_name"]: r["width"] if whole else 1 << 30 for r in rows}


def complete_moves(events: DataFrame, widths: dict[str, int], hot: DataFrame | None) -> DataFrame:
    """Give each moving update the columns it left out, from the state of its old key just before.

    What a move finds there goes back to the old key's last PUT. If that is such a
    move too, the rest is what that one finds: each move points to the next, and
    every round joins the table of moves with itself and doubles how far they point.
    """
    if not widths:
        return events
    width = F.element_at(F.create_map(*(F.lit(x) for t, n in sorted(widths.items()) for x in (t, n))), F.col("table_name"))
    short = (F.col("kind") == PUT) & F.col("moved_from").isNotNull() & F.coalesce(F.size("cols") < width, F.lit(False))
    moves = storage.materialize(events.filter(short).groupBy("table_name", "row_key", "seq").agg(F.min("moved_from").alias("source")), "moves")
    if moves.isEmpty():
        return events
    asked = moves.select("table_name", F.col("source").alias("row_key")).distinct()
    empty, text, number = F.create_map().cast("map<string,string>"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    more = {"put_seq": number, "last_kind": F.lit(None).cast("int"), "ask": text}
    past = events.select(*EVENT_COLUMNS).join(asked, ["table_name", "row_key"], "left_semi")
    probes = sliced(moves.select("table_name", F.col("source").alias("row_key"), F.lit(0).alias("slice"), "seq", F.lit(PROBE).alias("kind"), empty.alias("cols"), text.alias("moved_from"), F.lit(0).cast("bigint").alias("tie"), F.col("row_key").alias("ask")), hot)
    walked = past.withColumns(more).unionByName(probes.withColumns({n: c for n, c in more.items() if n != "ask"}))
    if hot is not None:
        walked = walked.unionByName(carried(past).withColumns({"kind": F.lit(CARRY), "tie": F.lit(0).cast("bigint"), "ask": text}))
    answers = in_order(walked).select("table_name", "row_key", "slice", "seq", "kind", "cols", "moved_from", "put_seq", "last_kind", "ask").mapInArrow(_answers, _ANSWER)
    on = F.col("moved_from").isNotNull() & (F.size("cols") < width)
    found = storage.materialize(answers.select("table_name", "row_key", "seq", "cols", F.when(on, F.col("source")).alias("next_key"), F.when(on, F.col("put_seq")).alias("next_seq")), "moves")
    merge = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    while not found.filter("next_seq is not null").isEmpty():
        far = found.select("table_name", F.col("row_key").alias("next_key"), F.col("seq").alias("next_seq"), F.col("cols").alias("far"), F.col("next_key").alias("far_key"), F.col("next_seq").alias("far_seq"))
        cols = F.when(F.col("far").isNull(), F.col("cols")).otherwise(merge(F.col("far"), F.col("cols")))
        found = storage.materialize(found.join(far, ["table_name", "next_key", "next_seq"], "left").select("table_name", "row_key", "seq", cols.alias("cols"), F.col("far_key").alias("next_key"), F.col("far_seq").alias("next_seq")), "moves")
    filled = events.filter(short).join(found.select("table_name", "row_key", "seq", F.col("cols").alias("past")), ["table_name", "row_key", "seq"], "left")
    filled = filled.withColumn("cols", F.when(F.col("past").isNull(), F.col("cols")).otherwise(merge(F.col("past"), F.col("cols"))))
    return events.filter(~short).unionByName(filled.select(*events.columns))


def current_state(change_log: DataFrame, commits: DataFrame, key_columns: dict[str, list[str]], *, hot_rows: int = 50_000) -> DataFrame:
    """(table_name, row_key, lsn, cols): every row that exists after all committed changes."""
    counts = profile(change_log, key_columns).persist()
    try:
        hot, widths = hot_rows_of(change_log, counts, hot_rows), widths_of(counts)
    finally:
        counts.unpersist()
    events = committed(sliced(row_events(change_log, key_columns, ["slot_name", "xid"]), hot), commits)
    events = complete_moves(events, widths, hot)
    state = fold(events.select(*EVENT_COLUMNS), hot is not None).filter(F.col("kind") != DROP)
    return state.select("table_name", "row_key", F.col("seq").alias("lsn"), "cols")
