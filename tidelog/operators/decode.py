"""Content frames to typed change events.

Fixed parts are read as Columns; only relations and row images, whose length
varies, are walked in Python, in Arrow batches, and only for frames that are still
wanted. A row image says nothing of its columns: those come from the last Relation
message of the same slot and oid before it (``as_of``). What can't be decoded comes out with an
``error`` and is never lost silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog import storage
from tidelog.operators import scan
from tidelog.operators.assemble import assemble, in_context
from tidelog.sources import wire
from tidelog.sources.frames import number

_COLUMN = pa.struct([("name", pa.string()), ("type_oid", pa.int64()), ("type_mod", pa.int64()), ("flags", pa.int32())])
_REL_SQL = "slot string, frame_seq bigint, oid bigint, table_schema string, table_name string, replica_id string, column_list array<struct<name:string,type_oid:bigint,type_mod:bigint,flags:int>>, error string"
_REL = pa.schema([("slot", pa.string()), ("frame_seq", pa.int64()), ("oid", pa.int64()), ("table_schema", pa.string()), ("table_name", pa.string()), ("replica_id", pa.string()), ("column_list", pa.list_(_COLUMN)), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def relations(rows: DataFrame) -> DataFrame:
    """Relation messages of frames in context."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slot, seq, payload, inside in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    r = wire.decode(payload, inside)
                    out.append((slot, seq, r.oid, r.namespace, r.name, r.identity, [{"name": c.name, "type_oid": c.type_oid, "type_mod": c.type_mod, "flags": c.flags} for c in r.columns], None))
                except wire.WireError as e:
                    out.append((slot, seq, None, None, None, None, None, str(e)))
            yield _batch(out, _REL)

    return rows.filter("tag = 'R'").select("slot", "frame_seq", "payload", "in_stream").mapInArrow(walk, _REL_SQL)


def as_of(rows: DataFrame, known: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``relation`` to rows with an ``oid``: the last definition of the same slot and oid before the row.

    Mostly a table is defined once and the same message comes again and again: then
    its first place is all that matters, and one short list serves all rows. Where
    tables are defined anew, rows and definitions are put in order together, in
    blocks, so that neither the rows nor the definitions of one table meet in one task.
    """
    named = known.filter("error is null").select("slot", "oid", "frame_seq", F.struct("table_schema", "table_name", F.transform("column_list", lambda c: c["name"]).alias("columns")).alias("relation"))
    first = storage.materialize(named.groupBy("slot", "oid", "relation").agg(F.min("frame_seq").alias("__since")), "relations")
    if first.groupBy("slot", "oid").count().filter("count > 1").isEmpty():
        joined = rows.join(first, ["slot", "oid"], "left")
        return joined.withColumn("relation", F.when(F.col("__since") < F.col("frame_seq"), F.col("relation"))).drop("__since")
    both = rows.withColumn("__since", F.lit(None).cast("bigint")).unionByName(named.select("slot", "oid", "frame_seq", F.col("frame_seq").alias("__since")), allowMissingColumns=True)
    seen = scan.last_known(both, ["slot", "oid"], "frame_seq", {"__at": F.col("__since")}, block=block).filter("__since is null").drop("__since")
    return seen.join(named.withColumnRenamed("frame_seq", "__at"), ["slot", "oid", "__at"], "left").drop("__at")


def with_relation(rows: DataFrame, known: DataFrame, *, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``oid`` and ``relation``, the last one of the same slot and oid before the row, to inserts, updates and deletes."""
    oid = number(F.col("payload"), 2, 4)
    inside = number(F.col("payload"), 6, 4)
    keyed = rows.withColumn("oid", F.when(F.col("tag").isin("I", "U", "D"), F.when(F.col("in_stream"), inside).otherwise(oid)).cast("bigint"))
    return as_of(keyed, known, block=block)


_BODY_SQL = "old_kind string, before map<string,string>, after map<string,string>, oids array<bigint>, cascade boolean, restart_identity boolean, error string"
_BODY = pa.schema([("old_kind", pa.string()), ("before", pa.map_(pa.string(), pa.string())), ("after", pa.map_(pa.string(), pa.string())), ("oids", pa.list_(pa.int64())), ("cascade", pa.bool_()), ("restart_identity", pa.bool_()), ("error", pa.string())])


def decode_body(payload: bytes, inside: bool, columns: list[str] | None) -> tuple:
    """(old_kind, before, after, oids, cascade, restart_identity, error) of one content message."""
    try:
        m = wire.decode(payload, inside)
        if isinstance(m, wire.Truncate):
            return None, None, None, m.oids, m.cascade, m.restart_identity, None
        if isinstance(m, wire.Relation):
            return None, None, None, None, None, None, None
        if columns is None:
            return None, None, None, None, None, None, f"no relation {m.oid} before this message"
        before = list(wire.named(m.old, columns).items()) if m.old is not None else None
        after = list(wire.named(wire.fill_unchanged(m.new, m.old), columns).items()) if m.new is not None else None
        return m.old_kind, before, after, None, None, None, None
    except wire.WireError as e:
        return None, None, None, None, None, None, str(e)


def bodies(rows: DataFrame) -> DataFrame:
    """Rows with their decoded images. Every other column passes through."""
    passed = [c for c in rows.columns if c not in ("payload", "relation")]
    given = rows.select(*passed, "payload", F.col("relation.columns").alias("__columns"))
    schema = rows.select(*passed).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = [decode_body(p, bool(i), c) for p, i, c in zip(col["payload"].to_pylist(), col["in_stream"].to_pylist(), col["__columns"].to_pylist())]
            body = _batch(out, _BODY)
            yield pa.RecordBatch.from_arrays([*(col[n] for n in passed), *body.columns], names=[*passed, *_BODY.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return given.mapInArrow(walk, f"{fields}, {_BODY_SQL}")


def change_events(frames: DataFrame, *, abort_scope: str = "transaction", block: int = 1 << 20) -> DataFrame:
    """Frames to delivered change events; undecodable ones have an ``error``.

    The frames in context are written once to the shared folder: what follows reads
    them several times, mostly a few narrow columns of the control frames.
    """
    rows = storage.materialize(in_context(frames, block=block), "frames")
    delivered = assemble(rows, abort_scope=abort_scope)
    known = storage.materialize(relations(rows), "relations")
    named = with_relation(delivered, known, block=block).withColumns({"table_schema": F.col("relation.table_schema"), "table_name": F.col("relation.table_name")})
    names = truncated_tables(delivered, known).groupBy("slot", "frame_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("truncated"))
    events = bodies(named).withColumnRenamed("tag", "op").join(names, ["slot", "frame_seq"], "left")
    # truncates and relations carry no position of their own
    return events.withColumn("lsn", F.when(F.col("op").isin("I", "U", "D"), F.col("wal_start"))).drop("wal_end")


def dead_letters(frames: DataFrame) -> DataFrame:
    """(slot, frame_seq, reason) of frames whose header can't be read."""
    from tidelog.sources.frames import headers

    return headers(frames).filter("header_error is not null").select("slot", "frame_seq", F.col("header_error").alias("reason"))


def truncated_tables(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(slot, frame_seq, place, oid, name): each table that a truncate names, as it was called then; ``oid:<n>`` where that isn't known."""
    start = F.when(F.col("in_stream"), 6).otherwise(2)  # after the tag, and the xid of streamed ones
    value = lambda at: F.conv(F.hex(F.substr("payload", at, F.lit(4))), 16, 10).cast("bigint")
    n = value(start)
    whole = F.length("payload") >= start + 4 + 4 * n
    oids = F.when(whole & (n > 0), F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: value(start + 5 + 4 * i)))
    cut = rows.filter("tag = 'T'").select("slot", "frame_seq", F.posexplode(oids).alias("place", "oid"))
    name = F.concat_ws(".", "relation.table_schema", "relation.table_name")
    return as_of(cut, known).select("slot", "frame_seq", "place", "oid", F.when(F.col("relation").isNull(), F.concat(F.lit("oid:"), F.col("oid"))).otherwise(name).alias("name"))


def typed_rows(changes: DataFrame, columns: list[tuple[str, int, int]], *, image: str = "after", strict: bool = False) -> DataFrame:
    """Text images as typed columns (name, type oid, type modifier), plus which columns were ``present``.

    A column that is absent (unchanged) and one that is null both come out null, so
    ``present`` tells them apart. Text that doesn't fit its type gives null, and with
    ``strict`` the row's ``error`` names the column.
    """
    from tidelog.functions.pgtypes import typed

    value = lambda n: F.try_element_at(F.col(image), F.lit(n))
    out = changes.withColumns({"present": F.sort_array(F.map_keys(image)), **{n: typed(value(n), oid, mod) for n, oid, mod in columns}})
    if strict:
        bad = F.concat_ws(", ", *(F.when(value(n).isNotNull() & typed(value(n), oid, mod).isNull(), F.lit(n)) for n, oid, mod in columns))
        out = out.withColumn("error", F.when(bad != "", F.concat(F.lit("not of its type: "), bad)))
    return out
