"""Schemas that drift between files, messages and configuration revisions.

A *step* is one schema of a table at one moment: (origin, table_name, subject,
rank, step_no, columns), with ``columns`` in place order. Steps are read in
parallel where the data lies (record files are summarised per partition, so a
file of any size shuffles a few rows), put in order per subject, and compared with
their predecessor. The order is cut into ranges (tidelog.operators.scan), so a feed
may have any number of files. Only steps that differ from their predecessor are
folded: their types go through a promotion lattice into one type per column, and
every record is cast to that union schema.

Defined cases: a step without columns (null) is no step; a field whose values are
all null has no type, which equals any type; equal counts of two types resolve to
the alphabetically last; fields of a file none of whose records has all fields
follow those of its longest record, by name; unreadable records count for nothing
in a schema and come out of ``unify`` marked, with their text; values that don't
fit the union type go to ``rescued`` under their column.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.operators import scan

STEP = ["origin", "table_name", "subject", "rank", "step_no", "columns"]
_COLUMNS = "array<struct<name:string,type:string>>"


# --- reading the schemas -----------------------------------------------------


def _constant(_: str):
    raise ValueError("not JSON")


def read_record(text: str | None) -> dict | None:
    """The record as a dict, or None if it isn't one JSON object."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return {str: "string", list: "array"}.get(type(value), "object")


_PART = "table_name string, file_no bigint, taken_at timestamp_ntz, field string, type string, n bigint, layout array<string>"
_PART_ARROW = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("taken_at", pa.timestamp("us")), ("field", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("layout", pa.list_(pa.string()))])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and file: how often each field has each type, and the longest record's layout."""
    fields: Counter = Counter()
    layouts: dict = {}

    def flush() -> pa.RecordBatch:
        rows = [(*f, name, kind, n, None) for (f, name, kind), n in fields.items()] + [(*f, None, None, 1, list(x)) for f, x in layouts.items()]
        fields.clear(), layouts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PART_ARROW.types)], schema=_PART_ARROW)

    for batch in batches:
        tables, files, times, texts = (batch.column(i).to_pylist() for i in range(4))
        for t, f, at, text in zip(tables, files, times, texts):
            record = read_record(text)
            if record is None or t is None or f is None:
                continue
            key = (t, f, at)
            for name, value in record.items():
                fields[key, name, json_type(value)] += 1
            best = layouts.get(key)
            own = tuple(record)
            if best is None or (len(own), own) > (len(best), best):
                layouts[key] = own
        if len(fields) > 100_000:
            yield flush()
    if fields or layouts:
        yield flush()


def record_file_steps(files: DataFrame) -> DataFrame:
    """Steps of record files (table_name, file_no, taken_at, record_json), in order of ``taken_at``.

    Types are the JSON types, whole and broken numbers apart (``integer``, ``number``).
    """
    parts = files.select("table_name", "file_no", F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), "record_json").mapInArrow(_headers, _PART)
    parts = storage.materialize(parts, "headers")  # read twice below, and far smaller than the files
    key = ["table_name", "file_no", "taken_at"]
    by_type = parts.filter("field is not null").groupBy(*key, "field", "type").agg(F.sum("n").alias("n"))
    # a field is a number if most of its values are numbers of either kind
    family = F.when(F.col("type").isin("integer", "number"), "number").otherwise(F.col("type"))
    by_family = by_type.withColumn("family", family).groupBy(*key, "field", "family").agg(F.sum("n").alias("n"), F.max_by("type", F.col("type")).alias("type"))
    typed = F.when(F.col("family").isNotNull(), F.struct("n", "family", "type"))
    fields = by_family.groupBy(*key, "field").agg(F.max(typed)["type"].alias("type"))
    listed = fields.groupBy(*key).agg(F.collect_list(F.struct("field", "type")).alias("fields"))
    layout = parts.filter("layout is not null").groupBy(*key).agg(F.max(F.struct(F.size("layout"), "layout"))["layout"].alias("layout"))
    place = lambda f: F.when(F.array_contains("layout", f), F.array_position("layout", f)).otherwise(1 << 30)
    # two plain lists of the same file; the time may be null
    same = [listed[c].eqNullSafe(layout[c]) for c in key]
    both = listed.join(layout, same).select(*(listed[c] for c in key), "fields", "layout")
    ordered = F.transform(F.sort_array(F.transform("fields", lambda x: F.struct(place(x["field"]).alias("place"), x["field"].alias("name"), x["type"].alias("type")))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    return both.select(F.lit("insert_file").alias("origin"), "table_name", F.col("table_name").alias("subject"), F.unix_micros(F.col("taken_at").cast("timestamp")).cast("decimal(20,0)").alias("rank"), F.col("file_no").alias("step_no"), ordered.cast(_COLUMNS).alias("columns"))


def relation_steps(relations: DataFrame) -> DataFrame:
    """Steps of Relation messages: those of an oid in order of lsn; the type is (type_oid, type_mod)."""
    kind = lambda c: F.concat_ws("/", c["type_oid"], c["type_mod"])
    columns = F.transform("column_list", lambda c: F.struct(c["name"].alias("name"), kind(c).alias("type")))
    return relations.filter("oid is not null and column_list is not null").select(F.lit("relation").alias("origin"), "table_name", F.col("oid").cast("string").alias("subject"), F.col("lsn").cast("decimal(20,0)").alias("rank"), F.col("relation_id").alias("step_no"), columns.cast(_COLUMNS).alias("columns"))


def publication_steps(tables: DataFrame) -> DataFrame:
    """Steps of configured column lists by revision. Order means nothing, so each column is its own type: no renames."""
    columns = F.transform("column_list", lambda c: F.struct(c.alias("name"), c.alias("type")))
    return tables.filter("column_list is not null").select(F.lit("publication").alias("origin"), "table_name", F.col("table_name").alias("subject"), F.col("config_rev").cast("decimal(20,0)").alias("rank"), F.col("pub_row_id").alias("step_no"), columns.cast(_COLUMNS).alias("columns"))


def parquet_steps(spark: SparkSession, paths: list[str], table_name: str) -> DataFrame:
    """Steps of Parquet files: their footers, read in parallel; the order is that of ``paths``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for frame in frames:
            rows = []
            for n, path in zip(frame["n"], frame["path"]):
                system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                rows.append((n, json.dumps([{"name": f.name, "type": str(f.type)} for f in pq.read_schema(name, filesystem=system)])))
            yield pd.DataFrame(rows, columns=["n", "columns"])

    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n bigint, path string").repartition(min(len(paths) or 1, 1000), "n")
    return listed.mapInPandas(read, "n bigint, columns string").select(F.lit("parquet").alias("origin"), F.lit(table_name).alias("table_name"), F.lit(table_name).alias("subject"), F.col("n").cast("decimal(20,0)").alias("rank"), F.col("n").alias("step_no"), F.from_json("columns", _COLUMNS).alias("columns"))


# --- comparing ---------------------------------------------------------------


def _family(steps: DataFrame) -> DataFrame:
    """Whole and broken JSON numbers are one type to the report."""
    return steps.withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), F.when(c["type"] == "integer", "number").otherwise(c["type"]).alias("type"))))


def in_order(steps: DataFrame) -> DataFrame:
    """Steps with ``before``, the columns of the same subject's step before (null for its first)."""
    return scan.previous(scan.ranged(steps, ["origin", "subject"], ["rank", "step_no"]), ["origin", "subject"], ["rank", "step_no"], "columns", "before")


def differences(steps: DataFrame) -> DataFrame:
    """(origin, table_name, step_no, drift_kind, field_name, new_name, old_type, new_type): each change between consecutive steps.

    ``renamed``: the name is gone and at the same place stands a new name of the
    same type. Then ``removed``, ``added`` and ``type_changed``.
    """
    pairs = in_order(_family(steps)).filter("before is not null")
    names = lambda c: F.transform(c, lambda x: x["name"])
    pairs = pairs.withColumns({"old_names": names("before"), "new_names": names("columns")})
    alike = lambda a, b: a.isNull() | b.isNull() | (a == b)
    zipped = F.transform("before", lambda o, i: F.struct(o.alias("o"), F.get("columns", i).alias("n")))
    gone = lambda p: ~F.array_contains("new_names", p["o"]["name"])
    renamed = lambda p: gone(p) & p["n"].isNotNull() & ~F.array_contains("old_names", F.coalesce(p["n"]["name"], F.lit(""))) & alike(p["o"]["type"], p["n"]["type"])
    pairs = pairs.withColumn("gone", F.filter(zipped, gone)).withColumn("to", F.transform(F.filter("gone", renamed), lambda p: p["n"]["name"]))
    row = lambda kind, name, new, a, b: F.struct(F.lit(kind).alias("drift_kind"), name.alias("field_name"), new.alias("new_name"), a.alias("old_type"), b.alias("new_type"))
    none = F.lit(None).cast("string")
    found = F.concat(
        F.transform("gone", lambda p: F.when(renamed(p), row("renamed", p["o"]["name"], p["n"]["name"], p["o"]["type"], p["n"]["type"])).otherwise(row("removed", p["o"]["name"], none, p["o"]["type"], none))),
        F.transform(F.filter("columns", lambda n: ~F.array_contains("old_names", n["name"]) & ~F.array_contains("to", n["name"])), lambda n: row("added", n["name"], none, none, n["type"])),
        F.flatten(F.transform("before", lambda o: F.transform(F.filter("columns", lambda n: (n["name"] == o["name"]) & ~alike(o["type"], n["type"])), lambda n: row("type_changed", n["name"], none, o["type"], n["type"])))),
    )
    return pairs.select("origin", "table_name", "step_no", F.explode(found).alias("d")).select("origin", "table_name", "step_no", "d.*")


# --- one consistent table ----------------------------------------------------

_ABOVE = {"integer": {"number"}, "number": set(), "boolean": set(), "array": set(), "object": set()}


def promote(a: str | None, b: str | None) -> str | None:
    """Least upper bound in the lattice: nothing < integer < number < string, and all other kinds < string."""
    if a is None or a == b:
        return b
    if b is None:
        return a
    if b in _ABOVE.get(a, ()):
        return b
    if a in _ABOVE.get(b, ()):
        return a
    return "string"


SPARK_TYPES = {None: "string", "integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "array": "string", "object": "string"}


def union_schema(steps: DataFrame) -> DataFrame:
    """(table_name, step_no, field, column, place, type): where each field of each step goes.

    A field that was renamed goes to the column with its latest name. The walk
    through a table's steps in order only takes those that differ from the one
    before; the others share the outcome of the last that did.
    """
    key, order = ["origin", "subject"], ["rank", "step_no"]
    rows = in_order(steps)
    new = F.col("before").isNull() | (F.col("before") != F.col("columns"))
    rows = storage.materialize(scan.latest(rows, key, order, new, "point"), "steps")
    points = rows.filter(F.col("point.step_no") == F.col("step_no")).select(*STEP)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "step_no"])
        column_of: dict[str, int] = {}  # field name now -> column
        names: list[str] = []
        types: list[str | None] = []
        out, before = [], None
        for step, columns in zip(frame["step_no"], frame["columns"]):
            now = [(c["name"], c["type"]) for c in columns]
            here = {n for n, _ in now}
            if before is not None:
                was = {n for n, _ in before}
                for (a, ta), (b, tb) in zip(before, now):
                    same = ta is None or tb is None or ta == tb or {ta, tb} == {"integer", "number"}
                    if a not in here and b not in was and same and b not in column_of:
                        column_of[b] = column_of.pop(a)
                        names[column_of[b]] = b
            for n, t in now:
                if n not in column_of:
                    column_of[n] = len(names)
                    names.append(n)
                    types.append(None)
                types[column_of[n]] = promote(types[column_of[n]], t)
            out += [(step, n, column_of[n]) for n, _ in now]
            before = now
        # a name may come back for another column; the earlier one then keeps a number
        seen: Counter = Counter()
        final = [n if (seen.update([n]) or seen[n]) == 1 else f"{n}_{seen[n]}" for n in names]
        table = frame["table_name"].iloc[0]
        return pd.DataFrame([(table, s, f, final[i], i, types[i]) for s, f, i in out], columns=["table_name", "step_no", "field", "column", "place", "type"])

    walked = points.groupBy("table_name").applyInPandas(walk, "table_name string, step_no bigint, field string, column string, place int, type string")
    where = rows.select("table_name", "step_no", F.col("point.step_no").alias("point")).join(walked.withColumnRenamed("step_no", "point"), ["table_name", "point"]).select("table_name", "step_no", "field", "column", "place", "type")
    return storage.materialize(where, "schema")  # whoever casts records reads it more than once


def _cast(value, kind: str | None) -> tuple[bool, str | None]:
    """The value's text under the union type, if it fits."""
    own = json_type(value)
    if own is None:
        return True, None
    if kind in (None, "string"):
        return True, value if own == "string" else _written(value)
    return own == kind or (kind == "number" and own == "integer"), _written(value)


def _written(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def unify(files: DataFrame, schema: DataFrame) -> DataFrame:
    """Every record under the union schema: (table_name, file_no, record_no, readable, cols, rescued).

    ``cols`` holds all columns of the feed's table, as text that casts to the union
    type; null where the record, or its whole file, says nothing of a column.
    """
    every = schema.select("table_name", "column", "place").distinct().groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda x: x["column"]).alias("every"))
    where = schema.groupBy("table_name", F.col("step_no").alias("file_no")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("column", "type")))).alias("where"))
    out = "table_name string, file_no bigint, record_no int, readable boolean, cols map<string,string>, rescued map<string,string>"
    arrow = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("record_no", pa.int32()), ("readable", pa.bool_()), ("cols", pa.map_(pa.string(), pa.string())), ("rescued", pa.map_(pa.string(), pa.string()))])

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, file, no, text, to, every in zip(*(batch.column(i).to_pylist(maps_as_pydicts="strict") for i in range(6))):
                record = read_record(text)
                if record is None:
                    rows.append((table, file, no, False, [], [("_record", text)]))
                    continue
                cols, rescued = dict.fromkeys(every or ()), []
                for field, target in (to or {}).items():
                    fits, value = _cast(record.get(field), target["type"])
                    cols[target["column"]] = value if fits else None
                    if not fits:
                        rescued.append((target["column"], value))
                rows.append((table, file, no, True, list(cols.items()), rescued))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow.types)], schema=arrow)

    joined = files.select("table_name", "file_no", "record_no", "record_json").join(where, ["table_name", "file_no"], "left").join(every, "table_name", "left")
    return joined.mapInArrow(cast, out)


def feed_table(unified: DataFrame, schema: DataFrame, table_name: str) -> DataFrame:
    """One feed's records as a wide, typed table."""
    columns = schema.filter(F.col("table_name") == table_name).groupBy("column", "place", "type").count().orderBy("place").collect()
    wide = [F.col("cols")[r["column"]].try_cast(SPARK_TYPES[r["type"]]).alias(r["column"]) for r in columns]
    return unified.filter((F.col("table_name") == table_name) & F.col("readable")).select(F.col("file_no").alias("_file_no"), F.col("record_no").alias("_record_no"), F.col("rescued").alias("_rescued"), *wide)


def read_parquet_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of drifting schemas as one table: files of one schema are read together, cast to the union and united."""
    steps = parquet_steps(spark, paths, "files").select("step_no", "columns").collect()
    order = {"bool": 0, "int8": 1, "int16": 2, "int32": 3, "int64": 4, "float": 5, "double": 6}
    spark_type = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double"}
    union: dict[str, str | None] = {}
    groups: dict[tuple, list[str]] = {}
    for step in sorted(steps, key=lambda s: s["step_no"]):
        groups.setdefault(tuple((c["name"], c["type"]) for c in step["columns"]), []).append(paths[step["step_no"]])
        for c in step["columns"]:
            a, b = union.get(c["name"], c["type"]), c["type"]
            if a != b:
                numeric = a in order and b in order and "bool" not in (a, b)
                # a float can't hold all whole numbers of 32 bits and more
                b = (max(a, b, key=order.get) if {a, b} != {"float", "int64"} and {a, b} != {"float", "int32"} else "double") if numeric else "string"
            union[c["name"]] = b
    out = None
    for schema, files in groups.items():
        frame = spark.read.parquet(*files)
        kinds = dict(schema)
        cast = lambda n, t: (F.col(f"`{n}`") if kinds[n] == t else F.col(f"`{n}`").cast(spark_type.get(t, "string"))) if n in kinds else F.lit(None).cast(spark_type.get(t, "string"))
        frame = frame.select(*(cast(n, t).alias(n) for n, t in union.items()))
        out = frame if out is None else out.unionByName(frame)
    return out if out is not None else spark.createDataFrame([], "path string").drop("path")
