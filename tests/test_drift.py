import json
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelog.operators import drift

SCHEMA = "file_no bigint, record_no int, table_name string, taken_at timestamp_ntz, record_json string, type string, n int"
KIND = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def files_df(spark, files):
    """files: (file_no, table, hour, [record text])."""
    rows = [(no, i, t, datetime(2025, 1, 1) + timedelta(hours=h) if h is not None else None, text, "clash", 0) for no, t, h, records in files for i, text in enumerate(records, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_differences(files):
    out, last = set(), {}
    for no, t, h, records in sorted(files, key=lambda f: f[2]):
        parsed = [r for r in map(drift.read_record, records) if r is not None]
        if not parsed:
            continue
        layout = max((tuple(r) for r in parsed), key=lambda k: (len(k), k))
        union = list(layout) + sorted({k for r in parsed for k in r} - set(layout))
        types = {}
        for k in union:
            c = Counter(KIND[type(r[k])] for r in parsed if r.get(k) is not None)
            types[k] = max(c, key=lambda x: (c[x], x)) if c else None
        now = [(k, types[k]) for k in union]
        if t in last:
            was = last[t]
            a, b = dict(was), dict(now)
            renamed = {}
            for (x, tx), (y, ty) in zip(was, now):
                if x not in b and y not in a and (tx == ty or tx is None or ty is None):
                    renamed[x] = y
            out |= {(no, "renamed", x) for x in renamed}
            out |= {(no, "removed", x) for x in a if x not in b and x not in renamed}
            out |= {(no, "added", y) for y in b if y not in a and y not in renamed.values()}
            out |= {(no, "type_changed", x) for x in a if x in b and a[x] and b[x] and a[x] != b[x]}
        last[t] = now
    return out


def random_files(seed):
    r = random.Random(seed)
    value = {"number": lambda: r.choice((1, 2.5, 10**17)), "string": lambda: r.choice(("x", "ü", "")), "boolean": lambda: r.random() < 0.5, "array": lambda: [1], "object": lambda: {"k": 1}}
    files = []
    for t in ("ta", "tb", "tc"):
        columns = [("id", "number"), ("p", "string"), ("q", "boolean")]
        for h in range(8):
            for _ in range(r.choice((0, 1, 2))):
                what, i = r.choice(("add", "drop", "rename", "type")), r.randrange(1, max(2, len(columns)))
                if what == "add":
                    columns.append((f"n{r.randint(0, 99)}_{len(columns)}_{h}", r.choice(list(value))))
                elif i < len(columns) and what == "drop":
                    del columns[i]
                elif i < len(columns) and what == "rename":
                    columns[i] = (f"r{r.randint(0, 999)}_{h}", columns[i][1])
                elif i < len(columns):
                    columns[i] = (columns[i][0], r.choice(list(value)))
            records = [json.dumps({k: value[v]() for k, v in columns})]
            for _ in range(9):
                record = {k: None if r.random() < 0.2 else value[v]() for k, v in columns if k == "id" or r.random() < 0.7}
                records.append(json.dumps(record) if r.random() < 0.85 else json.dumps(record)[:-3])
            r.shuffle(records)
            files.append((len(files) + 1, t, h, records))
    r.shuffle(files)
    return files


def test_differences_equal_a_plain_walk(spark):
    for seed in (1, 2):
        files = random_files(seed)
        df = files_df(spark, files).repartition(5)
        got = {tuple(r) for r in drift.differences(drift.record_file_steps(df)).select("step_no", "drift_kind", "field_name").collect()}
        assert got == plain_differences(files)


def test_every_record_comes_out_under_the_union(spark):
    files = random_files(3)
    df = files_df(spark, files).repartition(3)
    schema = drift.union_schema(drift.record_file_steps(df)).cache()
    rows = drift.unify(df, schema).collect()
    assert len(rows) == sum(len(f[3]) for f in files)
    where = {(r["table_name"], r["step_no"], r["field"]): (r["column"], r["type"]) for r in schema.collect()}
    texts = {(no, i): text for no, _, _, records in files for i, text in enumerate(records, 1)}
    for r in rows:
        record = drift.read_record(texts[r["file_no"], r["record_no"]])
        assert r["readable"] == (record is not None)
        if record is None:
            assert r["rescued"] == {"_record": texts[r["file_no"], r["record_no"]]}
            continue
        for k, v in record.items():
            column, kind = where[r["table_name"], r["file_no"], k]
            text = r["cols"][column] if column not in r["rescued"] else r["rescued"][column]
            want = None if v is None else v if isinstance(v, str) and column not in r["rescued"] else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
            assert text == want
    # one column has one name and type in a table
    per_column = {}
    for (t, _, _), (column, kind) in where.items():
        assert per_column.setdefault((t, column), kind) == kind
    wide = drift.feed_table(drift.unify(df, schema), schema, "ta")
    assert wide.count() == sum(drift.read_record(x) is not None for no, t, _, records in files if t == "ta" for x in records)


def test_a_feed_of_many_files_is_cut_into_ranges(spark, request):
    """3,000 files of one feed (and a few of others) with a change every 100 files."""
    text = lambda k: json.dumps({"id": k, f"c{k // 100 % 2}": k, **({"late": "x"} if k >= 1500 else {})})
    files = [(k, "hot", k, [text(k)]) for k in range(3000)] + [(5000 + k, "cold", k, ['{"id":1}']) for k in range(3)]
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would come together in one range
    steps = drift.record_file_steps(files_df(spark, files).repartition(4))
    ranges = drift.in_order(steps)
    assert ranges.filter("subject = 'hot'").select("__part").distinct().count() > 1
    got = {tuple(r) for r in drift.differences(steps).select("step_no", "drift_kind", "field_name").collect()}
    assert got == {(k, "renamed", f"c{(k // 100 - 1) % 2}") for k in range(100, 3000, 100)} | {(1500, "added", "late")}
    schema = drift.union_schema(steps)
    where = {(r["step_no"], r["field"]): r["column"] for r in schema.filter("table_name = 'hot'").collect()}
    assert len(where) == 3000 * 2 + 1500 and {c for (_, f), c in where.items() if f in ("c0", "c1")} == {"c1"}
    rows = drift.unify(files_df(spark, files), schema).collect()
    assert {tuple(sorted(r["cols"])) for r in rows if r["table_name"] == "hot"} == {("c1", "id", "late")}
    assert all(r["cols"]["c1"] == str(r["file_no"]) for r in rows if r["table_name"] == "hot")


def plain_union(steps):
    """(step, field) to (column number, type) of one table's steps [(step, [(name, type)])], by walking all of them."""
    columns, current, out, before = [], {}, {}, []
    for step, now in steps:
        gone = [n for n, _ in before if n not in dict(now)]
        new = [n for n, _ in now if n not in dict(before)]
        for (a, ta), (b, tb) in zip(before, now):
            family = lambda t: "number" if t == "integer" else t
            alike = ta is None or tb is None or family(ta) == family(tb)
            if a in gone and b in new and alike and b not in current:
                current[b] = current.pop(a)
        for n, kind in now:
            if n not in current:
                columns.append(set())
                current[n] = len(columns) - 1
            columns[current[n]] |= {kind} - {None}
            out[step, n] = current[n]
        before = now
    kind_of = lambda s: None if not s else min(s) if len(s) == 1 else "number" if s == {"integer", "number"} else "string"
    return {k: (c, kind_of(columns[c])) for k, c in out.items()}


def test_names_that_come_back(spark):
    r = random.Random(6)
    rows, want = [], {}
    for t in ("ta", "tb", "tc"):
        columns, steps = [("id", "integer"), ("a", "string"), ("b", "number")], []
        for step in range(60):
            what, i = r.choice(("add", "drop", "rename", "rename", "type", "same", "same")), r.randrange(len(columns)) if columns else 0
            name, kind = r.choice("abcdef"), r.choice(("integer", "number", "string", "boolean", None))
            if what == "add" and name not in dict(columns):
                columns = [*columns, (name, kind)]
            elif what == "drop" and len(columns) > 1:
                columns = columns[:i] + columns[i + 1 :]
            elif what == "rename" and name not in dict(columns):
                columns = [*columns[:i], (name, columns[i][1]), *columns[i + 1 :]]
            elif what == "type":
                columns = [*columns[:i], (columns[i][0], kind), *columns[i + 1 :]]
            steps.append((step, columns))
            rows.append(("insert_file", t, t, step, step, [{"name": n, "type": k} for n, k in columns]))
        want[t] = plain_union(steps)
    r.shuffle(rows)
    schema = drift.union_schema(spark.createDataFrame(rows, "origin string, table_name string, subject string, rank int, step_no bigint, columns array<struct<name:string,type:string>>").withColumn("rank", F.col("rank").cast("decimal(20,0)")).repartition(3))
    got = {}
    for x in schema.collect():
        got.setdefault(x["table_name"], {})[x["step_no"], x["field"]] = (x["place"], x["type"])
    assert got == want


def test_renames_chain_and_types_promote(spark):
    files = [(1, "t", 0, ['{"id":1,"old":1,"x":1}']), (2, "t", 1, ['{"id":1,"mid":2.5,"x":"s"}']), (3, "t", 2, ['{"id":1,"new":3,"x":true,"old":"again"}'])]
    df = files_df(spark, files)
    schema = drift.union_schema(drift.record_file_steps(df))
    got = {(r["step_no"], r["field"]): (r["column"], r["type"]) for r in schema.collect()}
    assert got[1, "old"] == got[2, "mid"] == got[3, "new"] == ("new", "number")
    assert got[3, "old"] == ("old", "string") and got[1, "x"] == ("x", "string")
    wide = drift.feed_table(drift.unify(df, schema), schema, "t").orderBy("_file_no")
    assert dict(wide.dtypes)["new"] == "double" and [r["new"] for r in wide.collect()] == [1.0, 2.5, 3.0]
    assert [drift.promote(*p) for p in ((None, "integer"), ("integer", "number"), ("number", "boolean"), ("array", "object"))] == ["integer", "number", "string", "string"]


def test_defined_cases(spark):
    files = [(1, "t", 0, ["not json", None, "[1]", "1", '{"a":NaN}', '{"a":1}']), (2, "t", 1, [None]), (3, "t", 2, ['{"a":null,"b":1}']), (4, "t", 3, ['{"a":"x","b":1}']), (5, None, 3, ['{"z":1}']), (6, "u", None, ["{}"])]
    got = {tuple(r) for r in drift.differences(drift.record_file_steps(files_df(spark, files))).select("step_no", "drift_kind", "field_name").collect()}
    assert got == {(3, "added", "b")}  # nothing but nulls has no type; the next type then isn't a change
    assert drift.differences(drift.record_file_steps(files_df(spark, files).limit(0))).count() == 0
    column = "array<struct<name:string,type_oid:bigint,type_mod:bigint,flags:int>>"
    c = lambda n, t=23: (n, t, -1, 0)
    rel = spark.createDataFrame([(1, 7, "t", 10, [c("id"), c("a"), c("b", 25)]), (2, 7, "t", 30, [c("id"), c("z"), c("b", 20)]), (3, 7, "t", 20, [c("id"), c("a"), c("b", 25)]), (4, None, "t", 5, [c("q")]), (5, 8, "t", 5, None)], f"relation_id bigint, oid bigint, table_name string, lsn bigint, column_list {column}")
    got = {tuple(r) for r in drift.differences(drift.relation_steps(rel)).select("step_no", "drift_kind", "field_name").collect()}
    assert got == {(2, "renamed", "a"), (2, "type_changed", "b")}
    pub = spark.createDataFrame([(1, "t", 1, ["id", "a"]), (2, "t", 2, None), (3, "t", 3, ["b", "id"])], "pub_row_id bigint, table_name string, config_rev int, column_list array<string>")
    got = {tuple(r) for r in drift.differences(drift.publication_steps(pub)).select("step_no", "drift_kind", "field_name").collect()}
    assert got == {(3, "removed", "a"), (3, "added", "b")}


def test_parquet_files_of_drifting_schemas(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    tables = [pa.table({"id": pa.array([1], pa.int32()), "x": pa.array([1], pa.int32())}), pa.table({"id": pa.array([2], pa.int64()), "x": pa.array([1.5], pa.float64()), "y": ["s"]}), pa.table({"id": pa.array([3], pa.int64()), "x": ["text"]})]
    paths = []
    for i, t in enumerate(tables):
        paths.append(str(tmp_path / f"f{i}.parquet"))
        pq.write_table(t, paths[-1])
    kinds = {(r["step_no"], r["drift_kind"], r["field_name"]) for r in drift.differences(drift.parquet_steps(spark, paths, "files")).collect()}
    assert kinds == {(1, "added", "y"), (1, "type_changed", "id"), (1, "type_changed", "x"), (2, "removed", "y"), (2, "type_changed", "x")}
    df = drift.read_parquet_union(spark, paths).orderBy("id")
    assert df.dtypes == [("id", "bigint"), ("x", "string"), ("y", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, "1", None), (2, "1.5", "s"), (3, "text", None)]
