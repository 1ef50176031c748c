from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidelog import storage
from tidelog.operators import incremental

SCHEMA = "id string, part int, body map<string,string>, n int"


def state(spark):
    return incremental.IncrementalState(spark, storage.fresh_dir(spark, "test"))


def run(spark, st, rows, fail=False, log=None):
    seen = []

    def sink(df, version):
        seen.extend((r["id"], r["record_status"]) for r in df.collect())
        if fail:
            raise OSError("lost")

    df = spark.createDataFrame(rows, SCHEMA).withColumn("record", F.lit(1)).withColumn("slot_name", F.lit("x"))
    incremental.run(st, df, ["id", "part"], ["body", "n"], sink)
    return sorted(seen, key=str)


def test_only_new_and_changed_records(spark):
    st = state(spark)
    a, b = ("a", 1, {"x": "1", "y": None}, 1), ("b", None, None, None)
    assert run(spark, st, [a, b, b]) == [("a", "new"), ("b", "new")]
    assert st.version == 1 and run(spark, st, [a, b]) == []
    # null differs from absent and from empty; the order of a map's entries means nothing
    assert run(spark, st, [("a", 1, {"y": None, "x": "1"}, 1), b]) == []
    assert run(spark, st, [("a", 1, {"x": "1"}, 1), ("b", None, {}, None)]) == [("a", "changed"), ("b", "changed")]
    assert run(spark, st, [("a", None, {"x": "1"}, 1)]) == [("a", "new")]
    # what a run doesn't see stays known
    assert run(spark, st, [("b", None, {}, None)]) == []
    assert run(spark, st, []) == []
    assert st.version == 7 and st.table().count() == 3


def test_a_failed_run_is_taken_again(spark):
    st = state(spark)
    rows = [("a", 1, None, 1), ("b", 1, None, 1)]
    with pytest.raises(OSError):
        run(spark, st, rows, fail=True)
    assert st.version == 0
    assert run(spark, st, rows) == [("a", "new"), ("b", "new")]
    with pytest.raises(OSError):
        run(spark, st, rows + [("c", 1, None, 1)], fail=True)
    assert run(spark, st, rows + [("c", 1, None, 2)]) == [("c", "new")]


def test_two_runs_at_once(spark):
    st = state(spark)
    df = incremental.hashed(spark.createDataFrame([("a", 1, None, 1)], SCHEMA), ["id"], ["n"])
    st.commit(df, 0)
    with pytest.raises(incremental.ConcurrentRun):
        st.commit(df, 0)
    assert st.version == 1 and st.table().count() == 1


def test_of_runs_that_commit_in_the_same_moment_one_does(spark):
    st = state(spark)
    df = incremental.hashed(spark.createDataFrame([("a", 1, None, 1)], SCHEMA), ["id"], ["n"])
    path = f"{st.path}/V1"
    assert [storage.put_text(spark, path, x) for x in ("1", "2")] == [True, False] and storage.read_text(spark, path) == "1"
    storage.delete(spark, path)

    def commit(_):
        try:
            return st.commit(df, 0)
        except incremental.ConcurrentRun:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(commit, range(4)), key=str) == [1, None, None, None]
    assert st.version == 1 and len(storage.children(spark, st.path)) >= 2 and st.table().count() == 1


def test_state_is_a_list_of_deltas_and_outlives_a_cleanup(spark, tmp_path):
    st = incremental.IncrementalState(spark, f"file://{tmp_path}/state", max_deltas=3)
    run(spark, st, [("a", 1, None, 1), ("b", 1, None, 1)])
    run(spark, st, [("a", 1, None, 2), ("b", 1, None, 1)])
    sizes = [spark.read.parquet(f"{st.path}/{d}").count() for d in st._deltas(2)]
    assert sizes == [2, 1]  # only what changed was written
    storage.cleanup(spark)
    assert run(spark, st, [("a", 1, None, 2), ("b", 1, None, 1)]) == []
    for n in range(3, 8):
        assert run(spark, st, [("a", 1, None, n), ("b", 1, None, 1)]) == [("a", "changed")]
    assert len(st._deltas(st.version)) <= 3 and st.table().count() == 2
    # only the last two versions and their deltas are left
    left = storage.children(spark, st.path)
    assert [n for n in left if n[0] == "V"] == [f"V{st.version - 1}", f"V{st.version}"]
    assert {n for n in left if n.startswith("delta")} == {*st._deltas(st.version), *st._deltas(st.version - 1)}


def test_a_message_that_changed_since_it_was_confirmed(spark, change_rows, tmp_path):
    info = spark.createDataFrame([("s", 1, "done", "0/10"), ("s", 2, "done", "0/20"), ("s", 3, "failed", "0/99")], "slot_name string, run_no int, run_status string, confirmed_flush_lsn string")
    commits = spark.createDataFrame([("s", x, x) for x in (0x10, 0x18, 0x20, 0x28)], "slot_name string, xid bigint, commit_lsn bigint")
    rows = [(i, "s", "I", "t", x, i, f"k{i}", {"id": f"k{i}", "v": "1"}, None, None) for i, x in enumerate((0x10, 0x18, 0x20, 0x28), 1)]
    st = incremental.IncrementalState(spark, f"file://{tmp_path}/slots")
    got = incremental.unconfirmed_messages(change_rows(rows), commits, info, state=st).collect()
    assert [tuple(r) for r in got] == [("s", 4, "t", "k4", "new")] and st.version == 2
    assert [spark.read.parquet(f"{st.path}/{d}").count() for d in st._deltas(2)] == [1, 2]
    # the state is on record: another content of a confirmed message is told from a new message
    rows[1] = (*rows[1][:7], {"id": "k2", "v": "2"}, None, None)
    hashed = incremental.committed_messages(change_rows(rows), commits, incremental.run_positions(info, 1))
    k1, k2 = incremental.hash128(hashed, incremental.MESSAGE)
    again = st.select(hashed.withColumns({incremental.K1: k1, incremental.K2: k2}))
    assert sorted((r["row_key"], r["record_status"]) for r in again.collect()) == [("k2", "changed"), ("k4", "new")]


def test_positions_and_messages(spark, change_rows, commit_rows):
    info = spark.createDataFrame(
        [("s", 1, "done", "0/10"), ("s", 2, "done", " 0000/0020 "), ("s", 3, "done", ""), ("s", 4, "done", None), ("s", 5, "failed", "0/99"), ("s", 2, "done", "0/20"), ("t", 1, "failed", "0/99"), (None, 1, "done", "0/1"), ("s", None, None, "0/88")],
        "slot_name string, run_no int, run_status string, confirmed_flush_lsn string",
    )
    assert [(r[0], int(r[1])) for r in incremental.confirmed_positions(info).collect()] == [("s", 0x20)]
    log = change_rows([(1, "s", "I", "t", 1, 5, "a", {"id": "a"}, None, None), (2, "s", "I", "t", 2, 6, "b", {"id": "b"}, None, None), (3, "s", "I", "t", 2, 6, "b", {"id": "b"}, None, None), (4, "t", "I", "t", 1, 5, "a", {"id": "a"}, None, None), (5, "s", "I", "t", 9, 7, "c", None, None, None)])
    commits = spark.createDataFrame([("s", 1, 0x20), ("s", 2, 0x21), ("s", 2, 0x21), ("t", 1, 0x20), ("s", 9, None)], "slot_name string, xid bigint, commit_lsn bigint")
    got = sorted(tuple(r)[:4] for r in incremental.unconfirmed_messages(log, commits, info).collect())
    assert got == [("s", 6, "t", "b"), ("t", 5, "t", "a")]
    assert incremental.unconfirmed_messages(log.limit(0), commits, info).count() == 0
