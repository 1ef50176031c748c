import random

from pyspark.sql import functions as F

from tidelog import storage
from tidelog.operators import dedup

SCHEMA = "slot_name string, lsn bigint, note string, msg bigint"


def expected(rows):
    first, out = {}, set()
    for s, l, n, i in rows:
        if i is None:
            continue
        k = (s, l)
        if k in first:
            out.add(max(first[k], i))
            first[k] = min(first[k], i)
        else:
            first[k] = i
    return out


def write(spark, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def surplus(spark, folder, store, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    df = dedup.surplus_copies(stream, ["slot_name", "lsn"], "msg", F.col("lsn") / 10, horizon=5, store=store, checkpoint=checkpoint)
    return [r["id"] for r in df.collect()]


def test_copies_across_batches_late_and_out_of_order(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(600):
        lsn = i // 4
        rows.append((r.choice(("a", "b", None)), lsn if r.random() < 0.8 else max(0, lsn - r.randint(0, 120)), "n", i))
    rows += [("a", 3, None, 900), ("a", 3, None, None), ("hot", 1, "h", 901), *(("hot", 1, "h", 1000 + k) for k in range(200))]
    parts = [rows[a : a + 120] for a in range(0, len(rows), 120)]
    # the third batch arrives before the second: smaller ids come later
    parts[1], parts[2] = parts[2], parts[1]
    folder, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    store = dedup.SeenStore(spark, storage.fresh_dir(spark, "test"), max_pieces=1)
    for part in parts[:4]:
        write(spark, folder, [part])
        surplus(spark, folder, store, cp)
    for part in parts[4:]:
        write(spark, folder, [part])
    got = surplus(spark, folder, store, cp)
    assert len(got) == len(set(got)) and set(got) == expected(rows)
    log = store.log()
    assert log["watermark"] is not None and log["counts"]["batches"] >= 5
    assert min(log["counts"].values()) > 0 and all(len(p) == 1 for p in log["live"].values())
    # only what isn't expired stays in the commit file
    assert all(int(f.split("=")[1]) >= log["watermark"] for f in log["live"])
    # running it again changes nothing
    assert sorted(surplus(spark, folder, store, cp)) == sorted(got)


def test_a_batch_that_died_is_redone(spark):
    store = dedup.SeenStore(spark, storage.fresh_dir(spark, "test"))
    batch = spark.createDataFrame([(1, 1, 10, 0), (1, 1, 11, 0), (2, 2, 12, 0)], "k1 bigint, k2 bigint, id bigint, slot bigint")
    # half of batch 0 was written, but not committed
    batch.limit(1).write.parquet(f"{store.path}/surplus/batch=0")
    assert store.surplus().count() == 0
    store.process(batch, 0, 2)
    store.process(batch, 0, 2)
    assert [r["id"] for r in store.surplus().collect()] == [11]


def test_empty_stream_and_single_file(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(folder)
    assert surplus(spark, folder, None, None) == []
    import glob

    file = glob.glob(f"{folder}/*.parquet")
    spark.createDataFrame([("a", 1, None, 1), ("a", 1, None, 2)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
    file = glob.glob(f"{folder}/*.parquet")[0]
    df = dedup.surplus_copies(dedup.read_as_stream(spark, file), ["slot_name", "lsn"], "msg", F.col("lsn"), horizon=1)
    assert [r["id"] for r in df.collect()] == [2]


def test_copies_without_a_position_across_batches(spark, tmp_path):
    parts = [[("a", None, "n", 5), (None, None, "n", 6), ("a", 1, "n", 7)], [("a", 900, "n", 8), ("a", None, "n", 9)], [("a", None, "n", 2), (None, None, "n", 10), ("b", None, "n", 11)], [("b", None, "n", 12), ("a", 1, "n", 13)]]
    folder = str(tmp_path / "in")
    store = dedup.SeenStore(spark, storage.fresh_dir(spark, "test"), max_pieces=1)
    for part in parts:
        write(spark, folder, [part])
        got = surplus(spark, folder, store, str(tmp_path / "cp"))
    assert sorted(got) == sorted(expected([r for part in parts for r in part])) == [5, 9, 10, 12, 13]


def test_a_backlog_goes_through_many_batches(spark):
    r = random.Random(3)
    rows = [("a", r.randint(max(0, i // 3 - 60), i // 3), "n", i) for i in range(3000)] + [("hot", 5, None, 3000 + i) for i in range(1500)] + [("a", None, "n", 5000), ("a", None, "n", 5001)]
    store = dedup.SeenStore(spark, storage.fresh_dir(spark, "test"))
    got = dedup.surplus_in_backlog(spark.createDataFrame(rows, SCHEMA).repartition(5), ["slot_name", "lsn"], "msg", F.floor(F.col("lsn") / 20), horizon=1, store=store)
    ids = [x["id"] for x in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == expected(rows)
    counts = store.log()["counts"]
    assert counts["batches"] > 10 and counts["pieces_read"] > 0 and counts["late_lookups"] > 0 and counts["expired"] > 0
    assert dedup.surplus_in_backlog(spark.createDataFrame([], SCHEMA), ["slot_name", "lsn"], "msg", F.col("lsn"), horizon=1).count() == 0


def test_a_stream_killed_between_writing_and_committing_goes_on(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    rows = [("a", r.randint(max(0, i - 90), i) // 4, "n", i) for i in range(600)]
    folder, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    write(spark, folder, [rows[a : a + 100] for a in range(0, 600, 100)])
    store = dedup.SeenStore(spark, storage.fresh_dir(spark, "test"))
    swap, calls = storage.swap_text, []

    def dying(spark, path, text):
        if path.endswith("COMMITTED") and len(calls) < 6:
            calls.append(path)
            if len(calls) in (2, 5):
                raise RuntimeError("killed")
        swap(spark, path, text)

    monkeypatch.setattr(storage, "swap_text", dying)
    got = None
    for _ in range(3):
        try:
            got = surplus(spark, folder, store, cp)
        except Exception as e:
            assert "killed" in str(e)
    assert len(calls) == 6 and len(got) == len(set(got)) and set(got) == expected(rows)
