"""Current state and history against a plain replay in Python, over random change logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import history, replay

KEYS = {"wide": ["id", "part"]}


def random_log(seed, n=400, omit_in_moves=True):
    """Valid changes of a few rows, in true order, and the same as delivered: repeated, out of order, some uncommitted."""
    r = random.Random(seed)
    rows, true, live, lsn = [], [], {}, 1000
    key_of = lambda table, row: "|".join(row[c] for c in KEYS.get(table, ["id"]))
    for i in range(n):
        lsn += r.choice((1, 2, 5))
        table = r.choice(("plain", "plain", "wide", "full"))
        mine = [k for t, k in live if t == table]
        hot = f"{table[0]}0" if table != "wide" else f"{table[0]}0|x"
        what = r.random()
        if not mine or what < 0.25:
            ident = f"{table[0]}{r.randint(0, 30)}"
            row = {"id": ident, "a": str(r.randint(0, 3)), "b": None if r.random() < 0.2 else "text", "c": str(r.randint(0, 9))}
            if table == "wide":
                row["part"] = r.choice("xy")
            key = key_of(table, row)
            if (table, key) in live:
                continue
            live[table, key] = row
            true.append((lsn, "I", table, key, dict(row), None, None))
        else:
            key = hot if hot in mine and r.random() < 0.5 else r.choice(mine)
            row = live[table, key]
            ids = {c: row[c] for c in KEYS.get(table, ["id"])}
            if what < 0.4:
                del live[table, key]
                true.append((lsn, "D", table, key, None, "O" if table == "full" else "K", dict(row) if table == "full" else {**dict.fromkeys(row), **ids}))
            elif what < 0.5:
                new = {**row, "id": f"{table[0]}{r.randint(31, 60)}"}
                to = key_of(table, new)
                if (table, to) in live:
                    continue
                del live[table, key]
                live[table, to] = new
                sent = {k: v for k, v in new.items() if k in ("id", "part") or not omit_in_moves or r.random() < 0.5}
                true.append((lsn, "U", table, to, sent, "K", {**dict.fromkeys(row), **ids}))
            else:
                old = dict(row)
                sent = {k: (str(r.randint(0, 3)) if k == "a" else None if k == "b" and r.random() < 0.2 else v) for k, v in row.items() if k in ("id", "part") or r.random() < 0.7}
                row.update(sent)
                true.append((lsn, "U", table, key, sent, "O" if table == "full" else None, old if table == "full" else None))
    xid = 0
    for change in true:
        xid += 1
        lsn_, op, table, key, new, kind, old = change
        for _ in range(r.choice((1, 1, 1, 2, 3))):
            rows.append((r.choice(("s1", "s2")), op, table, xid, lsn_, key, new, kind, old))
    for k in range(30):  # never committed
        rows.append(("s1", "D", "plain", 10_000 + k, 1000 + k, f"p{k}", None, "K", {"id": f"p{k}"}))
    r.shuffle(rows)
    return [(i, *row) for i, row in enumerate(rows, 1)], [(s, x) for s in ("s1", "s2") for x in range(1, xid + 1)], live, true


def versions_of(true):
    live, out = {}, set()
    for lsn, op, table, key, new, kind, old in true:
        if op == "I":
            live[table, key] = dict(new)
            out.add((table, key, lsn))
        elif op == "D":
            live.pop((table, key), None)
        else:
            was = "|".join(old[c] for c in KEYS.get(table, ["id"])) if old else key
            row = live.pop((table, was), {})
            after = {**row, **new}
            if was != key or after != row:
                out.add((table, key, lsn))
            live[table, key] = after
    return out


@pytest.mark.parametrize("seed,hot_rows", [(1, 50_000), (2, 5), (3, 2), (4, 9)])
def test_replay_and_history_equal_a_plain_replay(spark, change_rows, commit_rows, seed, hot_rows):
    rows, committed, live, true = random_log(seed)
    log, commits = change_rows(rows), commit_rows(committed + committed)
    got = {(r["table_name"], r["row_key"]): r["cols"] for r in replay.current_state(log, commits, KEYS, hot_rows=hot_rows).collect()}
    assert got == live
    sat = history.satellite_rows(log, commits, KEYS, hot_rows=hot_rows).cache()
    assert {(r["table_name"], r["row_key"], r["lsn"]) for r in history.opened_versions(sat).collect()} == versions_of(true)
    assert history.opened_versions(sat).count() == len(versions_of(true))
    ended = history.with_end_times(sat)
    # every live row has exactly one valid row in each satellite, with its values
    valid = {}
    for r in ended.filter("valid_to IS NULL").collect():
        part = valid.setdefault((r["table_name"], r["row_key"]), {})
        assert not set(part) & set(r["attrs"])
        part.update(r["attrs"])
    keys = lambda t: set(KEYS.get(t, ["id"]))
    assert valid == {(t, k): {c: v for c, v in row.items() if c not in keys(t)} for (t, k), row in live.items()}
    assert ended.filter("valid_to < valid_from").count() == 0


def test_defined_cases(spark, change_rows, commit_rows):
    commits = commit_rows([("s", x) for x in range(1, 10)])
    log = change_rows([
        (1, "s", "U", "plain", 1, 10, "a", {"id": "a", "v": "1"}, None, None),  # update of an unknown row
        (2, "s", "D", "plain", 2, 11, "gone", None, "K", {"id": "gone"}),  # delete of an unknown row
        (3, "s", "I", "plain", 3, 12, "n", None, None, None),  # null map
        (4, "s", "I", None, 4, 13, "x", {"id": "x"}, None, None),
        (5, "s", "I", "plain", 5, 14, None, {"id": "y"}, None, None),
        (6, "s", "I", "plain", 6, None, "z", {"id": "z"}, None, None),
        (7, "s", "U", "full", 7, 15, "f", {"id": "f", "v": "1"}, "O", {"id": "f", "v": "1"}),  # known by its old image, unaltered
        (8, "s", "U", "full", 8, 16, "f", {"id": "f", "v": None}, "O", {"id": "f", "v": "1"}),
    ]).withColumn("k1", F.lit("clash")).withColumn("seq", F.lit("clash"))
    got = {(r["table_name"], r["row_key"]): (r["lsn"], r["cols"]) for r in replay.current_state(log, commits, KEYS).collect()}
    assert got == {("plain", "a"): (10, {"id": "a", "v": "1"}), ("plain", "n"): (12, {}), ("full", "f"): (16, {"id": "f", "v": None})}
    versions = {tuple(r) for r in history.opened_versions(history.satellite_rows(log, commits, KEYS)).collect()}
    assert versions == {("plain", "a", 10), ("plain", "n", 12), ("full", "f", 16)}
    empty = log.limit(0)
    assert replay.current_state(empty, commits, KEYS).count() == 0 and history.satellite_rows(empty, commits, KEYS).count() == 0
    assert replay.current_state(log, commits.limit(0), KEYS).count() == 0


def test_satellites_split_by_rate(spark, change_rows, commit_rows):
    rows = [(i, "s", "I" if i == 1 else "U", "t", i, i, "a", {"id": "a", "busy": str(i), "calm": "same"}, None, None) for i in range(1, 20)]
    log, commits = change_rows(rows), commit_rows([("s", i) for i in range(1, 20)])
    split = history.split_by_rate(history.change_rates(log), KEYS)
    assert split == {"t": {"busy": "fast", "calm": "slow"}}
    sat = history.satellite_rows(log, commits, KEYS).groupBy("satellite").count().collect()
    assert {r["satellite"]: r["count"] for r in sat} == {"fast": 19, "slow": 1}


def test_moves_are_followed_to_the_end_of_their_chain(spark, change_rows, commit_rows):
    n = 90
    rows = [(0, "s", "I", "plain", 1, 10, "k0", {"id": "k0", "a": "1", "b": None, "c": "0"}, None, None)]
    for i in range(1, n):  # each key is altered once and then moves on
        rows.append((2 * i, "s", "U", "plain", 1, 10 + 2 * i, f"k{i}", {"id": f"k{i}"}, "K", {"id": f"k{i - 1}"}))
        rows.append((2 * i + 1, "s", "U", "plain", 1, 11 + 2 * i, f"k{i}", {"c" if i % 2 else "b": str(i)}, None, None))
    got = replay.current_state(change_rows(rows), commit_rows([("s", 1)]), {}).collect()
    assert [(r["row_key"], r["cols"]) for r in got] == [(f"k{n - 1}", {"id": f"k{n - 1}", "a": "1", "b": str(n - 2), "c": str(n - 1)})]


def test_a_hot_key_that_is_moved_away_and_back(spark, change_rows, commit_rows):
    """Many incomplete moves out of one key with many changes: the walk over its changes answers them all."""
    rows, live, lsn = [(0, "s", "I", "plain", 1, 1, "a", {"id": "a", "x": "0", "y": "0"}, None, None)], {"x": "0", "y": "0"}, 1
    r = random.Random(4)
    for i in range(1, 300):
        here, there = ("a", "b") if i % 2 else ("b", "a")
        for _ in range(3):
            lsn += 1
            c, v = r.choice("xy"), str(r.randint(0, 99))
            live[c] = v
            rows.append((lsn, "s", "U", "plain", 1, lsn, here, {"id": here, c: v}, None, None))
        lsn += 1
        rows.append((lsn, "s", "U", "plain", 1, lsn, there, {"id": there}, "K", {"id": here}))
    r.shuffle(rows)
    got = replay.current_state(change_rows(rows), commit_rows([("s", 1)]), {}, hot_rows=20).collect()
    assert [(x["row_key"], x["cols"]) for x in got] == [("b", {"id": "b", **live})]


def test_more_hot_rows_than_fit_a_list(spark, commit_rows, change_rows):
    """1,500 rows of 8 changes with slices of 2 (and one of 64), against the plain fold."""
    one = spark.range(1500 * 8).selectExpr("id AS delivery_id", "'s' AS slot_name", "if(id < 1500, 'I', 'U') AS op", "'t' AS table_name", "1L AS xid", "cast(id AS decimal(20,0)) AS lsn", "concat('r', id % 1500) AS row_key", "map('id', concat('r', id % 1500), concat('c', id % 7), cast(id AS string)) AS new_decoded", "cast(null AS map<string,string>) AS old_decoded", "cast(null AS string) AS old_kind", "timestamp_ntz'2025-01-01' AS message_time")
    more = one.filter("row_key = 'r3'").selectExpr("delivery_id + 100000 AS delivery_id", "* EXCEPT (delivery_id)")
    for k in range(1, 8):
        more = more.unionByName(one.filter("row_key = 'r3'").selectExpr(f"delivery_id + {k + 1} * 100000 AS delivery_id", "slot_name", "'U' AS op", "table_name", "xid", f"lsn + {k} * 100000 AS lsn", "row_key", "new_decoded", "old_decoded", "old_kind", "message_time"))
    log, commits = one.unionByName(more), commit_rows([("s", 1)])
    counts = replay.profile(log, {})
    assert replay.hot_rows_of(log, counts, 2).count() == 1500
    sizes = replay.sliced(replay.row_events(log, {}, []), replay.hot_rows_of(log, counts, 2)).groupBy("row_key", "slice").agg(F.count_distinct("seq").alias("n")).agg(F.max("n"), F.max("slice")).first()
    assert sizes[0] <= 4 and sizes[1] >= 16
    rows = lambda hot: sorted((r["row_key"], r["lsn"], sorted(r["cols"].items())) for r in replay.current_state(log, commits, {}, hot_rows=hot).collect())
    assert rows(2) == rows(10**6)
    versions = lambda hot: sorted(tuple(r) for r in history.opened_versions(history.satellite_rows(log, commits, {}, hot_rows=hot)).collect())
    assert versions(2) == versions(10**6)


@pytest.mark.parametrize("seed,hot_rows", [(11, 50_000), (12, 6)])
def test_satellites_are_appended_to(spark, change_rows, commit_rows, tmp_path, seed, hot_rows):
    rows, committed, live, true = random_log(seed, 300)
    commits = commit_rows(committed)
    cuts = sorted(r[5] for r in rows)
    ends = [cuts[len(cuts) // 4], cuts[len(cuts) // 2], cuts[-1]]
    sat = history.Satellites(spark, f"file://{tmp_path}/sat", KEYS, hot_rows=hot_rows)
    low = 0
    for end in ends:
        part = [r for r in rows if low < r[5] <= end]
        low = end
        # some of what came before comes again
        again = [r for r in rows if r[5] <= end and r[0] % 13 == 0 and r not in part]
        late = sat.append(change_rows(part + again), commits)
        assert {(r["table_name"], r["row_key"], r["lsn"]) for r in late.collect()} <= {(r[3], r[6], r[5]) for r in again}
    assert {(r["table_name"], r["row_key"], r["lsn"]) for r in history.opened_versions(sat.rows()).collect()} == versions_of(true)
    split = sat._head()["split"]
    whole = history.satellite_rows(change_rows(rows), commits, KEYS, split=split)
    view = lambda df: sorted(((r["table_name"], r["row_key"], r["satellite"], r["lsn"], r["valid_from"], r["valid_to"], r["hash_diff"], sorted(r["attrs"].items())) for r in history.with_end_times(df).collect()), key=str)
    assert view(sat.rows()) == view(whole)


def test_a_late_change_comes_back(spark, change_rows, commit_rows, tmp_path):
    commits = commit_rows([("s", x) for x in range(1, 9)])
    sat = history.Satellites(spark, f"file://{tmp_path}/sat", {})
    row = lambda d, lsn, v: (d, "s", "I" if d == 1 else "U", "t", d, lsn, "a", {"id": "a", "v": v}, None, None)
    assert sat.append(change_rows([row(1, 10, "1"), row(3, 30, "3")]), commits).count() == 0
    late = sat.append(change_rows([row(2, 20, "2"), row(3, 30, "3"), row(4, 40, "4")]), commits)
    assert [r["lsn"] for r in late.collect()] == [20]
    assert [r["lsn"] for r in sat.rows().orderBy("lsn").collect()] == [10, 30, 40]
