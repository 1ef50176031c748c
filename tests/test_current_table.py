"""A keyed table under batches that touch most of its buckets."""

import random

from tidelog.operators.apply import CurrentTable

KIND = "id bigint, seq bigint, op string, v string"


def test_wide_batches_are_laid_beside_the_table_and_merged_together(spark, tmp_path):
    t, want, r, rewritten = CurrentTable(spark, f"file://{tmp_path}/t", ["id"], "seq", buckets=8), {}, random.Random(3), 0
    for batch in range(2 * CurrentTable.LAID + 4):
        before = t._current()["folders"]
        rows = [(r.randrange(60), r.randrange(1000) * 100 + batch, r.choice("IUD"), f"{batch}") for _ in range(40)]
        t.apply(spark.createDataFrame(rows, KIND), batch)
        t.apply(spark.createDataFrame([(1, 10**9, "D", None)], KIND), batch)  # the batch came already
        rewritten += t._current()["folders"] != before
        for k, s, op, v in rows:
            if k not in want or s > want[k][0]:
                want[k] = (s, op, v)
        if batch % 5 == 0 or batch > 2 * CurrentTable.LAID:
            assert {(x["id"], x["seq"], x["v"]) for x in t.rows().collect()} == {(k, s, v) for k, (s, op, v) in want.items() if op != "D"}
    assert rewritten == 3  # the first batch, and twice those laid beside it
    # a narrow batch with a column more takes along what was laid down
    t.apply(spark.createDataFrame([(7, 10**8, "I", "n", "e")], KIND + ", extra string"), 99)
    assert not t._current()["laid"] and t.rows().filter("id = 7").first()["extra"] == "e"
    assert t.rows().count() == sum(op != "D" for k, (_, op, _) in want.items() if k != 7) + 1
