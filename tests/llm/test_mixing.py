import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.DEFAULT_RANKS), reason="no tokenizer")
TARGET = "mix_name string, source string, target_weight double, max_repeats int, size_factor double"


def documents(spark):
    r = random.Random(4)
    rows = [(i, r.choice("aaaaaab"), " ".join(f"w{r.randint(0, 9999)}" for _ in range(r.randint(5, 60)))) for i in range(1500)]
    rows += [(5000 + i, "c", f"rare text number {i}") for i in range(20)] + [(6000 + i, "c", "the same text") for i in range(10)]
    rows += [(7000, None, "no source"), (7001, "a", None), (7002, "a", ""), (None, "a", "no id"), (7003, "empty", "")]
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id bigint, source string, text string, mix_name string, copies int"), rows


def test_shares_and_repeats(spark):
    df, rows = documents(spark)
    targets = spark.createDataFrame([("m", "a", 3.0, None, 0.5), ("m", "b", 2.0, 3, 0.5), ("m", "c", 5.0, 2, 0.5), ("m", "gone", 1.0, None, 0.5), ("m", "empty", 1.0, None, 0.5), ("n", "b", 1.0, None, 3.0), ("n", "a", None, None, 3.0), ("n", "c", float("nan"), 1, 3.0), (None, "a", 1.0, 1, 1.0), ("z", "c", 1.0, 0, 1.0)], TARGET)
    mix = mixing.Mixture(df, targets)
    drawn = mix.drawn().cache()
    total = sum(tokens.count(t) for _, _, t in rows)
    size = {}
    for d, s, t in {(None, s, t) for _, s, t in rows}:
        size[s] = size.get(s, 0) + tokens.count(t)
    got = {(r["mix_name"], r["source"]): r for r in mix.shares().collect()}
    for (m, s), r in got.items():
        mine = drawn.filter((F.col("mix_name") == m) & (F.col("source") == s))
        assert (mine.agg(F.sum("n_tokens")).first()[0] or 0) == r["drawn_tokens"]
        uses = [x["count"] for x in mine.groupBy("doc_id").count().collect()]
        # floor or ceil of one expectation
        assert not uses or max(uses) - min(uses) <= 1
    assert abs(got["m", "a"]["drawn_tokens"] - total * 0.5 * 3 / 12) < 250 and abs(got["m", "b"]["drawn_tokens"] - total * 0.5 * 2 / 12) < 250
    c = got["m", "c"]
    assert c["capped"] and c["most_uses"] == 2 and c["drawn_tokens"] == 2 * size["c"]
    assert not got["m", "gone"]["has_texts"] and got["m", "empty"]["drawn_tokens"] == 0 and got["z", "c"]["drawn_tokens"] == 0
    assert abs(got["n", "b"]["drawn_tokens"] - 3 * total) < 2000 and got["n", "a"]["drawn_tokens"] == 0
    assert {r["mix_name"] for r in drawn.select("mix_name").distinct().collect()} == {"m", "n"}
    # identical texts count as one
    assert drawn.filter("mix_name = 'm' and doc_id >= 6000 and doc_id < 6010").select("doc_id").distinct().count() == 1
    assert sum(r["actual_share"] for (m, _), r in got.items() if m == "m") == pytest.approx(1, abs=1e-4)
    again = mixing.Mixture(df.repartition(5), targets).drawn()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))


def test_places_equal_a_plain_order(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.randint(1, 5000)) for i in range(2000)]
    texts = spark.createDataFrame(rows, "source string, doc_id bigint, n_tokens int")
    for block_rows in (10, 100_000):
        got = mixing.ranked(texts, len(rows), block_rows).collect()
        for s in "ab":
            assert sorted(x["place"] for x in got if x["source"] == s) == list(range(1, sum(x[0] == s for x in rows) + 1))


def test_systematic_sampling_is_unbiased():
    uses = {}
    for seed in range(400):
        p = mixing.plan([{"mix_name": "m", "source": "s", "target_weight": 1.0, "max_repeats": None, "size_factor": 0.37}], {"s": 100}, 100, seed)[0]
        for place in range(1, 11):
            n = (place * p["expected"] + p["offset"]) // mixing.UNIT - ((place - 1) * p["expected"] + p["offset"]) // mixing.UNIT
            assert n in (0, 1)
            uses[place] = uses.get(place, 0) + n
    assert all(abs(n / 400 - 0.37) < 0.09 for n in uses.values())


def test_shares_first(spark):
    df, _ = documents(spark)
    targets = spark.createDataFrame([("m", "a", 3.0, None, 0.5), ("m", "b", 2.0, 3, 0.5), ("m", "c", 5.0, 20, 0.5), ("m", "gone", 1.0, 1, 0.5)], TARGET)
    size = {(r["mix_name"], r["source"]): r for r in mixing.Mixture(df, targets).shares().collect()}
    shares = {(r["mix_name"], r["source"]): r for r in mixing.Mixture(df, targets, prefer="shares").shares().collect()}
    assert size["m", "c"]["capped"] and not any(r["capped"] for r in shares.values())
    for s, want in (("a", 0.3), ("b", 0.2), ("c", 0.5)):
        assert abs(shares["m", s]["actual_share"] - want) < 0.02
    assert shares["m", "c"]["most_uses"] == 20 and shares["m", "c"]["drawn_tokens"] == size["m", "c"]["drawn_tokens"]
    with pytest.raises(ValueError):
        mixing.plan([], {}, 0, 1, "neither")


def test_a_text_in_several_sources(spark):
    rows = [(i, s, f"text number {i % 40}") for i, s in enumerate("abc" * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = lambda *caps: spark.createDataFrame([("m", s, 1.0, c, 9.0) for s, c in zip("abc", caps)], TARGET)
    text_of = dict((d, t) for d, _, t in rows)
    for caps, most in (((2, 3, 1), 3), ((2, None, 1), None)):
        uses = {}
        for r in mixing.Mixture(df, targets(*caps)).uses().collect():
            uses[text_of[r["doc_id"]]] = uses.get(text_of[r["doc_id"]], 0) + r["copies"]
        assert set(uses.values()) == {3} if most else min(uses.values()) > 3


def test_empty_tables(spark):
    df, _ = documents(spark)
    targets = spark.createDataFrame([("m", "a", 1.0, None, 1.0)], TARGET)
    assert mixing.Mixture(df.limit(0), targets).drawn().count() == 0
    assert mixing.Mixture(df, targets.limit(0)).drawn().count() == 0 and mixing.Mixture(df, targets.limit(0)).shares().count() == 0
