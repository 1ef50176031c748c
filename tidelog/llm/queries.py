"""Queries of the text problems (p6 to p8) over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.llm import encoding, mixing, packing


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Sources that may share a container, and columns in which copies of one commit agree.
MAX_SOURCES, CLUSTERS = 4, ("commit_hash",)


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_table(spark, sf, "documents"), _table(spark, sf, "pack_limits"), max_sources=MAX_SOURCES, clusters=CLUSTERS)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf), _table(spark, sf, "pack_limits"))


def p6_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each container size, the texts placed and how often a rule is broken."""
    docs, limits = _table(spark, sf, "documents"), _table(spark, sf, "pack_limits")
    placed = storage.materialize(p6_packed(spark, sf), "packed")
    texts = docs.select("doc_id", "source", "commit_hash", F.xxhash64("text").alias("text"))
    size = placed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("pieces"))
    rows = placed.join(limits, "pack_name").join(size, ["pack_name", "doc_id"]).join(texts, "doc_id")
    # a full container of a cut text holds nothing else
    by = rows.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity_tokens").alias("room"), (F.count("text") - F.count_distinct("text")).alias("copies"), (F.count("commit_hash") - F.count_distinct("commit_hash")).alias("commits"), F.count_distinct("source").alias("sources"))
    held = by.filter("container_id is not null").groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("room")).alias("overfull"), F.sum("copies").alias("copies_together"), F.sum("commits").alias("commits_together"), F.count_if(F.col("sources") > MAX_SOURCES).alias("too_many_sources"))
    whole = rows.groupBy("pack_name").agg(F.count_distinct("doc_id").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("cut_without_need"))
    return whole.join(held, "pack_name")


def p7_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")).drawn()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")).shares()


def p7_shares_first(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached where a mix shrinks until its capped sources can fill theirs."""
    return mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"), prefer="shares").shares()


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each mix and source, how often a text is used too often or unevenly, and whether an open source missed its size by over two texts."""
    mix = mixing.Mixture(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))
    used = mix.drawn().groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.max("n_tokens").alias("n_tokens"))
    by = used.groupBy("mix_name", "source").agg(F.max("uses").alias("most"), F.min("uses").alias("least"))
    largest = mix.texts.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = _table(spark, sf, "mix_targets").join(by, ["mix_name", "source"], "left").join(mix.shares().select("mix_name", "source", "wanted_tokens", "drawn_tokens", "capped", "has_texts"), ["mix_name", "source"]).join(largest, "source", "left")
    off = F.col("has_texts") & ~F.col("capped") & (F.abs(F.col("wanted_tokens") - F.col("drawn_tokens")) > 2 * F.col("largest"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("mix_name", "source", no(F.col("most") > F.col("max_repeats")).alias("too_often"), no(F.col("most") - F.col("least") > 1).alias("uneven"), no(off).alias("off_size"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled(_table(spark, sf, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The original texts, as far as they can be given back."""
    return encoding.garbled(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_audit, p7_drawn, p7_shares, p7_shares_first, p7_audit, p8_found, p8_restored)}

#: Token counts and searches have no SQL; these queries are tested against brute force on small fixtures. What must never happen has.
ORACLE: dict[str, str] = {
    "p6_audit": "SELECT pack_name, (SELECT count(*) FROM documents) AS texts, 0 AS cut_without_need, 0 AS overfull, 0 AS copies_together, 0 AS commits_together, 0 AS too_many_sources FROM pack_limits",
    "p7_audit": "SELECT mix_name, source, false AS too_often, false AS uneven, false AS off_size FROM mix_targets",
}
