"""Mix sources to target weights by systematic sampling.

For each mix, a source's wanted size is its share of the weights times the wanted
total. Every text of the source then has the same expected number of uses: wanted
size over the source's size, never more than ``max_repeats``. The expected uses are
summed up text by text within the source, one random offset is added, and a text is
used once for each whole number its stretch of the sum crosses. So each text is used
floor or ceil of its expectation, and the source's size comes out as wanted, give or
take about its largest text. Texts lie in order of size along the sum, so all sizes
are drawn in proportion.

The prefix sum is made in two levels, blocks of at most some ten thousand texts and
texts within a block; no task ever sees a whole source. Sums are whole millionths,
so they don't depend on the order of additions.

Identical texts of a source count as one text, named by its smallest id: otherwise a
copy could be used more often than ``max_repeats`` allows. A text that several sources
hold is used no more often in all than the most generous of them allows.

Where ``max_repeats`` binds, size and shares can't both come out as wanted. With
``prefer="size"`` the source stays below its share and the others keep their sizes;
with ``prefer="shares"`` the whole mix shrinks until every source that has texts can
fill its share.

Defined cases: weights are divided by their sum, null, negative and zero ones count
as none; a source without texts, or without tokens, yields nothing and is reported;
sources without a target aren't drawn; several targets of one source in a mix add up,
under the smallest cap. The targets are configuration, which the driver reads.
"""

from __future__ import annotations

import math
from hashlib import blake2b

from pyspark.sql import DataFrame, Window, functions as F

from tidelog import storage
from tidelog.llm.tokens import DEFAULT_RANKS, with_sizes

UNIT = 1_000_000


def plan(targets: list[dict], sizes: dict[str, int], total: int, seed: int, prefer: str = "size") -> list[dict]:
    """Per (mix, source): wanted size, expected uses of a text in millionths, and the random offset."""
    if prefer not in ("size", "shares"):
        raise ValueError(f"neither size nor shares: {prefer!r}")
    mixes: dict[str, dict] = {}
    for t in targets:
        if t["mix_name"] is None or t["source"] is None:
            continue
        weight = t["target_weight"]
        weight = weight if weight is not None and math.isfinite(weight) and weight > 0 else 0.0
        mix = mixes.setdefault(t["mix_name"], {"factor": 0.0, "sources": {}})
        mix["factor"] = max(mix["factor"], t["size_factor"] or 0.0)
        one = mix["sources"].setdefault(t["source"], {"weight": 0.0, "cap": None})
        one["weight"] += weight
        if t["max_repeats"] is not None:
            one["cap"] = min(x for x in (one["cap"], max(0, t["max_repeats"])) if x is not None)
    out = []
    for name, mix in sorted(mixes.items()):
        weights = sum(s["weight"] for s in mix["sources"].values())
        whole = mix["factor"] * total
        if prefer == "shares":
            most = [s["cap"] * sizes[n] * weights / s["weight"] for n, s in mix["sources"].items() if s["cap"] is not None and s["weight"] and sizes.get(n)]
            whole = min([whole, *most])
        for source, s in sorted(mix["sources"].items()):
            share = s["weight"] / weights if weights else 0.0
            wanted = share * whole
            size = sizes.get(source, 0)
            expected = wanted / size if size else 0.0
            capped = s["cap"] is not None and expected > s["cap"] * (1 + 1e-12)
            expected = s["cap"] if capped else expected
            offset = int.from_bytes(blake2b(f"{seed}|{name}|{source}".encode(), digest_size=8).digest(), "big") % UNIT
            out.append({"mix_name": name, "source": source, "target_share": share, "wanted_tokens": int(round(wanted)), "expected": int(round(expected * UNIT)), "offset": offset, "capped": capped, "has_texts": size > 0, "cap": s["cap"]})
    return out


_PLAN = "mix_name string, source string, target_share double, wanted_tokens bigint, expected bigint, offset bigint, capped boolean, has_texts boolean, cap int"


def _texts(documents: DataFrame, ranks_path: str) -> tuple[DataFrame, int]:
    """Distinct texts of each source (source, doc_id, n_tokens), and the size of all documents."""
    sizes = storage.materialize(with_sizes(documents, ["doc_id", "source"], ranks_path), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    texts = sizes.filter("n_tokens > 0 and source is not null and doc_id is not null").groupBy("source", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
    # a text has one row a source, so its rows are few
    held = F.count(F.lit(1)).over(Window.partitionBy("k1", "k2"))
    return storage.materialize(texts.withColumn("shared", F.when(held > 1, F.struct("k1", "k2"))).drop("k1", "k2"), "texts"), total


def ranked(texts: DataFrame, rows: int, block_rows: int = 20_000) -> DataFrame:
    """Each text's place (1, 2, ...) in its source, by size class; two levels, see the module's text."""
    buckets = max(1, -(-rows // block_rows))
    placed = texts.withColumns({"size_class": F.floor(F.log2(F.col("n_tokens").cast("double")) * 4).cast("int"), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets))})
    block = ["source", "size_class", "bucket"]
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    # the classes of a source are some ten, the blocks of a class a share of the source's texts / block_rows
    earlier = lambda part, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("source", "size_class").agg(F.sum("n").alias("n")).select("source", "size_class", earlier(["source"], "size_class").alias("__classes"))
    before = counts.withColumn("__blocks", earlier(["source", "size_class"], "bucket")).join(classes, ["source", "size_class"]).select(*block, (F.col("__blocks") + F.col("__classes")).alias("before"))
    within = placed.withColumn("place", F.row_number().over(Window.partitionBy(*block).orderBy("n_tokens", F.xxhash64(F.lit(7), "doc_id"), "doc_id")))
    joined = within.join(before, block)
    return joined.select("source", "doc_id", "n_tokens", *(["shared"] if "shared" in texts.columns else []), (F.coalesce("before", F.lit(0)) + F.col("place")).alias("place"))


class Mixture:
    """The drawn texts and the report, from one pass over the documents."""

    def __init__(self, documents: DataFrame, targets: DataFrame, *, seed: int = 1, prefer: str = "size", ranks_path: str = DEFAULT_RANKS):
        self.spark = documents.sparkSession
        rows = [r.asDict() for r in targets.collect()]
        self.texts, total = _texts(documents, ranks_path)
        named = sorted({r["source"] for r in rows if r["source"] is not None})
        # one row for each source that has a target
        per_source = self.texts.filter(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        self.rows = sum(r["n"] for r in per_source)
        self.plan = plan(rows, {r["source"]: r["size"] for r in per_source}, total, seed, prefer)

    def _plan(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(p.values()) for p in self.plan], _PLAN)

    def uses(self) -> DataFrame:
        """(mix_name, source, doc_id, n_tokens, copies) of the texts used."""
        both = ranked(self.texts, self.rows).join(self._plan().select("mix_name", "source", "expected", "offset", "cap"), "source")
        crossed = lambda place: F.floor((place * F.col("expected") + F.col("offset")) / F.lit(UNIT).cast("decimal(10,0)")).cast("bigint")
        place = F.col("place").cast("decimal(20,0)")
        used = both.withColumn("copies", crossed(place) - crossed(place - 1)).filter("copies > 0")
        own, shared = used.filter("shared is null"), used.filter("shared is not null")
        text = Window.partitionBy("mix_name", "shared")  # one row a source
        most = F.when(F.count(F.when(F.col("cap").isNull(), 1)).over(text) == 0, F.max("cap").over(text))
        before = F.coalesce(F.sum("copies").over(text.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = shared.withColumns({"most": most, "before": before})
        left = left.withColumn("copies", F.when(F.col("most").isNull(), F.col("copies")).otherwise(F.least("copies", F.greatest(F.col("most") - F.col("before"), F.lit(0))))).filter("copies > 0")
        columns = ["mix_name", "source", "doc_id", "n_tokens", "copies"]
        return own.select(*columns).unionByName(left.select(*columns))

    def drawn(self) -> DataFrame:
        """(mix_name, source, doc_id, copy_no, n_tokens): one row for each use of a text."""
        return self.uses().select("mix_name", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")

    def shares(self) -> DataFrame:
        """Per mix and source, the share wanted and the share reached."""
        got = self.uses().groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_uses"))
        rows = self._plan().join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        whole = Window.partitionBy("mix_name")
        return rows.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(whole)), F.lit(0.0)), 6).alias("actual_share"), "wanted_tokens", F.col("tokens").cast("bigint").alias("drawn_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "capped", "has_texts")
