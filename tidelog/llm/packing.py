"""Fill containers of fixed capacity with texts, leaving as little room as possible.

Conflict-constrained best fit: items are taken from large to small, and each goes
into the tightest container that can take it. Containers are kept in order of the
room they have left; the search starts at the item's size and goes on to the next
larger room until a compatible container is found. Each container carries a bitmap
of its sources and one of its duplicate clusters: two texts of one cluster never
share a container, and a container may be limited to some number of sources.
Clusters are groups of identical texts, and groups that agree in one of the columns
named for that (``clusters``; the same commit may have come several times, with
other line ends or headers).

All copies of a text are placed in one go, and containers that received one are
set aside until the copies are done. So copies of any number cost one successor
step each instead of a look at every container that already holds one.

Texts are spread over shards of a fixed number of texts by a hash of their id, and
each (container size, shard) is packed by one task. A shard leaves a few containers
partly filled, out of thousands, whatever the number of shards.

Defined cases: a text is cut only if it alone exceeds the capacity, into full
containers and one rest that is packed like any text; texts of no tokens need no
container and come out with a null one; equal sizes are taken in order of cluster
and id, so the result doesn't depend on the order of rows; a text id that occurs
twice is two texts; capacities below 1 are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog import storage
from tidelog.llm.tokens import DEFAULT_RANKS, with_sizes


class Bins:
    """Containers of one capacity in order of the room left."""

    def __init__(self, capacity: int, max_sources: int | None = None):
        self.capacity, self.max_sources = capacity, max_sources
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set where some container has room r

    def _put(self, b: int) -> None:
        r = self.room[b]
        at = self.by_room.setdefault(r, [])
        at.append(b)
        self.rooms |= 1 << r

    def _take(self, r: int, i: int) -> int:
        at = self.by_room[r]
        b = at[i]
        at[i] = at[-1]
        at.pop()
        if not at:
            self.rooms &= ~(1 << r)
        return b

    def _compatible(self, b: int, source: int, cluster: int) -> bool:
        if self.clusters[b] & cluster:
            return False
        return self.max_sources is None or (self.sources[b] | source).bit_count() <= self.max_sources

    def _tightest(self, size: int, source: int, cluster: int) -> int | None:
        r, above = size, self.rooms >> size
        while above:
            step = (above & -above).bit_length() - 1
            r, above = r + step, above >> step
            at = self.by_room[r]
            for i in range(len(at) - 1, -1, -1):
                if self._compatible(at[i], source, cluster):
                    return self._take(r, i)
            r, above = r + 1, above >> 1
        return None

    def place(self, size: int, sources: list[int], clusters: list[int]) -> list[int]:
        """Containers for the copies of one text (one entry of ``sources`` and ``clusters`` each, as bits), all different."""
        held = []
        for source, cluster in zip(sources, clusters):
            b = self._tightest(size, source, cluster)
            if b is None:
                b = len(self.room)
                self.room.append(self.capacity)
                self.sources.append(0)
                self.clusters.append(0)
            self.room[b] -= size
            self.sources[b] |= source
            self.clusters[b] |= cluster
            held.append(b)
        for b in held:
            if self.room[b]:
                self._put(b)
        return held


def pack(items: list[tuple], capacity: int, max_sources: int | None = None) -> list[tuple]:
    """(container, item index, piece, start, size) for items (size, source, text, id, *other clusters)."""
    out: list[tuple] = []
    rest: list[tuple] = []
    for i, (size, _, cluster, ident, *_more) in enumerate(items):
        whole, left = divmod(size, capacity) if size > capacity else (0, size)
        out += [(None, i, k, k * capacity, capacity) for k in range(whole)]
        if left:
            rest.append((-left, cluster, ident, i, whole, size - left))
        elif not size:
            out.append((-1, i, 0, 0, 0))
    rest.sort()
    of = [[(0, r[1]), *((k, c) for k, c in enumerate(items[r[3]][4:], 1) if c is not None)] for r in rest]
    copies = Counter(c for mine in of for c in mine)
    bits: dict = {}
    source_bits: dict = {}
    bins = Bins(capacity, max_sources)

    def bitmap(mine: list[tuple]) -> int:
        out = 0
        for c in mine:
            if copies[c] > 1:  # a cluster of one can't conflict
                out |= bits.setdefault(c, 1 << len(bits))
        return out

    at = 0
    while at < len(rest):
        end = at + 1
        while end < len(rest) and rest[end][:2] == rest[at][:2]:
            end += 1
        sources = [source_bits.setdefault(items[r[3]][1], 1 << len(source_bits)) for r in rest[at:end]]
        for r, b in zip(rest[at:end], bins.place(-rest[at][0], sources, [bitmap(mine) for mine in of[at:end]])):
            out.append((b, r[3], r[4], r[5], -r[0]))
        at = end
    # full containers of cut texts follow the others
    number = len(bins.room)
    for k, row in enumerate(out):
        if row[0] is None:
            out[k] = (number, *row[1:])
            number += 1
    return out


_OUT = pa.schema([("pack_name", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int32()), ("n_tokens", pa.int32())])
_OUT_SQL = "pack_name string, container_id bigint, doc_id bigint, piece_no int, token_start int, n_tokens int"


def packed(documents: DataFrame, limits: DataFrame, *, ranks_path: str = DEFAULT_RANKS, shard_rows: int = 25_000, max_sources: int | None = None, clusters: tuple[str, ...] = ()) -> DataFrame:
    """(pack_name, container_id, doc_id, piece_no, token_start, n_tokens): where each text goes, for every container size.

    A row of ``limits`` is one container size: configuration, which the driver reads.
    """
    packs = {r["pack_name"]: r["capacity_tokens"] for r in limits.collect()}
    if any(c is None or c < 1 for c in packs.values()):
        raise ValueError("a capacity must be 1 at least")
    spark = documents.sparkSession
    if not packs:
        return spark.createDataFrame([], _OUT_SQL)
    others = [f"__c{i}" for i in range(len(clusters))]
    sizes = storage.materialize(with_sizes(documents.select("doc_id", "source", "text", *(F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(5), c)).alias(f"__c{i}") if c in documents.columns else F.lit(None).cast("bigint").alias(f"__c{i}") for i, c in enumerate(clusters))), ["doc_id", "source", *others], ranks_path), "sizes")
    shards = max(1, -(-sizes.count() // shard_rows))
    rows = sizes.select("doc_id", "source", F.col("k1").alias("cluster"), "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.array(*(F.lit(p) for p in sorted(packs)))).alias("pack_name"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            name, shard = group
            items.sort(key=lambda x: (x[3], x[2], x[0], x[1] or "", x[4:]))
            rows = pack(items, packs[name], max_sources)
            for a in range(0, len(rows), 20_000):
                part = rows[a : a + 20_000]
                columns = [[name] * len(part), [None if r[0] < 0 else (shard << 32) + r[0] for r in part], [items[r[1]][3] for r in part], *([r[i] for r in part] for i in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types)], schema=_OUT)

        for batch in batches:
            docs, sources, texts, sizes_, shard_, names = (batch.column(i).to_pylist() for i in range(6))
            more = zip(*(batch.column(6 + i).to_pylist() for i in range(len(others)))) if others else repeat(())
            for d, so, c, n, sh, name, also in zip(docs, sources, texts, sizes_, shard_, names, more):
                if group != (name, sh):
                    if group is not None:
                        yield from flush()
                    group, items = (name, sh), []
                items.append((n, so, c, d if d is not None else -1, *also))
        if group is not None:
            yield from flush()

    groups = shards * len(packs)
    # each partition packs one group after another, so there needn't be one for each
    tasks = min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 64))
    return rows.repartition(tasks, "pack_name", "shard").sortWithinPartitions("pack_name", "shard").mapInArrow(run, _OUT_SQL)


def fill_report(containers: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, containers, fewest, tokens, fill): containers used, the fewest there could be, and the share of room used."""
    used = containers.filter("container_id is not null").groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    totals = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    both = totals.join(limits, "pack_name")
    return both.select("pack_name", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint").alias("fewest"), "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
