"""Process only records that are new or changed since the last successful run.

State is one (key hash, content hash) pair per record, kept as a versioned table
under a path of its own. A run hashes the current rows, joins them with the state,
hands on the rows whose key is unknown or whose content differs, and at the end
moves the state to its next version in one atomic step. A run that dies anywhere
before that leaves the old version in force, so the next run selects the same
records again; output is written under the number of the coming version, so a
repeated run overwrites the half-written output of the failed one.

A version is a small file that lists deltas: a run adds one with only its new and
changed keys, and merges them when there are many. The file of a version can be made
once only, so of two runs that began from one version one commits and the other fails.

Defined cases: null keys and null contents are values like any other; repeated
rows of a key count once (the row that sorts first by ``prefer``, then by content
hash); an empty table selects nothing; extra columns pass through, whatever
their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.functions.hashing import hash64, hash128

K1, K2, CONTENT, STATUS = "__k1", "__k2", "__content", "record_status"
_STATE = f"{K1} bigint, {K2} bigint, {CONTENT} bigint"


class ConcurrentRun(RuntimeError):
    """Another run swapped the state since this one read it."""


def hashed(rows: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """The rows with their key and content hashes."""
    k1, k2 = hash128(rows, keys)
    return rows.withColumns({K1: k1, K2: k2, CONTENT: hash64(rows, content, 3)})


class IncrementalState:
    """Versions ``V<n>`` under ``path``, each listing its deltas from old to new; the greatest number is in force."""

    def __init__(self, spark: SparkSession, path: str, max_deltas: int = 8):
        self.spark, self.path, self.max_deltas = spark, path.rstrip("/"), max_deltas

    @property
    def version(self) -> int:
        """0 before the first successful run."""
        return max((int(n[1:]) for n in storage.children(self.spark, self.path) if n[0] == "V" and n[1:].isdigit()), default=0)

    def _deltas(self, version: int) -> list[str]:
        return json.loads(storage.read_text(self.spark, f"{self.path}/V{version}") or "[]") if version else []

    def table(self, version: int | None = None) -> DataFrame:
        """(key hashes, content hash) of every known record: of each key, what the newest delta says."""
        deltas = self._deltas(self.version if version is None else version)
        parts = [self.spark.read.schema(_STATE).parquet(f"{self.path}/{d}") for d in deltas]
        if len(parts) < 2:
            return parts[0] if parts else self.spark.createDataFrame([], _STATE)
        rows = reduce(DataFrame.unionByName, (x.withColumn("__at", F.lit(i)) for i, x in enumerate(parts)))
        return rows.groupBy(K1, K2).agg(F.max_by(CONTENT, "__at").alias(CONTENT))

    def select(self, rows: DataFrame) -> DataFrame:
        """Of hashed rows, one per key, those that are new or changed, with ``record_status``."""
        seen = self.table().select(K1, K2, F.col(CONTENT).alias("__seen"))
        joined = rows.join(seen, [K1, K2], "left")
        return joined.filter(F.col("__seen").isNull() | (F.col("__seen") != F.col(CONTENT))).withColumn(STATUS, F.when(F.col("__seen").isNull(), "new").otherwise("changed")).drop("__seen")

    def commit(self, rows: DataFrame, based_on: int) -> int:
        """Make hashed rows, one per key, part of the state. Rows that ``select`` left out may be among them, but needn't be."""
        deltas = self._deltas(based_on)
        own = f"delta-{based_on + 1}-{uuid.uuid4().hex}"
        rows.select(K1, K2, CONTENT).write.parquet(f"{self.path}/{own}")
        listed = [*deltas, own]
        if len(listed) > self.max_deltas:
            merged = f"delta-{based_on + 1}-{uuid.uuid4().hex}"
            at = [self.spark.read.schema(_STATE).parquet(f"{self.path}/{d}").withColumn("__at", F.lit(i)) for i, d in enumerate(listed)]
            reduce(DataFrame.unionByName, at).groupBy(K1, K2).agg(F.max_by(CONTENT, "__at").alias(CONTENT)).write.parquet(f"{self.path}/{merged}")
            listed = [merged]
        if self.version != based_on or not storage.put_text(self.spark, f"{self.path}/V{based_on + 1}", json.dumps(listed)):
            for d in {own, *listed} - {*deltas}:
                storage.delete(self.spark, f"{self.path}/{d}")
            raise ConcurrentRun(f"{self.path}: version {self.version}, this run began from {based_on}")
        # what neither this version nor the one before lists is of no use to any run that can still commit
        for name in storage.children(self.spark, self.path):
            old = name.startswith("delta-") and int(name.split("-")[1]) <= based_on + 1 and name not in {*listed, *deltas}
            if old or (name[0] == "V" and name[1:].isdigit() and int(name[1:]) < based_on):
                storage.delete(self.spark, f"{self.path}/{name}")
        return based_on + 1


def one_per_key(rows: DataFrame, prefer: list[Column] | None = None) -> DataFrame:
    """One hashed row per key, chosen the same way in every run. Partial aggregation keeps hot keys out of one task."""
    rest = [c for c in rows.columns if c not in (K1, K2)]
    rank = F.struct(*(prefer or []), F.col(CONTENT))
    picked = rows.groupBy(K1, K2).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), rank).alias("__row"))
    return picked.select(K1, K2, *(F.col("__row")[c].alias(c) for c in rest))


def run(state: IncrementalState, rows: DataFrame, keys: list[str], content: list[str], sink: Callable[[DataFrame, int], None], prefer: list[Column] | None = None) -> int:
    """One whole run: select, hand to ``sink(rows, version)``, then swap. The sink must overwrite by version.

    Returns the version in force afterwards.
    """
    began = state.version
    current = storage.materialize(one_per_key(hashed(rows, keys, content), prefer), "current")
    fresh = storage.materialize(state.select(current), "fresh")  # for the sink and for the state
    try:
        sink(fresh.drop(K1, K2, CONTENT), began + 1)
        return state.commit(fresh, began)
    finally:
        storage.discard(current, fresh)


# --- replication slots -------------------------------------------------------

MESSAGE = ["slot_name", "lsn", "xid", "table_name", "row_key"]
MESSAGE_CONTENT = ["op", "new_decoded", "old_decoded"]


def run_positions(slot_info: DataFrame, last: int) -> DataFrame:
    """(slot_name, positions): what the ``last`` newest successful runs of each slot confirmed, from new to old.

    Those are the done runs with a readable position; unreadable ones count as not
    there. Of several rows of one run the greatest position counts. An older run
    can't have confirmed more than the newest (positions never move back).
    """
    from tidelog.functions.lsn import lsn_parse

    done = slot_info.filter((F.col("run_status") == "done") & F.col("run_no").isNotNull() & F.col("slot_name").isNotNull()).select("slot_name", "run_no", lsn_parse("confirmed_flush_lsn").alias("position")).filter(F.col("position").isNotNull())
    runs = done.groupBy("slot_name", "run_no").agg(F.max("position").alias("position"))  # one row a run
    newest = runs.groupBy("slot_name").agg(F.slice(F.sort_array(F.collect_list(F.struct("run_no", "position")), asc=False), 1, last).alias("runs"))
    return newest.select("slot_name", F.transform("runs", lambda r: F.least(r["position"], F.col("runs")[0]["position"])).alias("positions"))


def confirmed_positions(slot_info: DataFrame) -> DataFrame:
    """(slot_name, position): what the last successful run of each slot confirmed."""
    return run_positions(slot_info, 1).select("slot_name", F.col("positions")[0].alias("position"))


def committed_messages(change_log: DataFrame, commits: DataFrame, positions: DataFrame) -> DataFrame:
    """Messages of committed transactions, one per message, with content hash and ``runs``: by how many of the slot's newest runs they were confirmed.

    The maps are hashed in the scan's stage, so they don't travel; key hashes are
    cheap to make from the key and only made where they are needed. The positions
    (one row a slot) join last, when Spark knows how small they are.
    """
    narrow = change_log.select("slot_name", F.col("lsn").cast("bigint").alias("lsn"), "xid", "table_name", "row_key", "delivery_id", hash64(change_log, MESSAGE_CONTENT, 3).alias(CONTENT))
    number = "decimal(20,0)"  # positions fill 64 bits
    ends = commits.filter(F.col("commit_lsn").isNotNull()).groupBy("slot_name", "xid").agg(F.max(F.col("commit_lsn").cast(number)).alias("commit_lsn"))
    covered = F.size(F.filter(F.coalesce("positions", F.array().cast(f"array<{number}>")), lambda p: p.cast(number) >= F.col("commit_lsn")))
    none = F.col("commit_lsn") <= F.lit(0).cast(number)  # a slot without a position begins at 0
    ends = ends.join(positions, "slot_name", "left").select("slot_name", "xid", F.when(F.col("positions").isNull() & none, 1).otherwise(covered).alias("runs"))
    # of repeated deliveries the first one's content counts
    return narrow.join(ends, ["slot_name", "xid"]).groupBy(*MESSAGE).agg(F.min_by(CONTENT, F.coalesce("delivery_id", F.lit(0))).alias(CONTENT), F.max("runs").alias("runs"))


def unconfirmed_messages(change_log: DataFrame, wal_commits: DataFrame, slot_info: DataFrame, *, history: int = 2, state: IncrementalState | None = None) -> DataFrame:
    """The messages each slot has to process next, once each: (slot_name, lsn, table_name, row_key, record_status).

    The slots' newest ``history`` successful runs are gone through in order (the
    oldest of them stands for all before it): each compares what lay before it with
    the state its predecessors left and commits what was new or changed. Failed runs
    commit nothing, so they leave no trace. At the end the whole log is compared with the state.
    """
    spark = change_log.sparkSession
    messages = storage.materialize(committed_messages(change_log, wal_commits, run_positions(slot_info, history)), "messages")
    k1, k2 = hash128(messages, MESSAGE)
    current = messages.withColumns({K1: k1, K2: k2})
    state = state or IncrementalState(spark, storage.fresh_dir(spark, "slots"))
    for k in range(history, 0, -1):
        state.commit(state.select(current.filter(F.col("runs") >= k).select(K1, K2, CONTENT)), state.version)
    return state.select(current).select("slot_name", "lsn", "table_name", "row_key", STATUS)
