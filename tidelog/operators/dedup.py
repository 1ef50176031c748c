"""Exactly one copy of messages that were delivered at least once.

A structured stream reads the messages in micro-batches, in order of arrival. The
identifiers seen so far live in a keyed state store in the shared folder, as pieces
by event-time slot and batch. The slot is a function of the message's identity (its
log position or first time), so all copies of a message agree on it, however late
they arrive, and a batch looks up its keys only in the slots that its own messages
fall into. It reduces its copies to one candidate a key (map-side combine), joins
those pieces, and writes the surplus copies and the pieces of new identifiers under
its batch number; one atomic swap of a small commit file makes all of it visible. A
batch that is run again after a failure overwrites its own folders, so nothing is
skipped or counted twice.

Slots behind the watermark are expired: they leave the commit file, so that it and
the merging of pieces stay bounded by the live slots however long the stream runs.
A late key still finds its slot: the pieces of an expired one are on record in a
small file of its own (late-arrival lookup). Messages without a slot have no time to
expire by: their identifiers stay live.

The copy kept is the one with the smallest id. If a smaller id arrives in a later
batch, it takes over and the copy kept before becomes surplus, so the result
doesn't depend on how the input was cut into batches.

Defined cases: a null in a key column is a value like any other; rows without an
id can't be told apart and are rejected; an empty stream yields an empty table.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.functions.hashing import hash128

_PIECE = "k1 bigint, k2 bigint, id bigint"
_NO_SLOT = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder Spark gives a null


def _folder(slot: int | None) -> str:
    return f"slot={_NO_SLOT if slot is None else slot}"


class SeenStore:
    """Identifiers seen so far; see the module's text.

    A live slot of more than ``max_pieces`` pieces is merged into one; other slots aren't touched by that.
    """

    def __init__(self, spark: SparkSession, path: str, max_pieces: int = 6):
        self.spark, self.path, self.max_pieces = spark, path.rstrip("/"), max_pieces

    def log(self) -> dict:
        """The last commit: batch, watermark, pieces of each live slot by folder name, and counts over all batches."""
        text = storage.read_text(self.spark, f"{self.path}/COMMITTED")
        return json.loads(text) if text else {"batch": -1, "watermark": None, "live": {}, "counts": {"batches": 0, "pieces_read": 0, "late_lookups": 0, "merged": 0, "expired": 0}}

    def _expired(self, log: dict, folder: str) -> list[str]:
        """Pieces of a slot that is no longer live; those of a batch that never committed don't count."""
        text = storage.read_text(self.spark, f"{self.path}/expired/{folder}")
        return [p for p in json.loads(text) if int(p.split("/")[0].split("=")[1]) <= log["batch"]] if text else []

    def _read(self, pieces: list[str]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], _PIECE)
        return self.spark.read.schema(_PIECE).parquet(*(f"{self.path}/seen/{p}" for p in pieces))

    def _merge(self, live: dict, number: int) -> list[str]:
        """Puts one piece in the place of many, in ``live``; returns what may be deleted after the commit."""
        many = {f: pieces for f, pieces in live.items() if len(pieces) > self.max_pieces}
        if not many:
            return []
        slot = lambda f: F.lit(None if f.endswith(_NO_SLOT) else f.split("=")[1]).cast("bigint")
        rows = reduce(DataFrame.unionByName, (self._read(p).withColumn("slot", slot(f)) for f, p in sorted(many.items())))
        rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("slot").alias("slot")).write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/seen/merged={number}")
        live.update({f: [f"merged={number}/{f}"] for f in many})
        return [p for pieces in many.values() for p in pieces]

    def surplus(self) -> DataFrame:
        """(id) of every surplus copy of the committed batches."""
        done = self.log()["batch"]
        if done < 0:
            return self.spark.createDataFrame([], "id bigint")
        # folders of batches that never committed are pruned
        return self.spark.read.schema("id bigint, batch bigint").parquet(f"{self.path}/surplus").filter(F.col("batch") <= done).select("id")

    def process(self, batch: DataFrame, number: int, horizon: int) -> None:
        """One micro-batch of (k1, k2, id, slot); ``horizon`` slots behind the greatest slot, state expires."""
        log = self.log()
        if number <= log["batch"]:
            return
        mark, live, counts = log["watermark"], log["live"], log["counts"]
        slots = [r[0] for r in batch.select("slot").distinct().collect()]  # as many as there are slots of time, not messages
        late = {s: self._expired(log, _folder(s)) for s in slots if s is not None and mark is not None and s < mark}
        pieces = [p for s in slots for p in (late[s] if s in late else live.get(_folder(s), []))]
        own = batch.groupBy("k1", "k2").agg(F.min("id").alias("own"), F.min("slot").alias("slot"), F.count(F.lit(1)).alias("n"))
        was = self._read(pieces).groupBy("k1", "k2").agg(F.min("id").alias("was"))
        kept = own.join(was, ["k1", "k2"], "left").persist()
        try:
            new = kept.filter(F.col("was").isNull() | (F.col("own") < F.col("was")))
            new.select("k1", "k2", F.col("own").alias("id"), "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/seen/batch={number}")
            # only keys that were there before or came more than once have anything surplus
            doubled = kept.filter("n > 1 or was is not null").select("k1", "k2", F.least("own", "was").alias("kept"), "was")
            surplus = batch.select("k1", "k2", "id").join(doubled.drop("was"), ["k1", "k2"]).filter(F.col("id") != F.col("kept")).select("id")
            surplus = surplus.unionByName(doubled.filter(F.col("was") > F.col("kept")).select(F.col("was").alias("id")))
            surplus.write.mode("overwrite").parquet(f"{self.path}/surplus/batch={number}")
        finally:
            kept.unpersist()
        for folder in (f for f in storage.children(self.spark, f"{self.path}/seen/batch={number}") if f.startswith("slot=")):
            piece = f"batch={number}/{folder}"
            at = next((s for s in late if _folder(s) == folder), None)
            if at is None:
                live.setdefault(folder, []).append(piece)
            else:
                storage.swap_text(self.spark, f"{self.path}/expired/{folder}", json.dumps([*late[at], piece]))
        mark = max((x for x in (mark, *(s - horizon for s in slots if s is not None)) if x is not None), default=None)
        over = [f for f in live if not f.endswith(_NO_SLOT) and mark is not None and int(f.split("=")[1]) < mark]
        for folder in over:
            storage.swap_text(self.spark, f"{self.path}/expired/{folder}", json.dumps(live.pop(folder)))
        unused = self._merge(live, number)
        counts = {"batches": counts["batches"] + 1, "pieces_read": counts["pieces_read"] + len(pieces), "late_lookups": counts["late_lookups"] + len(late), "merged": counts["merged"] + len(unused), "expired": counts["expired"] + len(over)}
        storage.swap_text(self.spark, f"{self.path}/COMMITTED", json.dumps({"batch": number, "watermark": mark, "live": live, "counts": counts}))
        for piece in unused:  # nobody but the one writer reads them
            storage.delete(self.spark, f"{self.path}/seen/{piece}")


def identified(rows: DataFrame, keys: list[str], id_column: str, slot: Column) -> DataFrame:
    """(k1, k2, id, slot) of messages: all that a batch needs to know of them."""
    return rows.filter(F.col(f"`{id_column}`").isNotNull()).select(*hash128(rows, keys), F.col(f"`{id_column}`").cast("bigint").alias("id"), slot.cast("bigint").alias("slot"))


def surplus_copies(stream: DataFrame, keys: list[str], id_column: str, slot: Column, *, horizon: int, store: SeenStore | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of messages through the store until its input is used up; the ids of all surplus copies.

    ``slot`` is a whole number made from the message's identity that rises with
    event time. With the same ``store`` and ``checkpoint`` a later call goes on
    where the last one ended.
    """
    return _through(identified(stream, keys, id_column, slot), horizon, store, checkpoint).surplus()


def _through(narrow: DataFrame, horizon: int, store: SeenStore | None, checkpoint: str | None) -> SeenStore:
    spark = narrow.sparkSession
    store = store or SeenStore(spark, storage.fresh_dir(spark, "seen"))
    query = narrow.writeStream.foreachBatch(lambda df, n: store.process(df, n, horizon)).trigger(availableNow=True).option("checkpointLocation", checkpoint or storage.fresh_dir(spark, "stream")).start()
    query.awaitTermination()
    return store


def surplus_in_backlog(rows: DataFrame, keys: list[str], id_column: str, slot: Column, *, horizon: int, batches: int = 12, file_rows: int = 1 << 20, store: SeenStore | None = None) -> DataFrame:
    """The same for a table of messages delivered earlier: they are streamed again in order of arrival, in about ``batches`` micro-batches.

    Only (k1, k2, id, slot) is laid out by arrival (ranges of the id, which rises with it), in files of at most
    about ``file_rows`` messages, and read as a stream of files, so any size of table goes the way of a live stream.
    """
    spark = rows.sparkSession
    narrow = identified(rows, keys, id_column, slot)
    per_batch = max(1, -(-narrow.count() // (batches * file_rows)))
    folder = storage.fresh_dir(spark, "arrivals")
    narrow.repartitionByRange(batches * per_batch, "id").write.parquet(folder)
    stream = spark.readStream.schema(narrow.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    surplus = _through(stream, horizon, store, None).surplus()
    storage.delete(spark, folder)
    return surplus


def read_as_stream(spark: SparkSession, path: str, batch_bytes: int = 256 << 20) -> DataFrame:
    """A parquet table, a file or a folder of files, as a stream in micro-batches of about ``batch_bytes``."""
    schema = spark.read.parquet(path).schema
    if storage.is_file(spark, path):  # the file source takes folders and patterns only
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
