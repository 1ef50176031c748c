"""Apply changes to a keyed table: last writer wins, safe to repeat."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidelog import storage


def latest(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest change of each key. An aggregate that combines map-side, so a hot key is no hot task."""
    rest = [c for c in changes.columns if c not in (*keys, seq)]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), seq).alias("__row"), F.max(seq).alias(seq))
    return newest.select(*keys, seq, *(F.col("__row")[c].alias(c) for c in rest))


def upsert(changes: DataFrame, keys: list[str], seq: str, op: str = "op") -> DataFrame:
    """The table after all changes: inserts and updates put a row, deletes remove it."""
    return latest(changes, keys, seq).filter(F.col(op) != "D")


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame, keys: list[str], seq: str, since=None) -> DataFrame:
    """Snapshot rows (before every change, kind ``r``) merged with the changes after ``since`` (a predicate)."""
    base = snapshot.withColumns({seq: F.lit(-1).cast("bigint"), "op": F.lit("r")})
    later = changes if since is None else changes.filter(since)
    return upsert(base.unionByName(later.select(*base.columns)), keys, seq)


class CurrentTable:
    """A keyed table in the shared folder, in ``buckets`` of keys; a batch only rewrites those it touches.

    A batch that touches more than a quarter of the buckets would rewrite most of
    the table, so its rows are laid beside it, and merged with those of the next
    such batches, at most ``LAID`` together; readers see them merged.

    Batches may come twice: a row only changes if the change's sequence is greater.
    Deleted keys stay as tombstones for that reason, and don't show. One atomic swap
    of a small file, which names the folder of each bucket, makes a batch visible.
    """

    LAID = 12

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.seq, self.buckets = spark, path.rstrip("/"), keys, seq, buckets

    def _current(self) -> dict:
        text = storage.read_text(self.spark, f"{self.path}/CURRENT")
        return {"laid": [], **json.loads(text)} if text else {"version": 0, "batch": None, "folders": {}, "laid": [], "unused": []}

    def _read(self, folders: list[str], schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], kind)

    def _with_laid(self, known: DataFrame | None, laid: list[dict]) -> DataFrame | None:
        for part in laid:
            rows = self._read([part["folder"]], part["schema"])
            known = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
        return latest(known, self.keys, self.seq) if laid else known

    def rows(self) -> DataFrame | None:
        now = self._current()
        if not now["folders"]:
            return None
        return self._with_laid(self._read(list(now["folders"].values()), now["schema"]), now["laid"]).filter("op <> 'D'").drop("op")

    def apply(self, changes: DataFrame, batch_id: int | None = None) -> None:
        """Merge a batch. With a batch id that was applied before, nothing happens."""
        now = self._current()
        if batch_id is not None and now["batch"] is not None and batch_id <= now["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")
        data = f"v-{now['version'] + 1}-{batch_id if batch_id is not None else 'x'}"
        new = latest(changes, self.keys, self.seq)
        new.write.mode("overwrite").parquet(f"{self.path}/{data}")
        part = {"folder": data, "schema": new.schema.jsonValue()}
        part["touched"] = [str(r[0]) for r in self._read([data], part["schema"]).select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets
        laid = [*now["laid"], part]
        after = {**now, "version": now["version"] + 1, "batch": batch_id if batch_id is not None else now["batch"], "laid": laid, "unused": []}
        if not now["folders"] or len(part["touched"]) <= self.buckets // 4 or len(laid) > self.LAID:
            touched = sorted({b for p in laid for b in p["touched"]})
            merged = self._with_laid(self._read([now["folders"][b] for b in touched if b in now["folders"]], now["schema"]) if now["folders"] else None, laid)
            merged.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{data}-merged")
            after["folders"] = {**now["folders"], **{b: f"{data}-merged/__bucket={b}" for b in touched}}
            after |= {"laid": [], "schema": merged.schema.jsonValue(), "unused": [*(now["folders"][b] for b in touched if b in now["folders"]), *(p["folder"] for p in laid)]}
        storage.swap_text(self.spark, f"{self.path}/CURRENT", json.dumps(after))
        for folder in now["unused"]:  # readers of the last version may still be at work, those of the one before aren't
            storage.delete(self.spark, f"{self.path}/{folder}")


def keyed_messages(changes: DataFrame, keys: list[str], operation: str = "op") -> DataFrame:
    """(key, value) for a topic: the value is the row as JSON with its operation."""
    rest = [c for c in changes.columns if c != operation]
    return changes.select(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), F.to_json(F.struct(*rest, F.col(operation).alias("operation"))).alias("value"))
