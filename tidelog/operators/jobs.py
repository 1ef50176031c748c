"""Snapshot jobs on record: which chunks there are, who works on them, and whether all are done.

A job is a folder: a table of its chunks, and small version files, each of which can
be made once only. Workers therefore never lose each other's steps: of two that took
the same version one repeats its step on the next. What a step changes stands in the
version file, until it is so much (``SMALL``) that the table is written anew. Steps
should concern many chunks at a time (a wave), not one: 10^8 chunks of 100 TB are a
table of some GB. The rows that chunks are read from lie in the folder too, until
the job is completed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog import storage
from tidelog.operators import scan
from tidelog.operators.snapshot import CHUNK_COLUMNS, _stretches, claimable, migrate_chunks

_CHUNKS = ", ".join(f"{n} {t}" for n, t in CHUNK_COLUMNS.items())
#: What changes in the life of a chunk.
_STATE = ("status", "claimed_by", "claimed_at", "heartbeat_at", "completed_at", "rows_processed")
#: So many changed chunks stand in a version file at most.
SMALL = 1000


def _state(chunk: dict, read: bool = False) -> dict:
    """The changing part of a chunk, with times as text, or ``read`` from it."""
    turned = lambda v: datetime.fromisoformat(v) if read and isinstance(v, str) else v.isoformat() if not read and isinstance(v, datetime) else v
    return {c: turned(chunk[c]) if c.endswith("_at") else chunk[c] for c in _STATE}


def _among(ids) -> str:
    """A condition for these chunks; mostly they follow each other."""
    return "(" + (" OR ".join(f"id BETWEEN {a} AND {b}" for a, b in _stretches([*ids])) or "false") + ")"


class SnapshotJob:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---

    def _version(self) -> int:
        return max((int(n[1:]) for n in storage.children(self.spark, self.path) if n[0] == "V" and n[1:].isdigit()), default=0)

    def header(self) -> dict | None:
        """slot_name, snapshot_lsn, started_at, completed; None where there is no job."""
        v = self._version()
        return json.loads(storage.read_text(self.spark, f"{self.path}/V{v}")) if v else None

    def chunks(self) -> DataFrame:
        h = self.header()
        return self._chunks(h) if h else self.spark.createDataFrame([], _CHUNKS)

    def _table(self, h: dict) -> DataFrame:
        return self.spark.read.schema(_CHUNKS).parquet(f"{self.path}/{h['chunks']}")

    def _chunks(self, h: dict) -> DataFrame:
        """The table with the changes since it was written."""
        changed = h.get("changed") or {}
        if not changed:
            return self._table(h)
        kinds = {"string": pa.string(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us")}
        parsed = lambda c, v: datetime.fromisoformat(v) if v is not None and c.endswith("_at") else v
        columns = {f"__{c}": pa.array([parsed(c, state[c]) for state in changed.values()], kinds[CHUNK_COLUMNS[c]]) for c in _STATE}
        newer = self.spark.createDataFrame(pa.table({"id": pa.array([int(i) for i in changed], pa.int32()), "__newer": pa.array([True] * len(changed)), **columns}))
        rows = self._table(h).join(newer, "id", "left")
        return rows.withColumns({c: F.when(F.col("__newer"), F.col(f"__{c}")).otherwise(F.col(c)) for c in _STATE}).select(*CHUNK_COLUMNS)

    def _put(self, v: int, h: dict, new: dict) -> bool:
        """Make the next version, unless another worker was faster: False."""
        if not storage.put_text(self.spark, f"{self.path}/V{v + 1}", json.dumps(new)):
            return False
        for name in storage.children(self.spark, self.path):  # what no worker can still be at
            if (name[0] == "V" and name[1:].isdigit() and int(name[1:]) < v) or (name.startswith("chunks-") and int(name.split("-")[1]) <= v and name not in (h["chunks"], new["chunks"])):
                storage.delete(self.spark, f"{self.path}/{name}")
        return True

    def _write(self, v: int, rows: DataFrame) -> str:
        name = f"chunks-{v + 1}-{uuid.uuid4().hex}"
        rows.select(*CHUNK_COLUMNS).write.parquet(f"{self.path}/{name}")
        return name

    def _step(self, change: Callable[[DataFrame], DataFrame] | None, **header) -> dict:
        """Write the next version; if another worker was faster, do it again on its version."""
        while True:
            v, h = self._version(), self.header()
            new = {**h, **header}
            if change:
                new |= {"chunks": self._write(v, change(self._chunks(h))), "changed": {}}
            if self._put(v, h, new):
                return new
            if change:
                storage.delete(self.spark, f"{self.path}/{new['chunks']}")

    def _change(self, v: int, h: dict, states: dict[int, dict]) -> bool:
        """Write the next version with the new states of some chunks (a wave at most), unless another worker was faster: False."""
        new = {**h, "changed": {**(h.get("changed") or {}), **{str(i): state for i, state in states.items()}}}
        folded = len(new["changed"]) > SMALL
        if folded:
            new |= {"chunks": self._write(v, self._chunks(new)), "changed": {}}
        if self._put(v, h, new):
            return True
        if folded:
            storage.delete(self.spark, f"{self.path}/{new['chunks']}")
        return False

    # --- the life of a job ---

    def create(self, chunks: DataFrame, slot: str, lsn: int, now: datetime) -> bool:
        """Record a job with its chunks (numbered in order of table and index), unless there is one already: False."""
        if self._version():
            return False
        order = [F.col(c) for c in ("table_schema", "table_name", "chunk_index")]
        name = f"chunks-1-{uuid.uuid4().hex}"
        numbered = scan.numbered(chunks.drop("id"), order, "__n").withColumn("id", (F.col("__n") + 1).cast("int"))
        numbered.select(*CHUNK_COLUMNS).write.parquet(f"{self.path}/{name}")
        if storage.put_text(self.spark, f"{self.path}/V1", json.dumps({"slot_name": slot, "snapshot_lsn": lsn, "started_at": now.isoformat(), "completed": False, "chunks": name})):
            return True
        storage.delete(self.spark, f"{self.path}/{name}")
        return False

    def claim(self, worker: str, wave: int, now: datetime, timeout_seconds: float) -> list[dict]:
        """At most ``wave`` chunks for the worker, in order: pending ones, and those whose worker wasn't heard of for too long."""
        token = f"{worker}/{uuid.uuid4().hex}"
        at, since = F.lit(now).cast("timestamp_ntz"), now - timedelta(seconds=timeout_seconds)
        while True:
            v, h = self._version(), self.header()
            changed = h.get("changed") or {}
            free = claimable(F.col("status"), F.col("heartbeat_at"), at, timeout_seconds)
            if changed:  # of these the table doesn't know
                again = [int(i) for i, x in changed.items() if x["status"] == "pending" or (x["status"] == "in_progress" and (x["heartbeat_at"] is None or datetime.fromisoformat(x["heartbeat_at"]) < since))]
                free = (free & ~F.expr(_among(map(int, changed)))) | F.expr(_among(again))
            got = [r.asDict() for r in self._table(h).filter(free).orderBy("id").limit(wave).collect()]  # a wave at most
            mine = {"status": "in_progress", "claimed_by": token, "claimed_at": now.isoformat(), "heartbeat_at": now.isoformat()}
            states = {c["id"]: {**_state(changed.get(str(c["id"])) or c), **mine} for c in got}
            if not got or self._change(v, h, states):
                stamps = {"claimed_at": now, "heartbeat_at": now}
                return [{**c, **_state(changed.get(str(c["id"])) or c, read=True), **mine, **stamps} for c in got]

    def _of(self, worker: str) -> Column:
        return (F.col("status") == "in_progress") & F.col("claimed_by").startswith(f"{worker}/")

    def heartbeat(self, worker: str, now: datetime) -> None:
        self._step(lambda c: c.withColumn("heartbeat_at", F.when(self._of(worker), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("heartbeat_at"))))

    def complete(self, worker: str, rows: DataFrame | dict[int, int], now: datetime) -> None:
        """Chunks (id, rows) of the worker are done, a wave at most. What another worker took over in the meantime stays with that one."""
        done = rows if isinstance(rows, dict) else {r["id"]: r["rows"] for r in rows.select("id", "rows").collect()}
        while done:
            v, h = self._version(), self.header()
            changed = h.get("changed") or {}
            known = {i: changed[str(i)] for i in done if str(i) in changed}
            if len(known) < len(done):
                known |= {r["id"]: _state(r.asDict()) for r in self._table(h).filter(_among(i for i in done if i not in known)).collect()}
            mine = {i: x for i, x in known.items() if x["status"] == "in_progress" and (x["claimed_by"] or "").startswith(f"{worker}/")}
            if not mine or self._change(v, h, {i: {**x, "rows_processed": int(done[i]), "completed_at": now.isoformat(), "status": "completed"} for i, x in mine.items()}):
                return

    def release(self, worker: str) -> None:
        """Give back what the worker holds: after a failure others may take it at once."""
        none = lambda c, t: F.when(self._of(worker), F.lit(None).cast(t)).otherwise(F.col(c))
        self._step(lambda c: c.withColumns({"claimed_at": none("claimed_at", "timestamp_ntz"), "heartbeat_at": none("heartbeat_at", "timestamp_ntz"), "status": F.when(self._of(worker), "pending").otherwise(F.col("status")), "claimed_by": none("claimed_by", "string")}))

    def finish(self) -> bool:
        """Mark the job completed if it has chunks and all are; says whether it is."""
        total, done = self.chunks().agg(F.count(F.lit(1)), F.count_if(F.col("status") == "completed")).first()
        if total and total == done and not self.header()["completed"]:
            self._step(None, completed=True)
        if total and total == done:  # whoever still reads its rows was given up
            for name in storage.children(self.spark, self.path):
                if name.startswith(("rows-", "R-")):
                    storage.delete(self.spark, f"{self.path}/{name}")
        return bool(total) and total == done

    def laid(self, name: str, make: Callable[[str], dict]) -> dict:
        """What ``make`` says of the rows that it wrote into a folder: one worker's, for all workers and after a restart."""
        known = storage.read_text(self.spark, f"{self.path}/R-{name}")
        if known is None:
            folder = f"{self.path}/rows-{name}-{uuid.uuid4().hex}"
            made = json.dumps({"folder": folder, **make(folder)})
            if storage.put_text(self.spark, f"{self.path}/R-{name}", made):
                return json.loads(made)
            storage.delete(self.spark, folder)
            known = storage.read_text(self.spark, f"{self.path}/R-{name}")
        return json.loads(known)

    def drop(self) -> None:
        """Forget the job, for a new snapshot."""
        storage.delete(self.spark, self.path)

    def adopt(self, old: DataFrame, slot: str, lsn: int, now: datetime) -> bool:
        """Record a job from chunk rows of an older layout."""
        return self.create(migrate_chunks(old), slot, lsn, now)
