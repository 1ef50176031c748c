"""Entry points: follow a slot, take a snapshot and then follow, or only take a snapshot."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.naming import instance_id, next_delay, snapshot_slot_name
from tidelog.operators import publication as pub, snapshot as snap
from tidelog.operators.jobs import SnapshotJob
from tidelog.session import ship
from tidelog.sources.config import Config, read_config
from tidelog.sources.replication import ReplicationSource
from tidelog.streaming.assembly import ROCKSDB, assemble_stream
from tidelog.streaming.sinks import listen


class Connector:
    """Follows captured frames of one slot and hands delivered changes to a handler, batch by batch."""

    def __init__(self, spark: SparkSession, config: Config | str, frames_path: str | None = None, tables: dict[str, DataFrame] | None = None, checkpoint: str | None = None, keys: dict[str, list[str]] | None = None):
        self.spark = spark
        ship(spark)
        self.config = (read_config(config) if isinstance(config, str) else config).validate()
        self.frames_path, self.tables, self.checkpoint = frames_path, tables or {}, checkpoint
        #: Key columns by table, as ``snapshot.primary_keys`` reads them from Relation messages.
        self.keys = keys or {}
        self._query: StreamingQuery | None = None

    def changes(self, starting_lsn: int = 0, ack_file: str | None = None, max_files: int = 64) -> DataFrame:
        """Delivered changes as a stream, filtered by the publication and without heartbeat rows."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        self.spark.dataSource.register(ReplicationSource)
        reader = self.spark.readStream.format(ReplicationSource.name()).option("path", self.frames_path).option("startingLsn", str(starting_lsn)).option("maxFiles", str(max_files))
        stream = assemble_stream((reader.option("ackFile", ack_file) if ack_file else reader).load())
        p = self.config.publication
        if p.operations:
            stream = stream.filter(F.col("op").isin([pub.OPERATIONS[o.upper()] for o in p.operations]))
        if p.tables and not p.allTables:
            names = [t.full_name for t in p.tables]
            cut = F.arrays_overlap(F.from_json("truncated", "array<string>"), F.array(*map(F.lit, names)))  # a truncate names several tables
            stream = stream.filter(F.coalesce(F.concat_ws(".", "table_schema", "table_name").isin(names) | cut, F.lit(False)))
            listed = {t.full_name: list(t.columns) for t in p.tables if t.columns}
            stream = stream.withColumns({image: pub.keep_columns_of(F.col(image), F.concat_ws(".", "table_schema", "table_name"), listed) for image in ("before", "after")})
        if beat := self.config.heartbeat.table:
            stream = pub.without_heartbeats(stream, (F.col("table_schema") == beat.schema) & (F.col("table_name") == beat.name))
        return stream

    def _specs(self) -> tuple[str, list[snap.TableSpec]]:
        wanted = self.config.snapshot_tables(self.config.publication)
        general = self.config.snapshot.queryCondition or None
        key = lambda t: tuple(self.keys.get(t.full_name) or self.keys.get(t.name) or ())
        specs = [snap.TableSpec(t.name, t.schema, key(t), columns=t.columns, condition=t.queryCondition or general, strategy=t.snapshotPartitionStrategy or None) for t in wanted]
        slot = snapshot_slot_name(self.config.database, self.config.snapshot.id or None) if self.config.snapshot_only else self.config.slot.name
        return slot, specs

    def snapshot(self, lsn: int) -> DataFrame:
        """Snapshot events of the configured tables, in one go."""
        slot, specs = self._specs()
        return snap.take_snapshot(self.tables, specs, slot, lsn, size=self.config.snapshot.chunkSize)

    def run_snapshot(self, lsn: int, handler: Callable[[DataFrame, int], None], job: SnapshotJob, *, wave: int = 10_000) -> None:
        """The same chunk by chunk, on record: what was done before a failure or restart isn't done again.

        The markers come once each: BEGIN with a job's first wave, END when all its chunks are completed.
        """
        s = self.config.snapshot
        slot, specs = self._specs()
        worker = s.instanceId or instance_id()
        now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
        head = job.header()
        if head and s.resnapshot and head["snapshot_lsn"] != lsn:
            job.drop()
            head = None
        begin, end = snap.markers(self.spark, slot, head["snapshot_lsn"] if head else lsn)
        if not head:
            planned = None
            for spec in specs:
                chunks = snap.plan_chunks(snap.table_of(self.tables, spec), spec, s.chunkSize, slot, lsn)
                planned = chunks if planned is None else planned.unionByName(chunks)
            if job.create(planned, slot, lsn, now()):
                handler(begin, -1)
        at = {(x.schema, x.name): x for x in specs}
        lsn = job.header()["snapshot_lsn"]
        laid: dict[str, dict] = {}
        while claimed := job.claim(worker, wave, now(), s.claimTimeout):
            try:
                for (schema, name), spec in at.items():
                    mine = {c["chunk_index"]: c["id"] for c in claimed if (c["table_schema"], c["table_name"]) == (schema, name)}
                    if not mine:
                        continue
                    parts, counts = [], {}
                    for stretch in sorted({n // snap.STRETCH for n in mine}):
                        known = self._laid(laid, job, spec, stretch)
                        own = [n for n in mine if n // snap.STRETCH == stretch]
                        parts.append(snap.laid_rows(self.spark, known, own))
                        counts |= {mine[n]: known["rows"].get(str(n), 0) for n in own}
                    handler(snap.data_events(reduce(DataFrame.unionByName, parts), spec, slot, lsn), -1)
                    job.complete(worker, counts, now())
            except BaseException:
                job.release(worker)
                raise
        if not job.header()["completed"] and job.finish():
            handler(end, -1)

    def _laid(self, laid: dict[str, dict], job: SnapshotJob, spec: snap.TableSpec, stretch: int) -> dict:
        """Where the rows of a stretch of a table's chunks lie; made when its first chunk is claimed."""
        size = self.config.snapshot.chunkSize
        name = f"{hashlib.sha256(repr((spec, size)).encode()).hexdigest()[:16]}-{stretch}"
        if name not in laid:
            numbers = [*range(stretch * snap.STRETCH, (stretch + 1) * snap.STRETCH)]
            laid[name] = job.laid(name, lambda folder: snap.lay_out(snap.table_of(self.tables, spec), spec, size, folder, numbers))
        return laid[name]

    def start(self, handler: Callable[[DataFrame, int], None], *, snapshot_lsn: int = 0, job_completed: bool | None = None, job_path: str | None = None, once: bool = False) -> StreamingQuery | None:
        """Snapshot (as batch -1) if one is due, then the changes after it.

        With ``job_path`` the snapshot is a job on record there: a completed one isn't
        taken again, an unfinished one goes on, and changes follow from its position.
        """
        s = self.config.snapshot
        job = SnapshotJob(self.spark, job_path) if job_path else None
        head = job.header() if job else None
        if snap.should_snapshot(s.mode, s.enabled, head["completed"] if head else job_completed, s.resnapshot):
            retry((lambda: self.run_snapshot(snapshot_lsn, handler, job)) if job else (lambda: handler(self.snapshot(snapshot_lsn), -1)))
        if self.config.snapshot_only:
            return None
        head = job.header() if job else None
        self._query = listen(self.changes(head["snapshot_lsn"] if head else snapshot_lsn), handler, self.checkpoint, once=once)
        return self._query

    def wait_until_ready(self, seconds: float = 60) -> bool:
        until = time.time() + seconds
        while time.time() < until:
            if self._query and self._query.exception() is not None:
                return False  # it died
            if self._query and (self._query.lastProgress or not self._query.isActive):
                return True
            time.sleep(0.1)
        return False

    def close(self) -> None:
        if self._query:
            self._query.stop()


# Words by which servers and file systems say that trying again may help, and SQL states of that kind by their class.
_TRANSIENT = ("timeout", "timed out", "connection reset", "connection refused", "broken pipe", "temporarily unavailable", "too many connections", "deadlock", "could not serialize", "no route to host", "executor lost")
_STATES = ("08", "40", "53", "57")


def is_transient(error: BaseException) -> bool:
    """Whether another try may succeed: losses of connection, timeouts, conflicts and shortages; not errors in what was asked."""
    state = getattr(error, "sqlstate", None) or (error.getSqlState() if hasattr(error, "getSqlState") else None)
    if state:
        return state[:2] in _STATES
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    if isinstance(error, (ValueError, TypeError, KeyError, NotImplementedError)):
        return False
    return isinstance(error, OSError) or any(x in str(error).lower() for x in _TRANSIENT)


def retry(work: Callable[[], None], attempts: int = 5, delay: float = 10.0, factor: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Run again after a failure that may pass, waiting longer each time; the last failure, and any other kind, is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return work()
        except Exception as e:
            if not left or not is_transient(e):
                raise
            sleep(delay)
            delay = next_delay(delay, factor, most)
