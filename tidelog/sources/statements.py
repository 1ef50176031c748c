"""What is said to a source server, as text, and how Spark reads snapshot chunks from it over JDBC.

Nothing here connects: a driver with a connection executes the statements, and Spark's
own JDBC source reads the chunks, one partition each, in sessions that all see the
exported snapshot. The syntax is that of PostgreSQL's documentation.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from tidelog.functions.lsn import format_lsn
from tidelog.operators.snapshot import BLOCK, RANGE, TableSpec
from tidelog.sources.config import Config, Table


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _full(schema: str, name: str) -> str:
    return f"{quoted(schema or 'public')}.{quoted(name)}"


# --- replication -----------------------------------------------------------------


def create_slot(name: str) -> str:
    return f"CREATE_REPLICATION_SLOT {quoted(name)} LOGICAL pgoutput"


def slot_info(name: str) -> str:
    """One row in the shape of the ``slot_info`` table."""
    columns = "slot_name, slot_type, active, active_pid, restart_lsn, confirmed_flush_lsn, wal_status, pg_current_wal_lsn() AS current_lsn"
    return f"SELECT {columns} FROM pg_replication_slots WHERE slot_name = {literal(name)}"


def start_replication(config: Config, lsn: int = 0) -> str:
    """Follow the slot from a position; streaming of open transactions from version 2 on."""
    options = [f"proto_version {literal(str(config.slot.protoVersion))}", f"publication_names {literal(quoted(config.publication.name))}"]
    if config.slot.protoVersion >= 2:
        options.append("streaming 'true'")
    return f"START_REPLICATION SLOT {quoted(config.slot.name)} LOGICAL {format_lsn(lsn)} ({', '.join(options)})"


# --- consistent snapshots ----------------------------------------------------------

#: Run in a transaction that stays open while the chunks are read: the identifier that other sessions can join.
EXPORT_SNAPSHOT = ["BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY", "SELECT pg_export_snapshot(), pg_current_wal_lsn()"]


def join_snapshot(snapshot_id: str) -> str:
    return f"BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY; SET TRANSACTION SNAPSHOT {literal(snapshot_id)}"


def chunk_query(spec: TableSpec, chunk: dict) -> str:
    """The rows of one chunk: by ranges of the key, by physical blocks, or (all other strategies) by offset."""
    where = [f"({spec.condition})"] if spec.condition and spec.condition.strip() else []
    kind = chunk.get("partition_strategy")
    tail = ""
    if kind == RANGE and chunk.get("range_start") is not None:
        where.append(f"{quoted(spec.key[0])} BETWEEN {chunk['range_start']:d} AND {chunk['range_end']:d}")
    elif kind == BLOCK:
        where.append(f"ctid >= '({chunk['block_start']:d},0)'::tid")
        if chunk.get("block_end") is not None and not chunk.get("is_last_chunk"):  # rows may have come behind the last planned block
            where.append(f"ctid < '({chunk['block_end']:d},0)'::tid")
    elif kind != RANGE:
        order = ", ".join(quoted(k) for k in spec.key) or "ctid"
        tail = f" ORDER BY {order} LIMIT {chunk['chunk_size']:d} OFFSET {chunk['chunk_start']:d}"
    columns = ", ".join(quoted(c) for c in dict.fromkeys([*spec.columns, *spec.key])) if spec.columns else "*"
    return f"SELECT {columns} FROM {_full(spec.schema, spec.name)}" + (f" WHERE {' AND '.join(where)}" if where else "") + tail


def jdbc_options(config: Config, query: str, snapshot_id: str | None = None, fetch_rows: int = 10_000) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for one chunk; every session joins the exported snapshot before it reads."""
    out = {"url": f"jdbc:postgresql://{config.host}:{config.port}/{config.database}", "user": config.username, "password": config.password, "query": query, "fetchsize": str(fetch_rows), "driver": "org.postgresql.Driver"}
    if snapshot_id:
        out["sessionInitStatement"] = join_snapshot(snapshot_id)
    return out


# --- heartbeats --------------------------------------------------------------------


def heartbeat_setup(table: Table) -> list[str]:
    """A table of one row, made once."""
    full = _full(table.schema, table.name)
    return [
        f"CREATE TABLE IF NOT EXISTS {full} (id int PRIMARY KEY DEFAULT 1 CHECK (id = 1), last_heartbeat timestamptz NOT NULL DEFAULT now())",
        f"INSERT INTO {full} (id) VALUES (1) ON CONFLICT (id) DO NOTHING",
    ]


def heartbeat(table: Table) -> str:
    return f"UPDATE {_full(table.schema, table.name)} SET last_heartbeat = now() WHERE id = 1"


class HeartbeatWriter:
    """Touches the heartbeat row every ``interval`` seconds, so that a quiet slot's position moves on.

    ``execute`` runs a statement on a connection of its own; a beat that fails is counted and the next one tried.
    """

    def __init__(self, config: Config, execute: Callable[[str], None]):
        if config.heartbeat.table is None:
            raise ValueError("no heartbeat table")
        self.table, self.interval, self.execute = config.heartbeat.table, config.heartbeat.interval, execute
        self.beats = self.failures = 0
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> HeartbeatWriter:
        for statement in heartbeat_setup(self.table):
            self.execute(statement)
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            try:
                self.execute(heartbeat(self.table))
                self.beats += 1
            except Exception:
                self.failures += 1

    def close(self) -> None:
        self._stop.set()
        self._thread.join(timeout=5)
