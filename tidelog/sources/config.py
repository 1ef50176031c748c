"""Configuration: files, defaults, validation, and what a snapshot covers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from tidelog.functions.naming import dsn
from tidelog.operators.publication import OPERATIONS, UnsafeCondition, check_condition

IDENTITIES = ("DEFAULT", "FULL", "NOTHING", "USING INDEX")
MODES = ("initial", "never", "snapshot_only")


class ConfigError(ValueError):
    """All that is wrong with a configuration, one line each."""


@dataclass(frozen=True)
class Table:
    name: str = ""
    schema: str = "public"
    replicaIdentity: str = "DEFAULT"  # noqa: N815
    replicaIdentityIndex: str = ""  # noqa: N815
    snapshotPartitionStrategy: str = ""  # noqa: N815
    queryCondition: str = ""  # noqa: N815
    columns: tuple[str, ...] = ()
    partitioned: bool = False

    @property
    def full_name(self) -> str:
        return f"{self.schema or 'public'}.{self.name}"

    def problems(self) -> list[str]:
        out = []
        if not self.name.strip():
            out.append("a table needs a name")
        if self.replicaIdentity not in IDENTITIES:
            out.append(f"{self.full_name}: replica identity must be one of {', '.join(IDENTITIES)}")
        if self.replicaIdentity == "FULL" and self.columns:
            out.append(f"{self.full_name}: a FULL replica identity allows no column list")
        if (self.replicaIdentity == "USING INDEX") != bool(self.replicaIdentityIndex.strip()):
            out.append(f"{self.full_name}: an index goes with replica identity USING INDEX, and only with it")
        try:
            check_condition(self.queryCondition)
        except UnsafeCondition as e:
            out.append(f"{self.full_name}: {e}")
        return out


@dataclass(frozen=True)
class Publication:
    name: str = ""
    operations: tuple[str, ...] = ()
    tables: tuple[Table, ...] = ()
    createIfNotExists: bool = False  # noqa: N815
    allTables: bool = False  # noqa: N815

    def problems(self) -> list[str]:
        out = [] if self.name.strip() else ["publication.name is empty"]
        for t in self.tables:  # conditions are checked even where the publication exists already
            out += t.problems()
        if self.createIfNotExists:
            if not self.tables and not self.allTables:
                out.append("publication.tables is empty")
            if not self.operations:
                out.append("publication.operations is empty")
            out += [f"unknown operation {o!r}" for o in self.operations if o.upper() not in OPERATIONS]
        return out


@dataclass(frozen=True)
class Slot:
    name: str = ""
    slotActivityCheckerInterval: int = 1000  # noqa: N815
    protoVersion: int = 2  # noqa: N815
    createIfNotExists: bool = False  # noqa: N815

    def problems(self) -> list[str]:
        out = [] if self.name.strip() else ["slot.name is empty"]
        if self.slotActivityCheckerInterval < 1000:
            out.append("slot.slotActivityCheckerInterval is below 1000 ms")
        if self.protoVersion not in (1, 2):
            out.append("slot.protoVersion must be 1 or 2")
        return out


@dataclass(frozen=True)
class Snapshot:
    enabled: bool = False
    mode: str = "never"
    id: str = ""
    instanceId: str = ""  # noqa: N815
    queryCondition: str = ""  # noqa: N815
    tables: tuple[Table, ...] = ()
    chunkSize: int = 8000  # noqa: N815
    claimTimeout: float = 30.0  # noqa: N815
    heartbeatInterval: float = 5.0  # noqa: N815
    resnapshot: bool = False

    def problems(self) -> list[str]:
        if not self.enabled:
            return []
        out = [] if self.mode in MODES else [f"snapshot.mode must be one of {', '.join(MODES)}"]
        out += [f"snapshot.{n} must be above 0" for n in ("chunkSize", "claimTimeout", "heartbeatInterval") if getattr(self, n) <= 0]
        if self.mode == "snapshot_only" and not self.tables:
            out.append("snapshot.tables is empty")
        for where, condition in (("snapshot", self.queryCondition), *((t.full_name, t.queryCondition) for t in self.tables)):
            try:
                check_condition(condition)
            except UnsafeCondition as e:
                out.append(f"{where}: {e}")
        return out


@dataclass(frozen=True)
class Heartbeat:
    table: Table | None = None
    interval: float = 0.1


@dataclass(frozen=True)
class Config:
    host: str = ""
    port: int = 5432
    username: str = ""
    password: str = ""
    database: str = ""
    metricPort: int = 8080  # noqa: N815
    publication: Publication = field(default_factory=Publication)
    slot: Slot = field(default_factory=Slot)
    snapshot: Snapshot = field(default_factory=Snapshot)
    heartbeat: Heartbeat = field(default_factory=Heartbeat)

    @property
    def snapshot_only(self) -> bool:
        return self.snapshot.enabled and self.snapshot.mode == "snapshot_only"

    def validate(self) -> Config:
        out = [f"{n} is empty" for n in ("host", "username", "password", "database") if not str(getattr(self, n)).strip()]
        if not self.snapshot_only:
            out += self.publication.problems() + self.slot.problems()
        out += self.snapshot.problems()
        if self.heartbeat.table:
            if self.heartbeat.interval <= 0:
                out.append("heartbeat.interval must be above 0")
            if not self.snapshot_only and self.publication.tables:
                out += self.heartbeat_problems(self.publication)
        if out:
            raise ConfigError("\n".join(out))
        return self

    def heartbeat_problems(self, publication: Publication) -> list[str]:
        beat = self.heartbeat.table
        if not beat or publication.allTables or self.publication.allTables or beat.full_name in {t.full_name for t in publication.tables}:
            return []
        return [f"heartbeat table {beat.full_name} is not in publication {publication.name!r}"]

    def snapshot_tables(self, published: Publication) -> list[Table]:
        """The tables of a snapshot: its own ones in snapshot_only mode, else (a subset of) the published ones.

        What the user set for a table wins over what the publication says: strategy, condition, columns, partitioned.
        """
        if self.snapshot_only:
            if not self.snapshot.tables:
                raise ConfigError("snapshot.tables is empty")
            return list(self.snapshot.tables)
        known = {t.full_name: t for t in published.tables}
        mine = {t.full_name: t for t in (self.snapshot.tables or self.publication.tables)}
        if self.snapshot.tables and (missing := sorted(set(mine) - set(known))):
            raise ConfigError(f"not in publication {published.name!r}: {', '.join(missing)}")
        names = list(mine) if self.snapshot.tables else list(known)
        return [_merged(known[n], mine.get(n)) for n in names]

    def dsn(self, **params: str) -> str:
        return dsn(self.host, self.port, self.username, self.password, self.database, params or None)

    def shown(self) -> dict:
        """For logs: without the password."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "password"}


def _merged(table: Table, own: Table | None) -> Table:
    if own is None:
        return table
    return replace(table, snapshotPartitionStrategy=own.snapshotPartitionStrategy or table.snapshotPartitionStrategy, queryCondition=own.queryCondition or table.queryCondition, columns=own.columns or table.columns, partitioned=own.partitioned or table.partitioned)


def differing_tables(wanted: list[Table], actual: list[Table]) -> list[Table]:
    """Tables to alter: those whose identity, index, columns or partitioning differ, or that are missing."""
    known = {t.full_name: t for t in actual}
    shape = lambda t: (t.replicaIdentity, t.replicaIdentityIndex, t.columns, t.partitioned)
    return [t for t in wanted if t.full_name not in known or shape(known[t.full_name]) != shape(t)]


def _build(cls, data: dict | None, **nested):
    names = {f.name for f in fields(cls)}
    return cls(**{k: nested.get(k, lambda x: x)(v) for k, v in (data or {}).items() if k in names and v is not None})


def _tables(rows: list[dict]) -> tuple[Table, ...]:
    return tuple(_build(Table, {**r, "schema": r.get("schema") or "public"}, columns=tuple) for r in rows)


def _seconds(x) -> float:
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    if isinstance(x, str):
        for unit in ("ms", "s", "m", "h"):
            if x.endswith(unit) and x[: -len(unit)].replace(".", "", 1).isdigit():
                return float(x[: -len(unit)]) * units[unit]
        raise ConfigError(f"not a duration: {x!r}")
    return float(x)


def from_dict(data: dict) -> Config:
    data = dict(data)
    metric = data.pop("metric", None) or {}
    if metric.get("port"):
        data["metricPort"] = metric["port"]
    return _build(
        Config, data,
        publication=lambda d: _build(Publication, d, tables=_tables, operations=tuple),
        slot=lambda d: _build(Slot, d),
        snapshot=lambda d: _build(Snapshot, d, tables=_tables, claimTimeout=_seconds, heartbeatInterval=_seconds),
        heartbeat=lambda d: _build(Heartbeat, d, table=lambda t: _tables([t])[0] if t.get("name") else None, interval=_seconds),
    )


def read_config(path: str) -> Config:
    """A YAML or JSON file, by its suffix."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return from_dict(yaml.safe_load(f) or {})
        if path.endswith(".json"):
            return from_dict(json.load(f))
    raise ConfigError(f"neither YAML nor JSON: {path}")
