"""Names, codes and small scalar helpers."""

from __future__ import annotations

import os
import socket
from urllib.parse import quote

from pyspark.sql import Column, functions as F

# Replica identity codes of the source catalog.
REPLICA_IDENTITY = {"d": "DEFAULT", "f": "FULL", "n": "NOTHING", "i": "USING INDEX"}


def qualified(schema: Column, table: Column) -> Column:
    """``schema.table``; a missing or empty schema means public."""
    return F.concat(F.coalesce(F.nullif(schema, F.lit("")), F.lit("public")), F.lit("."), table)


def replica_identity(code: Column) -> Column:
    """Name of a replica identity code; an unknown code stays itself."""
    pairs = [F.lit(x) for kv in REPLICA_IDENTITY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def latency_micros(now: Column, then: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))


def ceil_div(n: Column | int, size: Column | int):
    """Whole number of pieces of ``size`` that hold ``n``."""
    if isinstance(n, int) and isinstance(size, int):
        return -(-n // size)
    n = n if isinstance(n, Column) else F.lit(n)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor((n + size - 1) / size).cast("bigint")


def next_delay(delay: float, factor: float, most: float) -> float:
    return min(delay * factor, most)


def instance_id() -> str:
    return f"{socket.gethostname()}-{os.getpid()}"


def snapshot_slot_name(database: str, snapshot_id: str | None = None) -> str:
    return snapshot_id or f"snapshot_only_{database}"


def dsn(host: str, port: int, user: str, password: str, database: str, params: dict[str, str] | None = None) -> str:
    """Connection string with all parts escaped."""
    tail = "?" + "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in sorted(params.items())) if params else ""
    return f"postgres://{quote(user, safe='')}:{quote(password, safe='')}@{host}:{port}/{quote(database, safe='')}{tail}"


def operations_list(ops: list[str]) -> str:
    return ", ".join(ops)


def lock_key(name: str) -> int:
    """The number that stands for a name in an advisory lock: a 64-bit polynomial hash without its sign."""
    h = 0
    for b in name.encode("utf-8"):
        h = (h * 31 + b) & 0xFFFFFFFFFFFFFFFF
    h = h - (1 << 64) if h >> 63 else h
    return abs(h) if h != -(1 << 63) else h
