"""The logical replication wire format: decoding and encoding of single messages.

Pure Python, no Spark: used inside Arrow functions on the executors and in tests.
All numbers are big-endian. A message that is too short or otherwise malformed
raises ``WireError``; callers route it to a dead-letter column instead of failing.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed value: microseconds from 1970-01-01 to 2000-01-01, the format's epoch.
EPOCH_MICROS = 946_684_800_000_000

# Message tags.
TAGS = {"B": "begin", "C": "commit", "R": "relation", "I": "insert", "U": "update", "D": "delete", "T": "truncate", "S": "stream_start", "E": "stream_stop", "A": "stream_abort", "c": "stream_commit"}
#: Known to the protocol but carrying nothing that is decoded here.
UNSUPPORTED = {"M": "message", "O": "origin", "Y": "type"}
#: Messages that belong to a transaction's content.
CONTENT = frozenset("IUDTR")


class WireError(ValueError):
    """The bytes aren't a message of this format."""


class Cursor:
    """Checked reading of fixed fields, C strings and length-prefixed bytes."""

    __slots__ = ("data", "at")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise WireError(f"{n} bytes wanted at {self.at}, {len(self.data) - self.at} left")
        part = self.data[self.at : end]
        self.at = end
        return part

    def number(self, width: int) -> int:
        return int.from_bytes(self._take(width), "big")

    def signed(self, width: int) -> int:
        return int.from_bytes(self._take(width), "big", signed=True)

    def char(self) -> str:
        return chr(self._take(1)[0])

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise WireError(f"no end of string after {self.at}")
        part = self.data[self.at : end]
        self.at = end + 1
        return part.decode("utf-8", "replace")

    def value(self) -> bytes:
        return self._take(self.number(4))


@dataclass
class Column:
    name: str
    type_oid: int
    type_mod: int = -1
    flags: int = 0


@dataclass
class Relation:
    oid: int
    namespace: str
    name: str
    identity: str
    columns: list[Column] = field(default_factory=list)
    xid: int | None = None


#: A tuple's columns: (kind, value) with kind n null, u unchanged, t text, b binary.
Tuple = list[tuple[str, bytes | None]]


@dataclass
class Change:
    op: str
    oid: int
    xid: int | None = None
    old_kind: str | None = None
    old: Tuple | None = None
    new: Tuple | None = None


@dataclass
class Truncate:
    oids: list[int]
    cascade: bool
    restart_identity: bool
    xid: int | None = None


@dataclass
class Boundary:
    """Begin, commit and the streaming markers; fields that a kind lacks are None."""

    tag: str
    xid: int | None = None
    sub_xid: int | None = None
    lsn: int | None = None
    end_lsn: int | None = None
    time_micros: int | None = None
    flags: int | None = None
    first: bool | None = None


def _tuple(c: Cursor) -> Tuple:
    out: Tuple = []
    for _ in range(c.number(2)):
        kind = c.char()
        if kind in "nu":
            out.append((kind, None))
        elif kind in "tb":
            out.append((kind, c.value()))
        else:
            raise WireError(f"unknown column kind {kind!r}")
    return out


def _relation(c: Cursor, xid: int | None) -> Relation:
    r = Relation(c.number(4), c.text(), c.text(), c.char(), xid=xid)
    for _ in range(c.number(2)):
        flags, name = c.number(1), c.text()
        r.columns.append(Column(name, c.number(4), c.signed(4), flags))
    return r


def _change(c: Cursor, op: str, xid: int | None) -> Change:
    m = Change(op, c.number(4), xid)
    kind = c.char()
    if op == "D":
        # the kind is taken as it comes
        m.old_kind, m.old = kind, _tuple(c)
        return m
    if op == "U" and kind in "KO":
        m.old_kind, m.old = kind, _tuple(c)
        kind = c.char()
    if kind != "N":
        raise WireError(f"new tuple wanted, found {kind!r}")
    m.new = _tuple(c)
    return m


def decode(payload: bytes, in_stream: bool = False):
    """One message. ``in_stream``: it stands between a stream start and its stop, where content messages carry an xid."""
    if not payload:
        raise WireError("empty message")
    c = Cursor(bytes(payload))
    tag = c.char()
    if tag in CONTENT:
        xid = c.number(4) if in_stream else None
        if tag == "R":
            return _relation(c, xid)
        if tag == "T":
            n, options = c.number(4), c.number(1)
            return Truncate([c.number(4) for _ in range(n)], bool(options & 1), bool(options & 2), xid)
        return _change(c, tag, xid)
    if tag == "B":
        return Boundary(tag, lsn=c.number(8), time_micros=c.signed(8) + EPOCH_MICROS, xid=c.number(4))
    if tag == "C":
        return Boundary(tag, flags=c.number(1), lsn=c.number(8), end_lsn=c.number(8), time_micros=c.signed(8) + EPOCH_MICROS)
    if tag == "S":
        return Boundary(tag, xid=c.number(4), first=c.number(1) == 1)
    if tag == "E":
        return Boundary(tag)
    if tag == "A":
        return Boundary(tag, xid=c.number(4), sub_xid=c.number(4))
    if tag == "c":
        return Boundary(tag, xid=c.number(4), flags=c.number(1), lsn=c.number(8), end_lsn=c.number(8), time_micros=c.signed(8) + EPOCH_MICROS)
    raise WireError(f"unsupported message {UNSUPPORTED.get(tag, tag)!r}")


def decode_envelope(data: bytes) -> tuple[str, dict]:
    """A copy-data packet: ``w`` (log data) or ``k`` (keepalive)."""
    c = Cursor(bytes(data))
    tag = c.char()
    if tag == "w":
        start, end, time = c.number(8), c.number(8), c.signed(8)
        return tag, {"wal_start": start, "wal_end": end, "time_micros": time + EPOCH_MICROS, "payload": c.data[c.at :]}
    if tag == "k":
        if len(data) != 18:
            raise WireError("a keepalive has 17 bytes after its tag")
        return tag, {"wal_end": c.number(8), "time_micros": c.signed(8) + EPOCH_MICROS, "reply": c.number(1) == 1}
    raise WireError(f"unknown packet {tag!r}")


# --- values ------------------------------------------------------------------


def named(values: Tuple, columns: list[str]) -> dict[str, str | None]:
    """Column name to text. Null is a value; unchanged and binary columns are left out, which is not the same."""
    if len(values) > len(columns):
        raise WireError(f"{len(values)} values for {len(columns)} columns")
    return {n: v.decode("utf-8", "replace") if v is not None else None for n, (k, v) in zip(columns, values) if k in "tn"}


def fill_unchanged(new: Tuple, old: Tuple | None) -> Tuple:
    """Unchanged columns take what the old tuple holds at their place (a key tuple holds null there)."""
    if not old:
        return new
    return [old[i] if v[0] == "u" and i < len(old) else v for i, v in enumerate(new)]


# --- encoding ----------------------------------------------------------------


def _text(s: str) -> bytes:
    return s.encode("utf-8") + b"\0"


def encode_tuple(values: Tuple) -> bytes:
    out = [struct.pack(">H", len(values))]
    for kind, v in values:
        out.append(kind.encode())
        if kind in "tb":
            out.append(struct.pack(">I", len(v)) + v)
    return b"".join(out)


def encode(m) -> bytes:
    """The inverse of ``decode``; content messages with an xid are encoded as inside a stream."""
    if isinstance(m, Relation):
        head = b"R" + (struct.pack(">I", m.xid) if m.xid is not None else b"") + struct.pack(">I", m.oid) + _text(m.namespace) + _text(m.name) + m.identity.encode() + struct.pack(">H", len(m.columns))
        return head + b"".join(struct.pack(">B", c.flags) + _text(c.name) + struct.pack(">Ii", c.type_oid, c.type_mod) for c in m.columns)
    if isinstance(m, Truncate):
        options = int(m.cascade) | int(m.restart_identity) << 1
        return b"T" + (struct.pack(">I", m.xid) if m.xid is not None else b"") + struct.pack(">IB", len(m.oids), options) + b"".join(struct.pack(">I", o) for o in m.oids)
    if isinstance(m, Change):
        out = m.op.encode() + (struct.pack(">I", m.xid) if m.xid is not None else b"") + struct.pack(">I", m.oid)
        if m.old is not None:
            out += (m.old_kind or "K").encode() + encode_tuple(m.old)
        return out if m.op == "D" else out + b"N" + encode_tuple(m.new or [])
    t = (m.time_micros or EPOCH_MICROS) - EPOCH_MICROS
    if m.tag == "B":
        return b"B" + struct.pack(">QqI", m.lsn, t, m.xid)
    if m.tag == "C":
        return b"C" + struct.pack(">BQQq", m.flags or 0, m.lsn, m.end_lsn, t)
    if m.tag == "S":
        return b"S" + struct.pack(">IB", m.xid, int(bool(m.first)))
    if m.tag == "E":
        return b"E"
    if m.tag == "A":
        return b"A" + struct.pack(">II", m.xid, m.sub_xid if m.sub_xid is not None else m.xid)
    if m.tag == "c":
        return b"c" + struct.pack(">IBQQq", m.xid, m.flags or 0, m.lsn, m.end_lsn, t)
    raise WireError(f"can't encode {m!r}")


def status_update(received: int, flushed: int, now_micros: int, reply: bool = False) -> bytes:
    """The consumer's report of its positions (34 bytes)."""
    return b"r" + struct.pack(">QQQqB", received, flushed, flushed, now_micros - EPOCH_MICROS, int(reply))
