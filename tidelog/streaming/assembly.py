"""Transaction assembly as a stateful stream: frames in, delivered changes out.

A slot's frames must be seen in order, so a slot is one key of the state. What is
kept: the open streamed chunk, one message of look-ahead (its acknowledgement
depends on whether the commit follows), the newest definition of each table, and the
frames of streamed transactions that are still open. Those lie in a map state in pieces of one
micro-batch each, so a transaction of any length adds to the store but is never
rewritten; they are read once, when it commits.

Order is all that the one task of a slot settles, in arrays (``SlotArrays``); frames
come to it packed, and what it releases is decoded in all tasks. ``SlotAssembler``
says the same rules frame by frame, and tests hold the arrays against it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.decode import decode_body
from tidelog.session import travel_by_value
from tidelog.sources import wire

OUTPUT = (
    "slot string, frame_seq bigint, op string, xid bigint, streamed boolean, table_schema string, table_name string, wal_start bigint, lsn bigint, ack_lsn bigint, "
    "emit_seq bigint, is_txn_last boolean, old_kind string, before string, after string, truncated string, cascade boolean, restart_identity boolean, error string"
)
_FIELDS = [c.split()[0] for c in OUTPUT.split(", ")]


class SlotAssembler:
    """The rules for one slot, independent of where the state is kept.

    ``state`` is a JSON-able dict; ``load(xid)`` and ``drop(xid)`` reach the frames
    buffered in earlier batches; ``pending`` collects those of this batch.
    """

    def __init__(self, state: dict, load, drop):
        self.state = state or {"active": -1, "ahead": None, "begin": None, "relations": {}, "open": {}}
        self.load, self.drop = load, drop
        self.pending: dict[int, list] = {}

    def _row(self, slot: str, frame: tuple, streamed: bool, xid: int | None, emit: int, ack: int | None, last: bool) -> tuple:
        seq, start, payload, inside = frame
        op = chr(payload[0])
        schema = table = columns = None
        if op in "IUD" and len(payload) >= 5 + 4 * inside:
            schema, table, columns = self._defined(int.from_bytes(payload[1 + 4 * inside : 5 + 4 * inside], "big"), seq) or (None, None, None)
        kind, before, after, oids, cascade, restart, error = decode_body(payload, inside, columns)
        text = lambda pairs: json.dumps(dict(pairs), ensure_ascii=False) if pairs is not None else None
        names = None if oids is None else json.dumps([".".join(d[:2]) if (d := self._defined(o, seq)) else f"oid:{o}" for o in oids])
        return slot, seq, op, xid, streamed, schema, table, start, start if op in "IUD" else None, ack, emit, last, kind, text(before), text(after), names, cascade, restart, error

    def _defined(self, oid: int, seq: int) -> tuple | None:
        """(schema, table, columns) by the last relation before the frame."""
        for at, s, t, names in reversed(self.state["relations"].get(str(oid), [])):
            if at < seq:
                return s, t, names
        return None

    def _release(self, slot: str, end: int | None) -> Iterator[tuple]:
        ahead = self.state["ahead"]
        if ahead is not None:
            frame = (ahead[0], ahead[1], bytes.fromhex(ahead[2]), False)
            last = end is not None
            yield self._row(slot, frame, False, ahead[3], frame[0], end if last else frame[1], last)
            self.state["ahead"] = None

    def frame(self, slot: str, seq: int, start: int, payload: bytes) -> Iterator[tuple]:
        s = self.state
        tag = chr(payload[0]) if payload else ""
        inside = s["active"] >= 0
        if tag in wire.CONTENT:
            if tag == "R":
                try:
                    r = wire.decode(payload, inside)
                    versions, new = s["relations"].setdefault(str(r.oid), []), [r.namespace, r.name, [c.name for c in r.columns]]
                    if not versions or versions[-1][1:] != new:  # mostly it is sent again as it was
                        versions.append([seq, *new])
                except wire.WireError:
                    pass
            if inside:
                self.pending.setdefault(s["active"], []).append((seq, start, payload, True))
                s["open"].setdefault(str(s["active"]), seq)
            else:
                yield from self._release(slot, None)
                s["ahead"] = [seq, start, payload.hex(), s["begin"]]
            return
        try:
            m = wire.decode(payload)
        except wire.WireError:
            return
        if tag == "B":
            s["ahead"], s["begin"] = None, m.xid
        elif tag == "C":
            yield from self._release(slot, m.end_lsn)
        elif tag == "S":
            s["active"] = m.xid
        elif tag == "E":
            s["active"] = -1
        else:
            s["active"] = -1
            rest = self.pending.pop(m.xid, [])
            if tag == "c":  # piece by piece; the last frame of all is the one that nothing follows
                held = None
                for f in chain(self.load(m.xid), rest):
                    if held is not None:
                        yield self._row(slot, held, True, m.xid, seq, held[1], False)
                    held = f
                if held is not None:
                    yield self._row(slot, held, True, m.xid, seq, m.end_lsn, True)
            self.drop(m.xid)
            s["open"].pop(str(m.xid), None)

    def prune(self) -> None:
        """Forget definitions that no frame still held back can ask for: all before the last one that the oldest of them may need."""
        held = [*self.state["open"].values(), *([self.state["ahead"][0]] if self.state["ahead"] else [])]
        for versions in self.state["relations"].values():
            earlier = [i for i, v in enumerate(versions) if not held or v[0] < min(held)]
            del versions[: earlier[-1] if earlier else 0]


# --- the same over many frames at once, in arrays --------------------------------

_PACKED = "slot string, frames binary"
_PACKED_ARROW = pa.schema([("slot", pa.string()), ("frames", pa.binary())])
# Full lengths of the control messages and the places of xid and end position in them, by tag.
_CONTROL = {"B": (21, 17, None), "C": (26, None, 10), "S": (6, 1, None), "E": (1, None, None), "A": (9, 1, None), "c": (30, 1, 14)}
_B, _C, _R, _S, _T, _A, _COMMIT = (ord(c) for c in "BCRSTAc")
#: At most so many frames and bytes leave in one row.
_ROWS, _BYTES = 4096, 4 << 20


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _bytes_of(payloads: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each payload begins and ends."""
    _, ends, data = payloads.buffers()
    at = np.frombuffer(ends, np.int32)[payloads.offset : payloads.offset + len(payloads) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], at[1:]


def _numbers(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for i in range(width):
        out = (out << 8) | data[at + i]
    return out


def _headed(seq: pa.Array, start: pa.Array, payload: pa.BinaryArray) -> pa.RecordBatch:
    """Frames with the kind of each (its tag; 0 for what can't be read or isn't known) and what control messages say."""
    if seq.null_count or start.null_count:
        raise ValueError("a frame without a position")
    payload = pc.fill_null(payload, b"")
    data, at, end = _bytes_of(payload)
    kind, xid, last = np.zeros(len(at), np.uint8), np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
    some = np.flatnonzero(end > at)
    tags = data[at[some]]
    for t in wire.CONTENT:
        kind[some[tags == ord(t)]] = ord(t)
    for t, (length, of_xid, of_end) in _CONTROL.items():
        own = some[tags == ord(t)]
        own = own[end[own] - at[own] >= length]
        kind[own] = ord(t)
        if of_xid is not None:
            xid[own] = _numbers(data, at[own] + of_xid, 4)
        if of_end is not None:
            last[own] = _numbers(data, at[own] + of_end, 8)
    return pa.RecordBatch.from_arrays([seq, start, pa.array(kind), pa.array(xid), pa.array(last), payload], ["seq", "start", "kind", "xid", "end", "payload"])


def _parts(payloads: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, length) of stretches that aren't too large for one row."""
    size = np.cumsum(pc.binary_length(payloads).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(size):
        before = size[first - 1] if first else 0
        end = max(first + 1, min(first + _ROWS, int(np.searchsorted(size, before + _BYTES, side="right"))))
        yield first, end - first
        first = end


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = batch.column(0).dictionary_encode()
        for code, slot in enumerate(slots.dictionary.to_pylist()):
            own = batch if len(slots.dictionary) == 1 else batch.filter(pc.equal(slots.indices, code))
            frames = _headed(own.column(1), own.column(2), own.column(3))
            for first, n in _parts(frames.column(5)):
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.string()), pa.array([_ipc(frames.slice(first, n))], pa.binary())], schema=_PACKED_ARROW)


def _before(mask: np.ndarray, values: np.ndarray, first: int) -> np.ndarray:
    """For each place the value at the last marked place before it; ``first`` where there is none."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    at = np.concatenate(([-1], at[:-1]))
    return np.where(at >= 0, values[at], first)


class SlotArrays:
    """``SlotAssembler``'s rules, applied to all frames of a micro-batch at once.

    What a frame needs from those before it (its transaction, the definition of its
    table) is settled when it comes, so a frame that is held back carries it along
    and only the newest definition of each table is kept. ``load(xid, n)`` gives the
    n-th piece of a transaction's frames, ``keep(xid, n, piece)`` lays one down.
    Released frames come out as tables; their images are decoded elsewhere.
    """

    def __init__(self, state: dict | None, load, keep, drop):
        self.state = state or {"active": -1, "begin": -1, "ahead": None, "relations": {}, "pieces": {}, "seen": -1}
        self.load, self.keep, self.drop = load, keep, drop

    def _context(self, kind: np.ndarray, inside: np.ndarray, payload: pa.BinaryArray) -> tuple[np.ndarray, list[str]]:
        """For each frame the number of a text: the definition of a row's table (JSON), or the names of a truncate's tables (JSON); -1 for none."""
        texts: dict[str, int] = {}
        number = lambda text: texts.setdefault(text, len(texts))
        codes, n = np.full(len(kind), -1, np.int64), len(kind) + 1
        known = [(int(oid), -1, number(json.dumps(d))) for oid, d in self.state["relations"].items()]
        read: dict[bytes, tuple | None] = {}
        for i in np.flatnonzero(kind == _R).tolist():
            raw = payload[i].as_py()
            plain = raw[:1] + raw[5:] if inside[i] else raw  # mostly it is sent again as it was
            if plain not in read:
                try:
                    r = wire.decode(raw, bool(inside[i]))
                    read[plain] = (r.oid, [r.namespace, r.name, [c.name for c in r.columns]])
                except wire.WireError:
                    read[plain] = None
            if read[plain]:
                oid, d = read[plain]
                known.append((oid, i, number(json.dumps(d))))
                self.state["relations"][str(oid)] = d
        known.sort()
        oids, text = np.array([k[0] for k in known], np.int64), np.array([k[2] for k in known], np.int64)
        keys = np.array([k[0] * n + k[1] + 1 for k in known], np.int64)

        def defined(oid: np.ndarray, at: np.ndarray) -> np.ndarray:
            if not known:
                return np.full(len(oid), -1, np.int64)
            j = np.searchsorted(keys, oid * n + at + 1) - 1
            return np.where((j >= 0) & (oids[j] == oid), text[j], -1)

        data, begin, end = _bytes_of(payload)
        own = np.flatnonzero(np.isin(kind, [ord(c) for c in "IUD"]) & (end - begin >= 5 + 4 * inside))
        codes[own] = defined(_numbers(data, begin[own] + 1 + 4 * inside[own], 4), own)
        cuts = np.flatnonzero(kind == _T).tolist()
        named = list(texts)
        for i in cuts:
            try:
                listed = wire.decode(payload[i].as_py(), bool(inside[i])).oids
            except wire.WireError:
                continue
            found = defined(np.array(listed, np.int64), np.full(len(listed), i))
            codes[i] = number(json.dumps([".".join(json.loads(named[c])[:2]) if c >= 0 else f"oid:{o}" for o, c in zip(listed, found.tolist())]))
        return codes, list(texts)

    def batch(self, frames: pa.Table) -> Iterator[pa.Table]:
        s = self.state
        frames = frames.combine_chunks()
        seq = frames["seq"].to_numpy()
        order = np.argsort(seq, kind="stable")
        seq = seq[order]
        new = (seq > s["seen"]) & np.concatenate(([True], seq[1:] != seq[:-1]))[: len(seq)]  # a frame that was read before is skipped
        if not new.all() or (np.diff(order) != 1).any():
            frames, seq = frames.take(pa.array(order[new])).combine_chunks(), seq[new]
        n = len(seq)
        if not n:
            return
        start, kind, xid, end = (frames[c].to_numpy() for c in ("start", "kind", "xid", "end"))
        payload = frames["payload"].chunk(0)
        marks = np.isin(kind, [ord(c) for c in "SEcA"])
        values = np.where(kind == _S, xid, -1)
        active = _before(marks, values, s["active"])
        begin = _before(kind == _B, xid, s["begin"])
        content = np.isin(kind, [ord(c) for c in wire.CONTENT])
        inside = content & (active >= 0)
        codes, texts = self._context(kind, inside, payload)
        contexts = pa.array([*texts, None], pa.string())

        def taken(at: np.ndarray) -> dict:
            # a row's share of the texts only
            used, own = np.unique(codes[at], return_inverse=True)
            context = pa.DictionaryArray.from_arrays(pa.array(own, pa.int32()), contexts.take(pa.array(np.where(used < 0, len(texts), used))))
            return {"seq": pa.array(seq[at]), "start": pa.array(start[at]), "payload": payload.take(pa.array(at)), "context": context}

        def released(rows: dict, streamed: bool, xids, emit, last: np.ndarray, ends) -> pa.Table:
            acks = np.where(last, ends, rows["start"].to_numpy())
            m = len(last)
            wide = lambda v: np.broadcast_to(v, (m,))
            x = pa.array(wide(xids), mask=np.broadcast_to(np.asarray(xids) < 0, (m,)))
            return pa.table({**rows, "streamed": pa.array(wide(streamed)), "xid": x, "emit": pa.array(wide(emit)), "ack": pa.array(acks), "last": pa.array(last)})

        # outside of streams a frame waits for what follows it: other content, the commit, or a begin that drops it
        steps = np.flatnonzero((content & ~inside) | (kind == _B) | (kind == _C))
        if len(steps):
            if s["ahead"]:
                held, own_xid = _unpacked(base64.b64decode(s["ahead"][0])), s["ahead"][1]
                if kind[steps[0]] != _B:
                    rows = {c: held[c].combine_chunks() for c in held.column_names}
                    yield released(rows, False, own_xid, rows["seq"].to_numpy(), np.array([kind[steps[0]] == _C]), end[steps[0]])
                s["ahead"] = None
            at, following = steps[:-1], steps[1:]
            go = content[at] & (kind[following] != _B)
            at, following = at[go], following[go]
            if len(at):
                yield released(taken(at), False, begin[at], seq[at], kind[following] == _C, end[following])
            if content[steps[-1]]:
                ahead = pa.RecordBatch.from_pydict(taken(steps[-1:]))
                s["ahead"] = [base64.b64encode(_ipc(ahead)).decode(), int(begin[steps[-1]])]

        # inside, a frame waits for its transaction's outcome: the first one after it
        outcomes = np.flatnonzero((kind == _COMMIT) | (kind == _A))
        outcomes = outcomes[np.argsort(xid[outcomes], kind="stable")]
        keys = xid[outcomes] * (n + 1) + outcomes

        def outcome(x: np.ndarray, after: np.ndarray) -> np.ndarray:
            if not len(outcomes):
                return np.full(len(x), -1, np.int64)
            j = np.searchsorted(keys, x * (n + 1) + after)
            o = outcomes[np.minimum(j, len(outcomes) - 1)]
            return np.where((j < len(outcomes)) & (xid[o] == x), o, -1)

        rows = np.flatnonzero(inside)
        ends = outcome(active[rows], rows)
        last_of = np.full(n, -1, np.int64)
        last_of[ends[ends >= 0]] = rows[ends >= 0]  # of several the last counts
        opened = [x for x in s["pieces"]]
        for x, o in zip(opened, outcome(np.array([int(x) for x in opened], np.int64), np.zeros(len(opened), np.int64)).tolist()):
            if o < 0:
                continue
            count = s["pieces"].pop(x)
            if kind[o] == _COMMIT:
                for p in range(count):  # piece by piece; the last frame of all is the one that nothing follows
                    held = _unpacked(self.load(int(x), p))
                    last = np.zeros(len(held), bool)
                    last[-1] = p == count - 1 and last_of[o] < 0
                    yield released({c: held[c].combine_chunks() for c in held.column_names}, True, int(x), seq[o], last, end[o])
            for p in range(count):
                self.drop(int(x), p)
        go = (ends >= 0) & (kind[ends] == _COMMIT)
        at, ends_at = rows[go], ends[go]
        if len(at):
            yield released(taken(at), True, active[at], seq[ends_at], last_of[ends_at] == at, end[ends_at])
        waiting = rows[ends < 0]
        waiting = waiting[np.argsort(active[waiting], kind="stable")]
        for at in np.split(waiting, np.flatnonzero(np.diff(active[waiting])) + 1):
            if len(at):
                x = str(int(active[at[0]]))
                count = s["pieces"].get(x, 0)
                self.keep(int(x), count, _ipc(pa.RecordBatch.from_pydict(taken(at))))
                s["pieces"][x] = count + 1
        # what the next batch begins with
        if marks.any():
            s["active"] = int(values[marks][-1])
        if (kind == _B).any():
            s["begin"] = int(xid[kind == _B][-1])
        s["seen"] = int(seq[-1])


class Assembly(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.control = handle.getValueState("control", "text string")
        self.pieces = handle.getMapState("pieces", "xid bigint, piece int", "frames binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rules = SlotArrays(
            json.loads(self.control.get()[0]) if self.control.exists() else None,
            lambda xid, n: bytes(self.pieces.getValue((xid, n))[0]),
            lambda xid, n, piece: self.pieces.updateValue((xid, n), (piece,)),
            lambda xid, n: self.pieces.removeKey((xid, n)),
        )
        for table in rules.batch(pa.concat_tables(_unpacked(bytes(p)) for frame in rows for p in frame["frames"])):
            table = table.combine_chunks()
            packed = [_ipc(table.slice(first, n).to_batches()[0]) for first, n in _parts(table["payload"].chunk(0))] if len(table) else []
            if packed:
                yield pd.DataFrame({"slot": [key[0]] * len(packed), "frames": packed})
        self.control.update((json.dumps(rules.state),))

    def close(self) -> None:
        pass


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Released frames with their images, as rows of ``OUTPUT``."""
    text = lambda pairs: json.dumps(dict(pairs), ensure_ascii=False) if pairs is not None else None
    for batch in batches:
        for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table = _unpacked(packed)
            context = table["context"].combine_chunks()
            context = context if isinstance(context, pa.DictionaryArray) else context.chunk(0)
            read = [json.loads(t) if t is not None else None for t in context.dictionary.to_pylist()]
            raw = context.dictionary.to_pylist()
            ops, schemas, names, cut, bodies = [], [], [], [], []
            for payload, inside, code in zip(table["payload"].to_pylist(), table["streamed"].to_pylist(), context.indices.to_pylist()):
                op = chr(payload[0])
                definition = read[code] if op in "IUD" else None
                schema, name, columns = definition or (None, None, None)
                old_kind, before, after, _, cascade, restart, error = decode_body(payload, inside, columns)
                ops.append(op)
                schemas.append(schema)
                names.append(name)
                cut.append(raw[code] if op == "T" else None)
                bodies.append((old_kind, text(before), text(after), cascade, restart, error))
            strings = lambda values: pa.array(values, pa.string())
            flags = lambda i: pa.array([b[i] for b in bodies], pa.bool_())
            start = table["start"].combine_chunks()
            whole = lambda c: table[c].combine_chunks()
            rows = pc.is_in(strings(ops), pa.array(["I", "U", "D"]))
            yield pa.RecordBatch.from_arrays([
                strings([slot] * len(ops)), whole("seq"), strings(ops), whole("xid"), whole("streamed"), strings(schemas), strings(names), start, pc.if_else(rows, start, pa.scalar(None, pa.int64())), whole("ack"),
                whole("emit"), whole("last"), strings([b[0] for b in bodies]), strings([b[1] for b in bodies]), strings([b[2] for b in bodies]), strings(cut), flags(3), flags(4), strings([b[5] for b in bodies]),
            ], names=_FIELDS)


def assemble_stream(frames: DataFrame) -> DataFrame:
    """Delivered changes of a stream of frames. Needs the RocksDB state store provider.

    Only the order of frames is settled slot by slot; they are packed before and their images decoded after that, in all tasks.
    """
    narrow = frames.select("slot", "frame_seq", frames["wal_start"].cast("bigint").alias("wal_start"), "payload")
    ordered = narrow.mapInArrow(_pack, _PACKED).groupBy("slot").transformWithStateInPandas(statefulProcessor=Assembly(), outputStructType=_PACKED, outputMode="append", timeMode="none")
    return ordered.repartition(max(8, frames.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_decoded, OUTPUT)


@contextmanager
def state_of(spark: SparkSession, slots: int) -> Iterator[None]:
    """A stream that is started in here for the first time keeps its state in so many parts; Spark's own choice is one a shuffle partition, each of which costs every micro-batch a task and a commit."""
    before = spark.conf.get(_STATES, None)
    spark.conf.set(_STATES, str(max(1, slots)))
    try:
        yield
    finally:
        spark.conf.unset(_STATES) if before is None else spark.conf.set(_STATES, before)


# Fixed value: a setting that Spark writes into the checkpoint and keeps to from then on.
_STATES = "spark.sql.streaming.internal.stateStore.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


travel_by_value(__name__, decode_body.__module__, wire.__name__)
