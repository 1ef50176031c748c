"""A streaming source of captured frames whose offsets are log positions.

``spark.dataSource.register(ReplicationSource)``, then
``spark.readStream.format("tidelog_replication").option("path", ...)``. The frames
are Parquet files of one slot; an offset is the position up to which frames were
read. A micro-batch reads at most ``maxFiles`` files' worth of new positions, each
file as one task, and only the row groups whose positions fall into it. When Spark
has made a batch durable it calls ``commit``: the position becomes the slot's
confirmed one, written as the status report the server would get. Spark is always
one batch behind with that, so after a crash the last batch comes again; appliers
must be, and here are, safe to repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelog.session import travel_by_value
from tidelog.sources import wire
from tidelog.sources.frames import FRAMES


class TimelineSwitch(RuntimeError):
    """The server's history went on under another timeline; positions no longer compare."""


def _filesystem(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path:
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path.removeprefix("file:")


class FrameRange(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class ReplicationReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("no folder of frames")
        self.fs, self.folder = _filesystem(self.path)
        if not self.fs.get_file_info(self.folder).is_file and self.fs.get_file_info(self.folder).type.name != "Directory":
            raise ValueError(f"no folder of frames: {self.path!r}")
        self.start = int(options.get("startinglsn", options.get("startingLsn", "0")))
        self.ack = options.get("ackfile", options.get("ackFile"))
        self.max_files = int(options.get("maxfiles", options.get("maxFiles", "64")))
        if options.get("timeline", "1") != options.get("servertimeline", options.get("timeline", "1")):
            raise TimelineSwitch(f"timeline {options['servertimeline']} instead of {options['timeline']}")
        self.reached = self.start
        self.confirmed = 0
        self.ranges: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self) -> dict:  # file systems don't travel to the executors
        return {k: v for k, v in self.__dict__.items() if k != "fs"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.fs, self.folder = _filesystem(self.path)

    def _files(self) -> list[tuple[str, int, int]]:
        """(file, lowest, highest position) from the footers."""
        from pyarrow.fs import FileSelector

        out = []
        for info in sorted(self.fs.get_file_info(FileSelector(self.folder)), key=lambda i: i.path):
            file = info.path
            if not file.endswith(".parquet"):
                continue
            if file not in self.ranges:  # files never change
                self.ranges[file] = self._range(file)
            if self.ranges[file]:
                out.append((file, *self.ranges[file]))
        return sorted(out, key=lambda f: f[2])

    def _range(self, file: str) -> tuple[int, int] | None:
        import pyarrow.parquet as pq

        with self.fs.open_input_file(file) as f:
            meta = pq.read_metadata(f)
        at = meta.schema.names.index("wal_start")
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        if stats and all(s is not None and s.has_min_max for s in stats):
            return min(int(s.min) for s in stats), max(int(s.max) for s in stats)
        if not stats:
            return None
        import pyarrow.compute as pc

        with self.fs.open_input_file(file) as f:
            ends = pc.min_max(pq.read_table(f, columns=["wal_start"])["wal_start"]).as_py()
        return int(ends["min"]), int(ends["max"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lsn": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        ahead = [f for f in self._files() if f[2] >= self.reached]
        if ahead:
            self.reached = ahead[: self.max_files][-1][2] + 1
        return {"lsn": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FrameRange(f, start["lsn"], end["lsn"]) for f, low, high in self._files() if high >= start["lsn"] and low < end["lsn"]]

    def read(self, partition: FrameRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        file = pq.ParquetFile(self.fs.open_input_file(partition.file))
        for batch in file.iter_batches(batch_size=8192):
            at = pc.cast(batch.column(batch.schema.names.index("wal_start")), pa.int64())
            yield batch.filter(pc.and_(pc.greater_equal(at, partition.low), pc.less(at, partition.high))).select([c.split()[0] for c in FRAMES.split(", ")])

    def commit(self, end: dict) -> None:
        self.confirmed = max(self.confirmed, int(end["lsn"]))
        self._report()

    def _report(self) -> None:
        if self.ack:
            import time

            report = wire.status_update(self.confirmed, self.confirmed, int(time.time() * 1e6))
            fs, path = _filesystem(self.ack)  # where the frames are, so that a driver that starts elsewhere finds it
            with fs.open_output_stream(f"{path}.tmp") as f:
                f.write(json.dumps({"confirmed": self.confirmed, "report": report.hex()}).encode())
            fs.move(f"{path}.tmp", path)

    def stop(self) -> None:
        if self.confirmed:  # a last report, if anything was confirmed
            self._report()


class ReplicationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_replication"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ReplicationReader(dict(self.options))


travel_by_value(__name__, wire.__name__)
