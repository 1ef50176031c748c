import time

import pytest

from tidelog.operators.snapshot import TableSpec
from tidelog.sources import config, statements

CONFIG = {"host": "h", "username": "u", "password": "p", "database": "d", "publication": {"name": "p'u\"b"}, "slot": {"name": "s"}, "heartbeat": {"table": {"name": "beat"}, "interval": 0.01}}


def test_replication():
    c = config.from_dict(CONFIG)
    assert statements.start_replication(c, (22 << 32) + 10) == """START_REPLICATION SLOT "s" LOGICAL 16/A (proto_version '2', publication_names '"p''u""b"', streaming 'true')"""
    one = config.from_dict({**CONFIG, "slot": {"name": "s", "protoVersion": 1}})
    assert "streaming" not in statements.start_replication(one) and "LOGICAL 0/0" in statements.start_replication(one)
    assert statements.create_slot('a"b') == 'CREATE_REPLICATION_SLOT "a""b" LOGICAL pgoutput'
    assert statements.slot_info("x'y").endswith("slot_name = 'x''y'")


def test_chunks():
    spec = TableSpec("t", "ops", ("id",), columns=("name",), condition="a = 1 OR b")
    chunk = {"partition_strategy": "integer_range", "range_start": 5, "range_end": 9, "chunk_start": 0, "chunk_size": 5}
    assert statements.chunk_query(spec, chunk) == 'SELECT "name", "id" FROM "ops"."t" WHERE (a = 1 OR b) AND "id" BETWEEN 5 AND 9'
    assert statements.chunk_query(TableSpec("t", key=("id",)), {**chunk, "range_start": None}) == 'SELECT * FROM "public"."t"'
    block = {"partition_strategy": "ctid_block", "block_start": 80, "block_end": 160, "is_last_chunk": False}
    assert statements.chunk_query(TableSpec("t"), block) == """SELECT * FROM "public"."t" WHERE ctid >= '(80,0)'::tid AND ctid < '(160,0)'::tid"""
    assert "<" not in statements.chunk_query(TableSpec("t"), {**block, "is_last_chunk": True})
    for kind in ("offset", "whatever", None):
        assert statements.chunk_query(TableSpec("t", key=("a", "b")), {"partition_strategy": kind, "chunk_start": 20, "chunk_size": 10}).endswith('ORDER BY "a", "b" LIMIT 10 OFFSET 20')
    options = statements.jdbc_options(config.from_dict(CONFIG), "SELECT 1", "0003-1")
    assert options["sessionInitStatement"].endswith("SET TRANSACTION SNAPSHOT '0003-1'") and options["url"] == "jdbc:postgresql://h:5432/d"


def test_heartbeats():
    said = []

    def execute(statement):
        said.append(statement)
        if len(said) == 4:
            raise OSError

    writer = statements.HeartbeatWriter(config.from_dict(CONFIG), execute).start()
    end = time.time() + 5
    while writer.beats < 3 and time.time() < end:
        time.sleep(0.01)
    writer.close()
    assert writer.beats >= 3 and writer.failures == 1
    assert said[0].startswith('CREATE TABLE IF NOT EXISTS "public"."beat"') and "ON CONFLICT" in said[1] and all(s.startswith('UPDATE "public"."beat"') for s in said[2:])
    n = len(said)
    time.sleep(0.05)
    assert len(said) == n
    with pytest.raises(ValueError):
        statements.HeartbeatWriter(config.from_dict({k: v for k, v in CONFIG.items() if k != "heartbeat"}), execute)
