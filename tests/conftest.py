import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


CHANGE_LOG = "delivery_id bigint, batch_no bigint, slot_name string, op string, table_schema string, table_name string, oid bigint, xid bigint, streamed boolean, lsn decimal(20,0), message_time timestamp_ntz, received_at timestamp_ntz, row_key string, old_kind string, new_decoded map<string,string>, old_decoded map<string,string>"


@pytest.fixture(scope="session")
def change_rows(spark):
    """Builds a change log from short rows (delivery, slot, op, table, xid, lsn, key, new, old_kind, old)."""
    from datetime import datetime, timedelta
    from decimal import Decimal

    def build(rows):
        t0 = datetime(2025, 1, 1)
        full = [(d, 1, slot, op, None, table, 1, xid, False, Decimal(lsn) if lsn is not None else None, t0 + timedelta(seconds=lsn or 0), t0, key, kind, new, old) for d, slot, op, table, xid, lsn, key, new, kind, old in rows]
        return spark.createDataFrame(full, CHANGE_LOG)

    return build


@pytest.fixture(scope="session")
def commit_rows(spark):
    def build(pairs):
        return spark.createDataFrame([(s, x, 10**6) for s, x in pairs], "slot_name string, xid bigint, commit_lsn bigint")

    return build
