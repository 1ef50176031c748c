"""Source types: OIDs, the Spark types they map to, and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Type OIDs of the source database and the Spark types their text form casts to. Anything else stays text.
SPARK_TYPE = {
    16: "boolean", 18: "string", 20: "bigint", 21: "smallint", 23: "int", 25: "string", 26: "bigint", 114: "string", 700: "float", 701: "double",
    1042: "string", 1043: "string", 1082: "date", 1114: "timestamp_ntz", 1184: "timestamp", 1700: "decimal(38,18)", 2950: "string", 3802: "string",
}
INTEGER_OIDS = frozenset({20, 21, 23})


def spark_type(type_oid: int, type_mod: int = -1) -> str:
    """Numerics with a modifier keep their precision and scale."""
    if type_oid == 1700 and type_mod >= 4:
        precision, scale = (type_mod - 4) >> 16, (type_mod - 4) & 0xFFFF
        return f"decimal({precision},{scale})" if precision <= 38 else "string"
    return SPARK_TYPE.get(type_oid, "string")


def typed(value: Column, type_oid: int, type_mod: int = -1) -> Column:
    """Text to the type of the OID; null where the text doesn't fit."""
    kind = spark_type(type_oid, type_mod)
    if kind == "string":
        return value
    if kind == "boolean":
        return F.when(value.isin("t", "true"), True).when(value.isin("f", "false"), False)
    return value.try_cast(kind)


def source_time(micros: Column) -> Column:
    """Microseconds since 2000-01-01 UTC to a timestamp."""
    return F.timestamp_micros(micros.cast("bigint") + F.lit(946_684_800_000_000))


def to_source_time(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) - F.lit(946_684_800_000_000)


def parse_timestamp(c: Column) -> Column:
    """Two layouts: with a T and zone, and with a blank and none."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))


def parse_nullable_bigint(c: Column) -> Column:
    """Null for blank or unreadable text."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("bigint")
