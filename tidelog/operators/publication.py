"""What a publication lets through: tables, operations, columns, and where changes of partitions appear."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

OPERATIONS = {"INSERT": "I", "UPDATE": "U", "DELETE": "D", "TRUNCATE": "T"}

# Sequences and keywords that a row condition must not contain.
_UNSAFE_SEQUENCES = [";", "--", "/*", "$$"]
_UNSAFE_KEYWORDS = ["DROP", "ALTER", "CREATE", "TRUNCATE", "INSERT", "UPDATE", "DELETE", "GRANT", "REVOKE", "COPY", "EXECUTE", "DO"]
_KEYWORD = re.compile(r"(?i)\b(" + "|".join(_UNSAFE_KEYWORDS) + r")\b")


class UnsafeCondition(ValueError):
    pass


def check_condition(condition: str | None) -> None:
    """Reject conditions that could do more than filter. Blank is fine; keywords count inside literals too."""
    if not condition or not condition.strip():
        return
    for s in _UNSAFE_SEQUENCES:
        if s in condition:
            raise UnsafeCondition(f"a condition must not contain {s!r}")
    if m := _KEYWORD.search(condition):
        raise UnsafeCondition(f"a condition must not contain the keyword {m[0]!r}")


def both_conditions(existing: str | None, extra: str | None) -> str | None:
    """``existing AND (extra)``, where either may be missing."""
    parts = [x.strip() for x in (existing, extra) if x and x.strip()]
    return None if not parts else parts[0] if len(parts) == 1 else f"({parts[0]}) AND ({parts[1]})"


def condition_for(table: str, per_table: dict[str, str], general: str | None) -> str | None:
    """A table's own condition, else the general one. Names without a schema belong to public."""
    full = table if "." in table else f"public.{table}"
    own = {k if "." in k else f"public.{k}": v for k, v in per_table.items()}.get(full)
    return own if own and own.strip() else general


def filter_rows(df: DataFrame, condition: str | None) -> DataFrame:
    """Row filter of snapshots; pushed to the scan. Changes are never filtered by it."""
    check_condition(condition)
    return df.filter(F.expr(condition)) if condition and condition.strip() else df


def select_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Column list of snapshots; None means all."""
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def keep_columns(image: Column, columns: list[str] | None) -> Column:
    """Column list of changes, on a map of column values."""
    return F.map_filter(image, lambda k, _: k.isin(list(columns))) if columns else image


def keep_columns_of(image: Column, table: Column, lists: dict[str, list[str]]) -> Column:
    """The same on images as JSON text, with a list for some tables."""
    out = image
    for name, columns in sorted(lists.items()):
        out = F.when(table == name, F.to_json(keep_columns(F.from_json(image, "map<string,string>"), columns), {"ignoreNullFields": "false"})).otherwise(out)
    return out


def keep_operations(changes: DataFrame, operations: list[str], op: str = "op") -> DataFrame:
    """Changes of the listed operations (full names or letters)."""
    return changes.filter(F.col(op).isin([OPERATIONS.get(o.upper(), o) for o in operations]))


def keep_members(changes: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Changes whose table (or key) is a member. Spark broadcasts the members only if they are small."""
    return changes.join(members.select(*on).distinct(), on, "left_semi")


def to_root(changes: DataFrame, roots: DataFrame, table: str, child: str = "child", root: str = "root") -> DataFrame:
    """Changes of a partition appear under its root table; others keep their name. Also for hypertable chunks."""
    names = roots.select(F.col(child).alias("__child"), F.col(root).alias("__root")).dropDuplicates(["__child"])
    joined = changes.join(names, changes[table] == names["__child"], "left")
    return joined.withColumn(table, F.coalesce("__root", F.col(table))).drop("__child", "__root")


def without_heartbeats(changes: DataFrame, is_heartbeat: Column, op: str = "op") -> DataFrame:
    """Row changes of the heartbeat table are acknowledged but not delivered; truncates are delivered."""
    return changes.filter(~F.coalesce(is_heartbeat & F.col(op).isin("I", "U", "D"), F.lit(False)))


IDENTITY = ["table_schema", "table_name", "replica_identity", "replica_identity_index", "column_list", "is_partitioned"]


def identity_differences(wanted: DataFrame, actual: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Configured tables without an equal one in the catalog: those to alter. Nulls equal nulls."""
    on = on or [c for c in IDENTITY if c in wanted.columns and c in actual.columns]
    a, b = wanted.alias("a"), actual.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    return a.join(b, same, "left_anti")


def table_lists(tables: DataFrame, by: list[str], name: Column, out: str = "tables") -> DataFrame:
    """The names of each group in order, joined by commas."""
    return tables.groupBy(*by).agg(F.concat_ws(",", F.sort_array(F.collect_list(name))).alias(out))


def newest_tables(tables: DataFrame) -> DataFrame:
    """The newest configured entry of each table, with ``public`` for a missing schema."""
    schema = F.coalesce(F.nullif(F.col("table_schema"), F.lit("")), F.lit("public"))
    rest = [c for c in tables.columns if c not in ("table_schema", "table_name")]
    newest = tables.filter("table_name is not null").groupBy(schema.alias("table_schema"), "table_name").agg(F.max_by(F.struct(*rest), F.struct("config_rev", "pub_row_id")).alias("row"))
    return newest.select("table_schema", "table_name", "row.*")


def catalog_identities(relations: DataFrame) -> DataFrame:
    """(table_schema, table_name, replica_identity) of each table by its newest Relation message."""
    from tidelog.functions.naming import replica_identity

    schema = F.coalesce(F.nullif(F.col("table_schema"), F.lit("")), F.lit("public"))
    newest = relations.filter("table_name is not null").groupBy(schema.alias("table_schema"), "table_name").agg(F.max_by("replica_id", F.struct("lsn", "relation_id")).alias("code"))
    return newest.select("table_schema", "table_name", replica_identity(F.col("code")).alias("replica_identity"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def alter_statements(tables: DataFrame) -> DataFrame:
    """(table_schema, table_name, statement): what gives each table the identity that is configured for it."""
    identity = F.when(F.col("replica_identity") == "USING INDEX", F.concat(F.lit("USING INDEX "), _quoted(F.col("replica_identity_index")))).otherwise(F.col("replica_identity"))
    return tables.select("table_schema", "table_name", F.concat(F.lit("ALTER TABLE "), _quoted(F.col("table_schema")), F.lit("."), _quoted(F.col("table_name")), F.lit(" REPLICA IDENTITY "), identity).alias("statement"))


def create_statements(tables: DataFrame, operations: list[str]) -> DataFrame:
    """(pub_name, statement): what creates each publication with its tables, their column lists and the operations."""
    columns = F.when(F.size("column_list") > 0, F.concat(F.lit(" ("), F.concat_ws(", ", F.transform("column_list", _quoted)), F.lit(")"))).otherwise(F.lit(""))
    entry = F.concat(_quoted(F.col("table_schema")), F.lit("."), _quoted(F.col("table_name")), columns)
    options = [F.lit(f" WITH (publish = '{', '.join(o.lower() for o in operations)}'"), F.when(F.bool_or("is_partitioned"), F.lit(", publish_via_partition_root = true")).otherwise(F.lit("")), F.lit(")")]
    listed = F.array_join(F.array_sort(F.collect_list(entry)), ", ")
    return tables.groupBy("pub_name").agg(F.concat(F.lit("CREATE PUBLICATION "), _quoted(F.col("pub_name")), F.lit(" FOR TABLE "), listed, *options).alias("statement"))


def hypertable_roots(hypertables: DataFrame, chunks: DataFrame) -> DataFrame:
    """(child, root): qualified names of chunks and of the hypertables (id, schema_name, table_name) that they (hypertable_id, ...) belong to."""
    from tidelog.functions.naming import qualified

    roots = hypertables.select(F.col("id").alias("hypertable_id"), qualified(F.col("schema_name"), F.col("table_name")).alias("root"))
    return chunks.filter(~F.coalesce("dropped", F.lit(False))).select("hypertable_id", qualified(F.col("schema_name"), F.col("table_name")).alias("child")).join(roots, "hypertable_id").select("child", "root")
