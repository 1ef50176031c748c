"""Running values over very long ordered sequences, without putting one sequence into one task.

A log of one slot is one total order; a window over all of it would be a single
task. These operators cut the order into blocks of consecutive positions, reduce
each block to one row (map-side), run the window over those few rows, and finish
inside the blocks. Positions are whole numbers; ``block`` positions make a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog import storage

BLOCK = 1 << 20


def _by(part: list[str]) -> list[str]:
    return [*part, "__block"]


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def _carry(blocks: DataFrame, part: list[str], value: Callable[[Window], Column]) -> DataFrame:
    """The value over all earlier blocks. One row a block: for 10^12 positions a million rows."""
    w = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*_by(part), value(w).alias("__carry"))


def last_known(df: DataFrame, part: list[str], order: str, values: dict[str, Column], *, strictly_before: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, for each named value, the last non-null one at an earlier position (or also the row's own)."""
    tmp = {f"__v_{n}": c for n, c in values.items()}
    rows = _blocked(df.withColumns(tmp), order, block)
    # every block that has rows needs its carry, also those that hold no value
    blocks = rows.groupBy(*_by(part)).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in tmp))
    before = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*_by(part), *(F.last(v, ignorenulls=True).over(before).alias(f"{v}_carry") for v in tmp))
    w = Window.partitionBy(*_by(part)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0)
    own = rows.withColumns({f"{v}_own": F.last(v, ignorenulls=True).over(w) for v in tmp})
    same = [own[c].eqNullSafe(carry[c]) for c in _by(part)]
    joined = own.join(carry, same, "left").select(*(own[c] for c in own.columns), *(carry[f"{v}_carry"] for v in tmp))
    return joined.withColumns({n: F.coalesce(f"__v_{n}_own", f"__v_{n}_carry") for n in values}).drop(*tmp, *(f"{v}_own" for v in tmp), *(f"{v}_carry" for v in tmp), "__block")


def running_max(df: DataFrame, part: list[str], order: str, value: Column, out: str, *, block: int = BLOCK) -> DataFrame:
    """Adds the greatest ``value`` up to and with the row."""
    rows = _blocked(df.withColumn("__v", value), order, block)
    blocks = rows.groupBy(*_by(part)).agg(F.max("__v").alias("__end"))
    carry = _carry(blocks, part, lambda w: F.max("__end").over(w))
    w = Window.partitionBy(*_by(part)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__own", F.max("__v").over(w))
    same = [own[c].eqNullSafe(carry[c]) for c in _by(part)]
    joined = own.join(carry, same, "left").select(*(own[c] for c in own.columns), carry["__carry"])
    return joined.withColumn(out, F.greatest("__own", "__carry")).drop("__v", "__own", "__carry", "__block")


def row_numbers(df: DataFrame, part: list[str], order: str, ties: list[str], out: str, *, block: int = BLOCK) -> DataFrame:
    """Adds 1, 2, 3, ... in order of (``order``, ``ties``)."""
    rows = _blocked(df, order, block)
    blocks = rows.groupBy(*_by(part)).agg(F.count(F.lit(1)).alias("__end"))
    carry = _carry(blocks, part, lambda w: F.sum("__end").over(w))
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*_by(part)).orderBy(order, *ties)))
    same = [own[c].eqNullSafe(carry[c]) for c in _by(part)]
    joined = own.join(carry, same, "left").select(*(own[c] for c in own.columns), carry["__carry"])
    return joined.withColumn(out, F.col("__own") + F.coalesce("__carry", F.lit(0))).drop("__own", "__carry", "__block")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds 0, 1, 2, ... in any order of columns: rows are sorted in ranges, and each range begins where those before it end."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__own": inside})
    rows = storage.materialize(rows, "numbered")  # ranges are cut by samples, so they are cut once
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a range
    return rows.join(before, "__part").withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


# --- sequences of any order columns, cut into ranges ---------------------------


def ranged(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """The rows cut into ranges of (``part``, ``order``), as a table with the number of each row's range (``__part``).

    However many rows a sequence has, no range holds more than its share of all rows.
    """
    rows = df.repartitionByRange(*part, *order).withColumn("__part", F.spark_partition_id())
    return storage.materialize(rows, "ranged")  # ranges are cut by samples, so they are cut once


def _with_carry(own: DataFrame, carry: DataFrame, part: list[str]) -> DataFrame:
    same = [own[c].eqNullSafe(carry[c]) for c in ("__part", *part)]
    return own.join(carry, same, "left").select(*(own[c] for c in own.columns), carry["__carry"])


def previous(rows: DataFrame, part: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """Adds to ``ranged`` rows the column's value in the row before, null for a sequence's first."""
    w = Window.partitionBy("__part", *part).orderBy(*order)
    own = rows.withColumns({"__own": F.lag(column).over(w), "__first": F.row_number().over(w) == 1})
    ends = rows.groupBy("__part", *part).agg(F.max_by(F.struct(column), F.struct(*order))[column].alias("__end"))  # one row a range and sequence
    carry = ends.select("__part", *part, F.lag("__end").over(Window.partitionBy(*part).orderBy("__part")).alias("__carry"))
    return _with_carry(own, carry, part).withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__own"))).drop("__own", "__first", "__carry")


def latest(rows: DataFrame, part: list[str], order: list[str], when: Column, out: str) -> DataFrame:
    """Adds to ``ranged`` rows the ``order`` columns (a struct) of the last row up to and with this one for which ``when`` holds."""
    marked = rows.withColumn("__at", F.when(when, F.struct(*order)))
    own = marked.withColumn("__own", F.max("__at").over(Window.partitionBy("__part", *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("__part", *part).agg(F.max("__at").alias("__end"))
    carry = ends.select("__part", *part, F.max("__end").over(Window.partitionBy(*part).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    return _with_carry(own, carry, part).withColumn(out, F.coalesce("__own", "__carry")).drop("__own", "__at", "__carry")
