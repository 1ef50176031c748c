"""Hashes of whole rows as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _parts(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns to feed to a hash so that nulls, empty values and neighbours can't be mistaken for each other."""
    out: list[Column] = []
    for n in names:
        c, kind = df[f"`{n}`"], df.schema[n].dataType
        if isinstance(kind, T.MapType):
            entries = F.sort_array(F.map_entries(c))
            c = F.transform(entries, lambda e: F.struct(e["key"], e["value"].isNull(), e["value"]))
        out += [c.isNull(), c]
    return out


def hash64(df: DataFrame, names: list[str], salt: int = 0) -> Column:
    """64-bit hash of the named columns; maps count as sets of entries, null differs from empty."""
    return F.xxhash64(F.lit(salt), *_parts(df, names))


def hash128(df: DataFrame, names: list[str]) -> list[Column]:
    """Two independent 64-bit hashes, ``k1`` and ``k2``: an identifier that is safe from chance collisions."""
    return [hash64(df, names, 1).alias("k1"), hash64(df, names, 2).alias("k2")]
