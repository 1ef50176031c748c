"""Log positions: 64-bit unsigned numbers with a text form of two hexadecimal halves."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

LSN_TYPE = "decimal(20,0)"
_TEXT = re.compile(r"^\s*([0-9A-Fa-f]{1,16})/([0-9A-Fa-f]{1,16})\s*$")
_TEXT_SQL = r"^\s*0*[0-9A-Fa-f]{1,8}/0*[0-9A-Fa-f]{1,8}\s*$"


def format_lsn(value: int) -> str:
    """Unpadded upper-case halves, as in ``16/B374D848``."""
    if not 0 <= value < 1 << 64:
        raise ValueError(f"not a log position: {value}")
    return f"{value >> 32:X}/{value & 0xFFFFFFFF:X}"


def parse_lsn(text: str) -> int:
    m = _TEXT.match(text)
    if not m or (hi := int(m[1], 16)) >> 32 or (lo := int(m[2], 16)) >> 32:
        raise ValueError(f"not a log position: {text!r}")
    return (hi << 32) + lo


def lsn_parse(c: Column | str) -> Column:
    """Text to decimal(20,0). Blanks around, leading zeros and lower case are read; anything else is null."""
    c = F.col(c) if isinstance(c, str) else c
    ok = c.rlike(_TEXT_SQL)
    half = lambda i: F.conv(F.trim(F.split(c, "/")[i]), 16, 10).cast(LSN_TYPE)
    return F.when(ok, (half(0) * F.lit(4294967296).cast("decimal(10,0)") + half(1)).cast(LSN_TYPE))


def lsn_format(c: Column | str) -> Column:
    """Number to text, for the whole unsigned range."""
    c = (F.col(c) if isinstance(c, str) else c).cast(LSN_TYPE)
    unit = F.lit(4294967296).cast(LSN_TYPE)
    low = F.pmod(c, unit)
    high = ((c - low) / unit).cast(LSN_TYPE)
    return F.concat(F.conv(high.cast("string"), 10, 16), F.lit("/"), F.conv(low.cast("string"), 10, 16))


def lsn_lag(ahead: Column | str, behind: Column | str) -> Column:
    """Bytes between two positions; 0 where the second is ahead."""
    a = F.col(ahead) if isinstance(ahead, str) else ahead
    b = F.col(behind) if isinstance(behind, str) else behind
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(0)))
