"""Log positions: 64-bit numbers, written as two hexadecimal halves with a slash between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORM = r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def parse_lsn(text: Column) -> Column:
    """The position as a long; null for null; an error for other forms and for positions of 2^63 or more."""
    half = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast("long")
    number = F.shiftleft(half(0), 32) + half(1)
    bad = F.raise_error(F.concat(F.lit("not a log position: "), text))
    return F.when(text.isNull(), None).when(~text.rlike(TEXT_FORM) | (half(0) >= 1 << 31), bad).otherwise(number)


def format_lsn(number: Column) -> Column:
    return F.concat_ws("/", F.hex(F.shiftright(number, 32)), F.hex(number.bitwiseAND(F.lit(0xFFFFFFFF))))
