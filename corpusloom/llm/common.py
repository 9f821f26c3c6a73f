"""What the operators share: reading tables, stable row keys, and cutting lineage through shared storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import read_table
from ..sources.shared import mark, stash, sweep, unstash

__all__ = ["SPACES", "crc_mod", "mark", "read_table", "stash", "sweep", "text_or_empty", "unstash"]

#: White space of the word contracts: a space and the bytes 0x09 to 0x0D.
SPACES = "[\\x20\\x09-\\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
