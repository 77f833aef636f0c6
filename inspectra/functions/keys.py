"""Record keys: one plain spelling for ids that sources write unevenly, and deterministic digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\x{FEFF}\x{200B}]+"


def plain_id(c: Column) -> Column:
    """Lower case, without blanks, without leading zeros of a trailing number; NULL if nothing is left.

    ``' NYC:0040000123'`` and ``nyc:40000123`` are one id. Hexadecimal digests keep their zeros.
    """
    squeezed = F.lower(F.regexp_replace(c, BLANKS, ""))
    return F.nullif(F.regexp_replace(squeezed, r"(^|:)0+(?=[0-9]+$)", "$1"), F.lit(""))


def digest(prefix: str, *parts: Column, length: int = 32) -> Column:
    """``prefix`` and the first hex digits of sha256 over the parts, joined by the unit separator; NULL parts count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))
