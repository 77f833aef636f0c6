"""Lenient parsing of raw text: what cannot be read becomes NULL, never zero and never an error (ANSI mode is on)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OUTER = r"(?U)^\s+|\s+$"


def clean(c: Column) -> Column:
    """Text without outer white space of any kind; NULL if empty."""
    return F.nullif(F.regexp_replace(c.cast("string"), _OUTER, ""), F.lit(""))


def lenient_double(c: Column) -> Column:
    """A number, or NULL; texts such as ``nan`` are no numbers."""
    d = clean(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def _iso(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def iso_or_slash_date(c: Column) -> Column:
    """A date from the first ten characters as ISO, else from the whole as month/day/year."""
    t = clean(c)
    return F.coalesce(_iso(F.substring(t, 1, 10)), F.try_to_date(t, "M/d/yyyy"))


def slash_or_iso_date(c: Column) -> Column:
    """A date from the whole text, month/day/year before ISO."""
    t = clean(c)
    return F.coalesce(F.try_to_date(t, "M/d/yyyy"), F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _iso(t)))


def first_date(c: Column, formats: list[str]) -> Column:
    """A date in the first format that fits."""
    t = clean(c)
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


def count_value(c: Column) -> Column:
    """A whole number of zero or more; NULL otherwise."""
    n = clean(c).try_cast("int")
    return F.when(n >= 0, n)


def count_malformed(c: Column) -> Column:
    """Whether a text is given that is no whole number of zero or more."""
    return clean(c).isNotNull() & count_value(c).isNull()


def plain_number(c: Column) -> Column:
    """A number of zero or more from text that may end in punctuation."""
    d = F.regexp_replace(clean(c), r"^[.,\s]+|[.,\s]+$", "").try_cast("double")
    return F.when(~F.isnan(d) & (d >= 0), d)


def capped_text(c: Column, length: int) -> Column:
    return F.substring(clean(c), 1, length)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, in its order and types; missing ones are NULL and others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def reject_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that applies, NULL if none; a rule that is NULL does not apply."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    return df


def canonical_headers(headers: list[str], known: dict[str, str]) -> list[str]:
    """Canonical names of headers: exact, then upper case, then lower case with underscores; unknown ones keep their name.

    Two headers with one canonical name are an error that names both.
    """
    out: list[str] = []
    targets = set(known.values())
    for h in headers:
        t = h.replace("﻿", "").strip()
        lower = "_".join(t.lower().split())
        name = known.get(t) or known.get(t.upper()) or (lower if lower in targets else t)
        if name in out:
            raise ValueError(f"headers {headers[out.index(name)]!r} and {h!r} both mean {name!r}")
        out.append(name)
    return out
