"""The surviving value of each field of a group of duplicate records, by one maximum over composite structs.

Each field of each record becomes ``(usable, priority ..., record)``, ordered so that the maximum is the survivor. The
maximum is taken per value first and per group last; both aggregate before they shuffle, so a group with a third of
all rows costs no more than its distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for "unknown", lower case, without outer blanks; texts without any letter or digit count as well.
UNKNOWN = [
    "n/a", "n.a.", "n.a", "na", "none", "null", "nil", "nan", "unknown", "unk", "not known", "not available", "not provided", "not given",
    "not stated", "not reported", "not applicable", "no name", "no address", "missing", "tbd", "tba", "to be updated", "to be determined",
    "to be confirmed", "to be announced", "see file", "see note", "see notes", "pending", "undefined", "unspecified", "unnamed", "untitled",
    "x", "xx", "xxx", "xxxx", "test",
]

_OUTER = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
#: The replacement character, and UTF-8 bytes that were read as Windows-1252 or Latin-1.
BROKEN = (
    "�|[ÂÃ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    "|â[€‚„\u0080-¿†-•][\u0080-¿€‘-„†-…œšž˜™]"
)
#: Values are compared with longer ones inside blocks of this many first characters; shorter values by their whole text.
BLOCK = 8


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def usable_text(c: Column, unknown: list[str] | None = None) -> Column:
    """Not blank, not a word for unknown, not broken by wrong decoding. NULL is not usable."""
    t = F.lower(trimmed(c))
    return F.coalesce(t.rlike(r"[\p{L}\p{N}]") & ~t.isin(UNKNOWN if unknown is None else unknown) & ~c.rlike(BROKEN), F.lit(False))


@dataclass(frozen=True)
class Field:
    """A field with its kind: ``text`` values rank by trust, snapshot and length, ``date`` values by the date and trust."""

    name: str
    kind: str = "text"


def _values(records: DataFrame, key: str, record: str, fields: list[Field], trust: str, snapshot: str, earliest: str) -> DataFrame:
    """One row per record and field: key, field, value, usable, and the priorities in the order of the field's kind."""
    none, low = F.lit(None).cast("string"), F.lit(-(2**62)).cast("long")
    trust_rank = F.coalesce(F.col(trust).cast("long"), low)
    taken = F.coalesce(F.unix_date(F.col(snapshot).cast("date")).cast("long"), low)
    entries = []
    for f in fields:
        c = F.col(f.name)
        if f.kind == "date":
            day = c.cast("date")
            usable = F.coalesce((day >= F.lit(earliest).cast("date")) & (day <= F.col(snapshot).cast("date")), F.lit(False))
            value, ranks = F.date_format(day, "yyyy-MM-dd"), (F.coalesce(F.unix_date(day).cast("long"), low), trust_rank, F.lit(0).cast("long"))
        else:
            value, usable = trimmed(c.cast("string")), usable_text(c.cast("string"))
            ranks = (trust_rank, taken, F.length(value).cast("long"))
        entries.append(F.struct(
            F.lit(f.name).alias("field_name"), F.lit(f.kind).alias("kind"), F.when(usable, value).otherwise(none).alias("value"), usable.alias("usable"),
            F.coalesce(ranks[0], low).alias("r1"), F.coalesce(ranks[1], low).alias("r2"), F.coalesce(ranks[2], low).alias("r3"), (-F.col(record).cast("long")).alias("r4")))
    return records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*entries)).alias("e")).select("key", "e.*")


def surviving_values(
    records: DataFrame, *, key: str, record: str, fields: list[Field], trust: str, snapshot: str, earliest: str = "1990-01-01",
) -> DataFrame:
    """``(key, field_name, record, value)``: for each group of two or more records and each field, the value that survives.

    A text is usable unless it is blank, a word for unknown, broken by wrong decoding, or the start (without case and
    outer blanks) of a longer usable text of the group; the highest ``trust`` wins, then the latest ``snapshot``, the
    longest text, the smallest ``record``. A date is usable from ``earliest`` on and up to its own snapshot; the
    latest wins, then trust, then the smallest record. Missing trust or snapshot ranks last, and a date without a snapshot
    is not usable. A field with no usable value has no row, nor has a record without a key; ``record`` is unique.

    Starts of longer texts are found on distinct values: values of at least ``BLOCK`` characters are sorted within
    their group and first characters, where a text that starts another is followed at once by one that it starts;
    shorter ones are looked up among the short starts of the longer ones.
    """
    each = _values(records, key, record, fields, trust, snapshot, earliest)
    norm = F.when(F.col("usable") & (F.col("kind") == "text"), F.lower("value"))
    rank = F.struct("usable", "r1", "r2", "r3", "r4", "value")
    values = each.groupBy("key", "field_name", norm.alias("norm")).agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    texts = values.where("norm IS NOT NULL")
    long = F.length("norm") >= BLOCK
    w = Window.partitionBy("key", "field_name", F.substring("norm", 1, BLOCK)).orderBy("norm")
    cut_long = texts.where(long).withColumn("cut", F.coalesce(F.startswith(F.lead("norm").over(w), F.col("norm")), F.lit(False)))
    starts = texts.select("key", "field_name", F.explode(F.transform(F.sequence(F.lit(1), F.lit(BLOCK - 1)), lambda k: F.when(F.length("norm") > k, F.substring("norm", F.lit(1), k)))).alias("norm")).where("norm IS NOT NULL").distinct()
    cut_short = texts.where(~long).join(starts.withColumn("_start", F.lit(True)), ["key", "field_name", "norm"], "left").withColumn("cut", F.col("_start").isNotNull()).drop("_start")
    marked = cut_long.unionByName(cut_short).unionByName(values.where("norm IS NULL").withColumn("cut", ~F.col("best.usable")))
    best = marked.groupBy("key", "field_name").agg(F.sum("n").alias("n"), F.max(F.when(~F.col("cut"), F.col("best"))).alias("best"))
    return best.where("n >= 2 AND best IS NOT NULL").select("key", "field_name", (-F.col("best.r4")).alias("record"), F.col("best.value").alias("value"))


def golden_records(survivors: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per group: the surviving value of each field (NULL where none is usable) and the record it came from."""
    pick = lambda f, c: F.max(F.when(F.col("field_name") == f.name, F.col(c)))
    return survivors.groupBy("key").agg(*[x for f in fields for x in (pick(f, "value").alias(f.name), pick(f, "record").alias(f"{f.name}_record"))])
