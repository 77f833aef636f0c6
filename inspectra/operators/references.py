"""References to records that do not exist, from signed counts.

Every change is a delta: a record that appears adds 1 to the existence count of its key and one that is removed takes
1 away; a row that refers to a key adds 1 to its reference count (and takes it away when it is removed). A key
whose reference count is positive while its existence count is zero has orphan references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.functions.keys import plain_id
from inspectra.operators.skew import HOT_ROWS, salted_join

#: Bounds of time; a NULL arrival counts as the first, a NULL reference time as the last.
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def existence_deltas(keys: DataFrame, kind: str | Column, key: Column, arrived: Column, retired: Column | None = None) -> DataFrame:
    """``(key, at, delta)`` of a key table, one arrival per key and time and one removal where ``retired`` is known.

    The key is ``kind|plain id``. Blank keys are left out. Without ``retired`` only the earliest arrival of a key
    counts (repeated rows are one record). A NULL arrival counts as the beginning of time.
    """
    first, kind = F.to_timestamp(F.lit(FIRST)), F.lit(kind) if isinstance(kind, str) else kind
    base = keys.select(
        F.concat(kind, F.lit("|"), plain_id(key)).alias("key"), F.coalesce(arrived, first).alias("arrived"),
        (retired if retired is not None else F.lit(None).cast("timestamp")).alias("retired"),
    ).where("key IS NOT NULL")
    if retired is None:
        base = base.groupBy("key").agg(F.min("arrived").alias("arrived"), F.first("retired").alias("retired"))
    else:
        base = base.distinct()
    change = F.explode(F.array(
        F.struct(F.col("arrived").alias("at"), F.lit(1).alias("delta")),
        F.struct(F.col("retired").alias("at"), F.lit(-1).alias("delta")),
    ))
    return base.select("key", change.alias("c")).select("key", "c.at", "c.delta").where("at IS NOT NULL")


def existence_timeline(deltas: DataFrame) -> DataFrame:
    """``(key, since, until, existence, removed)``: the existence count of each key over disjoint spans of all time.

    Deltas of one key and time are added first, so a key has as many spans as times of change, plus one before
    the first. ``removed`` tells whether a removal happened before the end of the span.
    """
    at = deltas.groupBy("key", "at").agg(F.sum("delta").alias("delta"), F.max((F.col("delta") < 0).cast("int")).alias("gone"))
    first, last = F.to_timestamp(F.lit(FIRST)), F.to_timestamp(F.lit(LAST))
    w = Window.partitionBy("key").orderBy("at")
    spans = at.select(
        "key", F.col("at").alias("since"), F.coalesce(F.lead("at").over(w), last + F.expr("INTERVAL 1 DAY")).alias("until"),
        F.sum("delta").over(w).cast("long").alias("existence"), (F.max("gone").over(w) > 0).alias("removed"), F.row_number().over(w).alias("n"),
    )
    before = F.struct(first.alias("since"), F.col("since").alias("until"), F.lit(0).cast("long").alias("existence"), F.lit(False).alias("removed"))
    own = F.struct("since", "until", "existence", "removed")
    return spans.select("key", F.explode(F.when(F.col("n") == 1, F.array(before, own)).otherwise(F.array(own))).alias("s")).select("key", "s.*").where("until > since")


def references(child: DataFrame, table: str, column: str, child_no: str, kind: str, at: str) -> DataFrame:
    """``(child_table, ref_column, child_no, key, at)``; blank references are left out."""
    return child.select(
        F.lit(table).alias("child_table"), F.lit(column).alias("ref_column"), F.col(child_no).cast("long").alias("child_no"),
        F.concat(F.lit(f"{kind}|"), plain_id(F.col(column))).alias("key"), F.col(at).cast("timestamp").alias("at"),
    ).where("key IS NOT NULL")


def orphan_references(refs: DataFrame, deltas: DataFrame, *, rows: int = HOT_ROWS) -> DataFrame:
    """The references whose key had existence count zero at the time of the reference, with the period and the reason.

    ``absent``: the key never had a delta. ``deleted``: a removal came before or at that time. ``late``: the
    key came later. A reference without a time is judged by the last state and has a NULL period. Repeated
    reference rows stay repeated. Empty inputs give an empty result.

    One join on the key; spans of a key are disjoint, so a reference meets at most one. References of hot keys
    are split over tasks. Key and time are all that is moved of the key tables.
    """
    spans = existence_timeline(deltas).withColumnRenamed("key", "span_key")
    timed = refs.withColumn("ref_key", F.col("key")).withColumn("t", F.greatest(F.coalesce("at", F.to_timestamp(F.lit(LAST))), F.to_timestamp(F.lit(FIRST))))
    held = salted_join(
        timed, spans.withColumnRenamed("span_key", "ref_key"), "ref_key", spread_by=["child_table", "ref_column", "child_no"],
        on=(F.col("t") >= F.col("since")) & (F.col("t") < F.col("until")), how="left", rows=rows,
    )
    reason = F.when(F.col("existence").isNull(), "absent").when(F.col("removed"), "deleted").otherwise("late")
    return held.where("existence IS NULL OR existence <= 0").select(
        "child_table", "ref_column", F.date_format("at", "yyyy-MM").alias("period"), "child_no", reason.alias("reason"), "key",
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references and distinct orphan keys per table, column, period and reason."""
    return orphans.groupBy("child_table", "ref_column", "period", "reason").agg(
        F.count("*").alias("n_references"), F.count_distinct("key").alias("n_keys"))


# -- the maintained state ------------------------------------------------------------------------------------------


def count_state(existence: DataFrame, refs: DataFrame) -> DataFrame:
    """``(key, n_existence, n_references)`` from deltas: ``existence(key, delta)`` and ``refs(key[, delta])``."""
    ref_delta = F.col("delta") if "delta" in refs.columns else F.lit(1)
    both = existence.select("key", F.col("delta").cast("long").alias("e"), F.lit(0).cast("long").alias("r")).unionByName(
        refs.select("key", F.lit(0).cast("long").alias("e"), ref_delta.cast("long").alias("r")))
    return both.groupBy("key").agg(F.sum("e").alias("n_existence"), F.sum("r").alias("n_references"))


def apply_changes(state: DataFrame, existence: DataFrame, refs: DataFrame) -> DataFrame:
    """The state after a batch of changes: counts are sums, so a batch is added whatever its order; empty keys are let go."""
    merged = state.unionByName(count_state(existence, refs)).groupBy("key").agg(
        F.sum("n_existence").alias("n_existence"), F.sum("n_references").alias("n_references"))
    return merged.where("n_existence <> 0 OR n_references <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.where("n_references > 0 AND n_existence <= 0").select("key", "n_references")
