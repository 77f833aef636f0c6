"""Conservative resolution of disagreeing rows: nothing is settled silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_present(value: Column, order: Column, valid: Column | None = None) -> Column:
    """An aggregate: the value of the row with the smallest ``order`` among those that have one."""
    ok = value.isNotNull() if valid is None else valid
    return F.min_by(value, F.when(F.coalesce(ok, F.lit(False)), order))


def resolve_conflicts(rows: DataFrame, keys: list[str], fields: dict[str, Column], recency: str) -> DataFrame:
    """For each group and field ``<f>``, ``<f>_conflict`` and ``<f>_conflict_values``.

    No value: NULL without conflict. One distinct value: that one. Several: the one that is alone at the latest
    recency among rows with a value, else NULL; either way a conflict with all values in order. Values are first
    reduced to ``(group, field value, latest recency)`` with map-side combine, so repeated rows cost nothing.
    """
    out = None
    for name, c in fields.items():
        per = rows.select(*keys, c.alias("v"), F.col(recency).alias("_t")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.max("_t").alias("_t"))
        g = per.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"), F.max("_t").alias("latest"), F.collect_list(F.struct("v", "_t")).alias("pairs"))
        last = F.filter("pairs", lambda p: p["_t"] == F.col("latest"))
        value = F.when(F.size("vs") == 1, F.col("vs")[0]).when(F.size(last) == 1, last[0]["v"])
        g = g.select(*keys, value.alias(name), (F.size("vs") > 1).alias(f"{name}_conflict"), F.when(F.size("vs") > 1, F.col("vs")).alias(f"{name}_conflict_values"))
        out = g if out is None else out.join(g, keys, "full")
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first in a stated order; NULL keys form groups of their own value."""
    w = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_signatures(df: DataFrame, key: str, material: list[Column], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(survivors, conflicts)``: groups with one signature keep their first row, others are dropped and reported."""
    signed = df.withColumn("_sig", F.xxhash64(*[F.coalesce(m.cast("string"), F.lit("\x00")) for m in material]))
    per = signed.groupBy(key).agg(F.count("*").alias("rows"), F.min("_sig").alias("_a"), F.max("_sig").alias("_b"))
    conflicts = per.where("_a <> _b").select(key, "rows")
    kept = signed.drop("_sig").join(per.where("_a = _b").select(key, "rows"), key)
    return keep_first(kept, [key], [F.col(c).asc_nulls_first() for c in order]), conflicts


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, an empty table where the invariant holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
