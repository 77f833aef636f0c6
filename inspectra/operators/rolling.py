"""Totals over trailing periods for every entity and calendar day, idle days included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of one key the one with the largest ``order`` (NULL is smallest); rows without a key stand alone.

    A single aggregation with map-side combine, so a key with very many versions is reduced before the shuffle.
    """
    row = F.struct(*order, *[c for c in columns if c not in order])
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return keyed.unionByName(df.where(F.col(key).isNull()).select(key, *columns))


def daily_totals(events: DataFrame, entity: str, day: str, sums: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """One row per entity and day: sums (NULL adds nothing), and sum and count of the non-null values of each mean."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
    for n, c in means.items():
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{n}_sum"), F.count(c).alias(f"{n}_n")]
    return events.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.count("*").alias("events"), *aggs)


def trailing_totals(daily: DataFrame, periods: list[int], *, measures: list[str], idle_days: bool = True) -> DataFrame:
    """``(entity, day, <measure>_<period>d ...)`` for each calendar day from an entity's first to its last day.

    Method: a range join of each entity's calendar with its daily totals, restricted by coarse date buckets as
    wide as the longest period. A daily total falls into its own bucket and the next one, so calendar and totals
    meet on ``(entity, bucket)`` alone; within a bucket each calendar day takes the totals of its trailing bounds,
    and one aggregation by ``(entity, bucket, day)``, for which the join's partitioning serves, adds them up. The
    calendar crosses the shuffle as one row a bucket, not one a day.

    ``idle_days=False`` leaves out days with no total in the longest period. Entities are cut by bucket, and
    totals are per day, so an entity with any number of events holds at most ``2 * longest`` totals a bucket.
    NULL entities or days take no part; an empty input gives an empty result.
    """
    longest = max(periods)
    d = daily.where(F.col("entity").isNotNull() & F.col("day").isNotNull()).withColumn("_x", F.unix_date("day"))
    bucket = F.floor(F.col("_x") / F.lit(longest)).cast("int")
    spans = d.groupBy("entity").agg(F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    calendar = spans.select(
        F.col("entity").alias("_entity"), "_first", "_last",
        F.explode(F.sequence(F.floor(F.col("_first") / longest).cast("int"), F.floor(F.col("_last") / longest).cast("int"))).alias("_b"),
    ).select(
        "_entity", "_b", F.greatest(F.col("_first"), F.col("_b") * longest).alias("_lo"), F.least(F.col("_last"), F.col("_b") * longest + (longest - 1)).alias("_hi"))
    totals = d.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).select("entity", "_bucket", "_x", *measures)
    met = calendar.join(totals, (F.col("_entity") == F.col("entity")) & (F.col("_b") == F.col("_bucket")), "left" if idle_days else "inner")
    if idle_days:
        days = F.sequence("_lo", "_hi")
    else:
        lo, hi = F.greatest("_lo", "_x"), F.least(F.col("_hi"), F.col("_x") + (longest - 1))
        days = F.when(lo <= hi, F.sequence(lo, hi))
    each = met.withColumn("_day", F.explode(days))
    age = F.col("_day") - F.col("_x")
    within = lambda p, m: F.coalesce(F.sum(F.when((age >= 0) & (age < p), F.col(m))), F.lit(0)).alias(f"{m}_{p}d")
    out = each.groupBy("_entity", "_b", "_day").agg(*[within(p, m) for p in periods for m in measures])
    return out.select(F.col("_entity").alias("entity"), F.date_from_unix_date("_day").alias("day"), *[f"{m}_{p}d" for p in periods for m in measures])
