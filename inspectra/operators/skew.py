"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this many rows gets more than one task.
HOT_ROWS = 200_000
#: So many keys are looked at; a key beyond them holds less than 1/1024 of all rows.
HOT_KEYS = 1024


def hot_keys(df: DataFrame, key: Column, *, rows: int = HOT_ROWS, keys: int = HOT_KEYS) -> dict[str, int]:
    """The heaviest keys with their row counts, at most ``keys`` of them (counted with map-side combine)."""
    counts = df.where(key.isNotNull()).groupBy(key.cast("string").alias("k")).agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= rows).orderBy(F.desc("n"), "k").limit(keys)
    return {r["k"]: r["n"] for r in top.collect()}


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def salted_join(
    big: DataFrame, small: DataFrame, key: str, *, spread_by: list[str], on: Column | None = None,
    how: str = "inner", rows: int = HOT_ROWS, hot: dict[str, int] | None = None,
) -> DataFrame:
    """``big`` join ``small`` on the column ``key`` of both (and ``on``, if given), hot keys of ``big`` split over several tasks.

    The rows of a hot key in ``big`` are dealt by the hash of ``spread_by`` (stable under retries) to
    ``ceil(n / rows)`` salts, and the rows of ``small`` with that key are repeated once a salt. ``how`` may be
    any kind that keeps rows of ``big`` only or matches (inner, left, left_semi, left_anti). Rows with a NULL
    key match nothing. Nothing is dropped, and without hot keys this is the plain join.
    """
    hot = hot_keys(big, F.col(key), rows=rows) if hot is None else hot
    if not hot:
        condition = big[key] == small[key]
        joined = big.join(small, condition if on is None else condition & on, how)
        return joined.drop(small[key]) if how in ("inner", "left") else joined
    salts = {k: -(-n // rows) for k, n in hot.items()}
    n_salts = F.coalesce(F.try_element_at(_literal_map(salts), F.col(key).cast("string")), F.lit(1))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), n_salts).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), (n_salts - 1).cast("int"))))
    condition = (left[key] == right[key]) & (left["_salt"] == right["_salt"])
    joined = left.join(right, condition if on is None else condition & on, how)
    if how in ("inner", "left"):
        return joined.drop(right[key]).drop(right["_salt"]).drop(left["_salt"])
    return joined.drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (counted, reading no more than that); else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files are too few to keep them busy; a larger input stays where it is read.

    At most ``defaultParallelism`` splits are moved, so what is shuffled stays small however large the data grow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
