"""Tables and lookups for serving: latest rows, search pages, histories, awards and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 50


def latest_rows(events: DataFrame, entity: str, day: str) -> DataFrame:
    """All rows of each entity's latest day, ties kept."""
    w = Window.partitionBy(entity).orderBy(F.desc(day))
    return events.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def latest_row(events: DataFrame, entity: str, day: str, tie: Column) -> DataFrame:
    """One row an entity: the latest day, then the tie order."""
    w = Window.partitionBy(entity).orderBy(F.desc(day), tie)
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_with_ties(events: DataFrame, entity: str, day: str, key: str) -> DataFrame:
    """The latest row (day, then key, both descending) with the number of rows of that day."""
    w = Window.partitionBy(entity)
    return events.withColumn("same_day", F.count("*").over(Window.partitionBy(entity, day))).withColumn("_r", F.row_number().over(w.orderBy(F.desc(day), F.desc(key)))).where("_r = 1").drop("_r")


def field_conflicts(rows: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """``(entity, field, values)`` where the rows of an entity hold several distinct values of a field."""
    long = rows.select(entity, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([entity], fields, "field", "value")
    return long.where("value IS NOT NULL").groupBy(entity, "field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def check_page(limit: int, offset: int, largest: int = MAX_PAGE) -> None:
    if not 1 <= limit <= largest or offset < 0:
        raise ValueError(f"limit must be in [1, {largest}] and offset at least 0")


def check_restaurant_id(value: str) -> str:
    head, _, rest = value.partition(":")
    if head not in ("nyc", "florida") or not rest:
        raise ValueError(f"no restaurant id: {value!r}")
    return value


def search_page(restaurants: DataFrame, *, name: str, key: str, query: str = "", limit: int = 20, offset: int = 0, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(page, total)``: restaurants whose name contains the query (no wildcards), by name and key."""
    check_page(limit, offset)
    found = restaurants if where is None else restaurants.where(where)
    if query:
        found = found.where(F.contains(F.col(name), F.lit(query)))
    return found.orderBy(name, key).offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def award_filter(matches: DataFrame, events: DataFrame, *, category: str | None = None, year: int | None = None, latest_only: bool = False) -> DataFrame:
    """Restaurants with an accepted match whose award has an edition that fits; ``latest_only`` looks at its latest year alone."""
    e = events
    if latest_only:
        e = latest_rows(events, "award_id", "guide_year")
    if category is not None:
        e = e.where(F.col("distinction") == category)
    if year is not None:
        e = e.where(F.col("guide_year") == year)
    return matches.where("decision = 'accept'").join(e, "award_id", "left_semi").select("restaurant_id").distinct()


def award_history(matches: DataFrame, events: DataFrame) -> DataFrame:
    return matches.where("decision = 'accept'").join(events, "award_id").select("restaurant_id", "award_id", "guide_year", "distinction")


def latest_distinctions(events: DataFrame) -> DataFrame:
    """The distinctions of each award's latest year, in order."""
    return latest_rows(events, "award_id", "guide_year").groupBy("award_id").agg(F.max("guide_year").alias("guide_year"), F.array_sort(F.collect_set("distinction")).alias("distinctions"))


def latest_prediction(predictions: DataFrame, *, as_of: str, generated: str, key: str, entity: str, where: Column | None = None) -> DataFrame:
    p = predictions if where is None else predictions.where(where)
    w = Window.partitionBy(entity).orderBy(F.desc(as_of), F.desc(generated), F.desc(key))
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prediction_status(latest: DataFrame, today: Column, *, days: int = 90, registry_version: str | None, artifact_version: str | None) -> DataFrame:
    """Adds ``status``: no model, stale model, stale by age, insufficient history, or available."""
    if artifact_version is None:
        return latest.withColumn("status", F.lit("no_ready_model"))
    if registry_version != artifact_version:
        return latest.withColumn("status", F.lit("stale"))
    old = F.datediff(today, "as_of_date") > days
    return latest.withColumn("status", F.when(old, "stale").when(F.col("risk_band") == "insufficient_history", "insufficient_history").otherwise("available"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with all rows of the given keys replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def health(restaurants: DataFrame, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per jurisdiction, and for each table whether it is registered, as ``(item, ok, rows)``."""
    spark = restaurants.sparkSession
    rows = restaurants.groupBy(F.concat(F.lit("jurisdiction:"), "jurisdiction").alias("item")).agg((F.count("*") > 0).alias("ok"), F.count("*").alias("rows"))
    return rows.unionByName(spark.createDataFrame([(f"table:{k}", v is not None, None) for k, v in tables.items()], "item string, ok boolean, rows long"))


def shown_severity(jurisdiction: Column, code: Column, severity: Column) -> Column:
    """Category counts of Florida carry no class of their own."""
    return F.when((jurisdiction == "florida") & code.rlike(r"^\d{2}$") & (severity == "other"), "classification_unavailable_at_category_level").otherwise(severity)
