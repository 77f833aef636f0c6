"""History features that only see strictly earlier days, and the same state as of a day.

Events are collapsed to days first, so events of one day never see each other; a window over the days of a restaurant
then carries counts, sums and products as whole numbers of hundredths, from which mean, variance and trend follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values are scaled by this before they are summed, so that sums are exact whatever their order.
SCALE = 100


def collapse_days(events: DataFrame, entity: str, day: str, *, additive: dict[str, Column], single: dict[str, Column]) -> DataFrame:
    """One row per entity and day: ``events``, each measure, and how many days were incomplete or in conflict.

    An additive measure is the sum if every event has a value, else NULL. A single measure is the common value (to nine
    places) if every event has one and they agree, else NULL; ``<m>_incomplete`` and ``<m>_disagree`` tell why.
    """
    aggs = [F.count("*").alias("events")]
    for n, c in additive.items():
        aggs += [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(n), (F.count(c) < F.count("*")).alias(f"{n}_incomplete")]
    for n, c in single.items():
        same = F.min(F.round(c, 9)) == F.max(F.round(c, 9))
        full = F.count(c) == F.count("*")
        aggs += [F.when(full & same, F.min(c)).alias(n), (~full).alias(f"{n}_incomplete"), F.coalesce(full & ~same, F.lit(False)).alias(f"{n}_disagree")]
    return events.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(*aggs)


def _scaled(c: Column) -> Column:
    return F.round(c * SCALE).cast("long")


def _moments(value: Column, day: Column, over) -> dict[str, Column]:
    """Exact sums over a frame or group: n, v, v squared, x, x squared, x v; ``over`` turns an aggregate into a column."""
    v, x = _scaled(value), F.when(value.isNotNull(), F.unix_date(day).cast("long"))
    return {"n": over(F.count(v)), "v": over(F.sum(v)), "vv": over(F.sum(v * v)), "x": over(F.sum(x)), "xx": over(F.sum(x * x)), "xv": over(F.sum(x * v)), "max": over(F.max(value))}


def _features(name: str, m: dict[str, Column]) -> list[Column]:
    n = m["n"]
    spread = (n * m["vv"] - m["v"] * m["v"]).cast("double")
    across = (n * m["xx"] - m["x"] * m["x"]).cast("double")
    return [
        n.alias(f"{name}_days"), F.when(n > 0, m["v"] / F.lit(float(SCALE))).alias(f"{name}_sum"), F.when(n > 0, m["v"].cast("double") / n / SCALE).alias(f"{name}_mean"), m["max"].alias(f"{name}_max"),
        F.when(n >= 2, F.greatest(F.lit(0.0), spread / (n * (n - 1)) / (SCALE * SCALE))).alias(f"{name}_variance"),
        F.when((n >= 3) & (across > 0), (n * m["xv"] - m["x"] * m["v"]).cast("double") / across / SCALE * 365.0).alias(f"{name}_trend"),
    ]


def history_features(days: DataFrame, measures: list[str], counters: list[str] | None = None) -> DataFrame:
    """For every entity and day the state before that day.

    ``history_depth`` (events), ``prior_days``, ``days_since_previous``, ``missing_history``; per measure the number of
    complete days, sum, mean, maximum, sample variance (two days), yearly trend (three days on different dates),
    the value of the day before and whether it was complete; per counter the running total (NULL without history).
    """
    w = Window.partitionBy("entity").orderBy("day")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("events").over(before), F.lit(0))
    out = ["entity", "day", depth.alias("history_depth"), F.count("*").over(before).alias("prior_days"), F.datediff("day", F.lag("day").over(w)).alias("days_since_previous"), (depth == 0).alias("missing_history")]
    staged = days
    for m in measures:
        sums = _moments(F.col(m), F.col("day"), lambda a: a.over(before))
        staged = staged.withColumns({f"_{m}_{k}": c for k, c in sums.items()})
        out += _features(m, {k: F.col(f"_{m}_{k}") for k in sums})
        out += [F.lag(m).over(w).alias(f"{m}_previous"), F.coalesce(F.lag(F.col(m).isNotNull()).over(w), F.lit(False)).alias(f"{m}_previous_complete")]
    for c in counters or []:
        out.append(F.when(depth > 0, F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"prior_{c}"))
    return staged.select(*out)


def state_as_of(days: DataFrame, entities: DataFrame, measures: list[str], as_of: str, counters: list[str] | None = None) -> DataFrame:
    """The same features before ``as_of`` (exclusive) for every entity, those without history included."""
    cut = F.lit(as_of).cast("date")
    past = days.where(F.col("day") < cut)
    aggs = [F.sum("events").alias("_events"), F.count("*").alias("_days"), F.max("day").alias("last_day")]
    for m in measures:
        aggs += [c.alias(f"_{m}_{k}") for k, c in _moments(F.col(m), F.col("day"), lambda a: a).items()]
        aggs += [F.max_by(F.struct(F.col(m).alias("v")), "day").alias(f"_{m}_last")]
    aggs += [F.sum(c).alias(f"_c_{c}") for c in counters or []]
    s = entities.select("entity").distinct().join(past.groupBy("entity").agg(*aggs), "entity", "left")
    depth = F.coalesce("_events", F.lit(0))
    out = ["entity", depth.alias("history_depth"), F.coalesce("_days", F.lit(0)).alias("prior_days"), F.datediff(cut, "last_day").alias("days_since_previous"), (depth == 0).alias("missing_history")]
    for m in measures:
        sums = {k: F.col(f"_{m}_{k}") for k in ("n", "v", "vv", "x", "xx", "xv", "max")} | {"n": F.coalesce(f"_{m}_n", F.lit(0))}
        out += _features(m, sums)
        out += [F.col(f"_{m}_last.v").alias(f"{m}_previous"), F.coalesce(F.col(f"_{m}_last.v").isNotNull(), F.lit(False)).alias(f"{m}_previous_complete")]
    out += [F.when(depth > 0, F.coalesce(f"_c_{c}", F.lit(0))).alias(f"prior_{c}") for c in counters or []]
    return s.select(*out)


def code_history(days: DataFrame, violations: DataFrame, *, entity: str, day: str, inspection: str, code: str, count: str) -> DataFrame:
    """Per entity and day: earlier citations, inspections with any, distinct codes, and the leading code with its counts.

    Violations count only on days that have an event. The leading code has most citations, then most inspections, then
    comes first in order. Per code and day totals are first reduced; running totals per code are then carried to
    each day by a join on the entity with strictly earlier dates, which meets one row per code and day only.
    """
    v = violations.where(F.col(code).isNotNull() & (F.col(code) != "") & F.col(inspection).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(day).alias("vday"), F.col(code).alias("code"), F.col(inspection).alias("inspection"), F.coalesce(F.col(count).cast("long"), F.lit(0)).alias("n"))
    real = days.select("entity", "day").distinct()
    v = v.join(real, (v["entity"] == real["entity"]) & (v["vday"] == real["day"]), "left_semi")
    seen = v.groupBy("entity", "code", "inspection").agg(F.min("vday").alias("vday"))  # an inspection counts once a code, from its first day
    per = v.groupBy("entity", "code", "vday").agg(F.sum("n").alias("n")).join(
        seen.groupBy("entity", "code", "vday").agg(F.count("*").alias("inspections")), ["entity", "code", "vday"], "left")
    by_code = real.join(per, "entity").where(F.col("vday") < F.col("day")).groupBy("entity", "day", "code").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("inspections"), F.lit(0)).alias("inspections"))
    lead = F.min_by(F.struct("code", "n", "inspections"), F.struct(-F.col("n"), -F.col("inspections"), F.col("code")))
    totals = by_code.groupBy("entity", "day").agg(F.sum("n").alias("prior_citations"), F.count("*").alias("prior_codes"), lead.alias("lead"))
    any_first = v.groupBy("entity", "inspection").agg(F.min("vday").alias("vday")).groupBy("entity", "vday").agg(F.count("*").alias("k"))
    inspected = real.join(any_first, "entity").where(F.col("vday") < F.col("day")).groupBy("entity", "day").agg(F.sum("k").alias("prior_inspections"))
    return real.join(totals, ["entity", "day"], "left").join(inspected, ["entity", "day"], "left").select(
        "entity", "day", "prior_citations", "prior_inspections", "prior_codes", F.col("lead.code").alias("top_code"), F.col("lead.n").alias("top_code_citations"), F.col("lead.inspections").alias("top_code_inspections"))


def trusted_value(events: DataFrame, entity: str, day: str, value: str, distrust: str | None = None) -> DataFrame:
    """The one distinct value of a day among trusted rows; NULL if there are several or none."""
    ok = F.col(value).isNotNull() & (F.col(value) != "")
    if distrust:
        ok = ok & ~F.coalesce(F.col(distrust), F.lit(False))
    c = F.when(ok, F.col(value))
    return events.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.when(F.min(c) == F.max(c), F.min(c)).alias("value"))


# Parts of column names that a model matrix must not have.
FORBIDDEN = ["target", "label", "outcome", "adjudication", "enforcement", "michelin", "google", "next_inspection", "future_"]


def check_model_columns(columns: list[str], allowed: list[str]) -> None:
    """Every column is allowed and none has a forbidden part; looks at names only."""
    stray = [c for c in columns if c not in allowed]
    leaky = [c for c in columns if any(t in c.lower() for t in FORBIDDEN)]
    if stray or leaky:
        raise ValueError(f"not allowed: {stray}; forbidden: {leaky}")
