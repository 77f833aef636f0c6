"""Labels, chronological splits and the metrics of scored rows, all as plans over windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the targets look at.
NYC_TYPES = ["Cycle Inspection / Initial Inspection", "Pre-permit (Operational) / Initial Inspection", "Pre-permit (Non-operational) / Initial Inspection"]
NYC_SCORE, NYC_HIGH_SCORE = 14.0, 28.0
FL_TYPE, FL_POSITIVE, FL_KNOWN = "Routine - Food", ["follow_up_required", "temporary_closure"], ["met_standards", "follow_up_required", "temporary_closure"]


def check_jurisdiction(events: DataFrame, jurisdiction: str) -> None:
    if events.where(~F.col("jurisdiction").eqNullSafe(F.lit(jurisdiction))).limit(1).count():
        raise ValueError(f"events of another jurisdiction than {jurisdiction}")


def nyc_target(events: DataFrame, label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(inspection_id, label)`` and a report of what was left out; by default the label is a score of 14 or more."""
    reason = F.when(~F.col("inspection_type").isin(NYC_TYPES), "non_qualifying_type").when(F.col("score_conflict"), "score_conflict").when(F.col("score").isNull(), "missing_score")
    staged = events.withColumn("excluded", reason)
    y = (F.col("score") >= NYC_SCORE if label is None else label).cast("tinyint")
    out = staged.where("excluded IS NULL").select("inspection_id", y.alias("label"))
    return out, staged.groupBy(F.coalesce("excluded", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("rows"))


def florida_target(events: DataFrame, label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """First routine food visits of unambiguous groups; the label is any high priority count or a positive disposition."""
    first = (F.col("inspection_type") == FL_TYPE) & (F.col("native_visit_sequence") == 1)
    n = F.count_if(F.coalesce(first, F.lit(False))).over(Window.partitionBy("native_inspection_group_id"))
    reason = (
        F.when(~F.coalesce(F.col("inspection_type") == FL_TYPE, F.lit(False)), "non_qualifying_type").when(~F.coalesce(first, F.lit(False)), "not_first_visit").when((n > 1) & F.col("native_inspection_group_id").isNotNull(), "ambiguous_group")
        .when(F.col("high_priority_count").isNull(), "missing_high_priority").when(~F.coalesce(F.col("disposition_status").isin(FL_KNOWN), F.lit(False)), "unknown_disposition"))
    staged = events.withColumn("excluded", reason)
    y = ((F.col("high_priority_count") >= 1) | F.col("disposition_status").isin(FL_POSITIVE)) if label is None else label
    out = staged.where("excluded IS NULL").select("inspection_id", y.cast("tinyint").alias("label"))
    return out, staged.groupBy(F.coalesce("excluded", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("rows"))


def training_frame(target: DataFrame, features: DataFrame) -> DataFrame:
    """Target and features one to one by inspection; a key twice on either side is an error."""
    for name, df in (("target", target), ("features", features)):
        if df.groupBy("inspection_id").count().where("count > 1").limit(1).count():
            raise ValueError(f"an inspection occurs twice in {name}")
    return target.join(features, "inspection_id")


def chronological_split(frame: DataFrame, day: str, bounds: list[str]) -> DataFrame:
    """Adds ``part``: half-open train, validation and test between four dates; ``before`` and ``after`` outside."""
    d, b = F.col(day), [F.lit(x).cast("date") for x in bounds]
    if len(bounds) != 4 or sorted(bounds) != list(bounds) or len(set(bounds)) != 4:
        raise ValueError("four rising dates are needed")
    return frame.withColumn("part", F.when(d < b[0], "before").when(d < b[1], "train").when(d < b[2], "validation").when(d < b[3], "test").otherwise("after"))


def part_summary(split: DataFrame, label: str, day: str) -> DataFrame:
    n, p = F.count("*"), F.count_if(F.col(label) == 1)
    return split.groupBy("part").agg(n.alias("rows"), p.alias("positives"), (n - p).alias("negatives"), (p / n).alias("prevalence"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def quantile_bounds(frame: DataFrame, day: str, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """Dates at which the shares of rows end, counted exactly over days."""
    per = frame.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    total, upto = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.orderBy("day"))
    c = per.withColumns({"total": total, "upto": upto})
    cut = lambda s: F.min(F.when(F.col("upto") > F.floor(F.col("total") * s), F.col("day")))
    return c.agg(F.min("day").alias("first_day"), cut(shares[0]).alias("validation_from"), cut(shares[0] + shares[1]).alias("test_from"), F.date_add(F.max("day"), 1).alias("end"))


# -- metrics over (label, probability) -----------------------------------------------------------------------------


def _per_score(df: DataFrame, label: str, p: str, by: list[str]) -> DataFrame:
    """Positives and rows by distinct probability, with running totals from the highest one down."""
    g = df.groupBy(*by, F.col(p).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.desc("p"))
    return g.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("pos").over(w)})


def average_precision(df: DataFrame, label: str, p: str, by: list[str]) -> DataFrame:
    """Step-wise average precision and area under the ROC curve; NULL where a class is missing. Ties count as one step."""
    s = _per_score(df, label, p, by)
    neg = F.col("n") - F.col("pos")
    above = F.col("cn") - F.col("cp") - neg  # negatives with a higher probability
    agg = s.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum(neg).alias("_n"), F.sum(F.col("pos") * (F.col("cp") / F.col("cn"))).alias("_ap"), F.sum(F.col("pos") * above + F.col("pos") * neg / 2.0).alias("_above"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(*by, F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"), F.when(both, 1.0 - F.col("_above") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def calibration_error(df: DataFrame, label: str, p: str, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    g = df.groupBy(*by, b).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(label).cast("double"))).alias("gap"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"))


def top_decile(df: DataFrame, label: str, p: str, key: str, by: list[str], least: int = 10) -> DataFrame:
    """Recall among the first tenth by probability (then key); NULL with fewer than ``least`` rows or no positive."""
    w = Window.partitionBy(*by)
    r = df.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc(p), F.asc(key))), "_n": F.count("*").over(w)})
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(0.1)))
    g = r.groupBy(*by).agg(F.max("_n").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if((F.col(label) == 1) & (F.col("_rn") <= k)).alias("hit"), F.max(k).alias("k"))
    ok = (F.col("n") >= least) & (F.col("pos") > 0)
    return g.select(*by, F.when(ok, F.col("hit") / F.col("pos")).alias("top_decile_recall"), F.when(ok, F.col("k")).cast("long").alias("top_decile_rows"))


def threshold_metrics(df: DataFrame, label: str, p: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, Brier score, log loss, confusion counts, precision and recall at a threshold."""
    y, hit = F.col(label).cast("double"), F.col(p) >= threshold
    eps = 2.220446049250313e-16
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    g = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("_ll"),
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 0)).alias("tn"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return g.withColumns({"log_loss": F.when(both, F.col("_ll")), "precision": F.when(both, F.try_divide("tp", F.col("tp") + F.col("fp"))), "recall": F.when(both, F.try_divide("tp", F.col("tp") + F.col("fn")))}).drop("_ll")


def subgroup_report(df: DataFrame, label: str, p: str, group: str, *, rows: int = 30, each: int = 5) -> DataFrame:
    """Threshold metrics by group, suppressed where a group has too few rows, positives or negatives."""
    g = threshold_metrics(df, label, p, [group])
    few = (F.col("rows") < rows) | (F.col("positives") < each) | (F.col("rows") - F.col("positives") < each)
    return g.select(group, "rows", "positives", few.alias("suppressed"), *[F.when(~few, F.col(c)).alias(c) for c in ("brier", "precision", "recall")])


def risk_band(p: Column, low: float = 0.25, moderate: float = 0.5) -> Column:
    return F.when(p.isNull(), "insufficient_history").when(p < low, "low").when(p < moderate, "moderate").otherwise("high")


def banded(scored: DataFrame, *, depth: str, valid: str, p: str, lower: str, upper: str) -> DataFrame:
    """Probability, interval and band; all NULL with a reason where there is no history or no valid earlier measure."""
    reason = F.when(F.coalesce(depth, F.lit(0)) == 0, "no_prior_inspection_event").when(F.coalesce(valid, F.lit(0)) < 1, "no_valid_prior_measure")
    ok = reason.isNull()
    keep = {c: F.when(ok, F.col(c)) for c in (p, lower, upper)}
    return scored.withColumns({"reason": reason, "risk_band": risk_band(F.when(ok, F.col(p)))} | keep)


def interval(members: DataFrame, entity: str, value: str, point: str, least: int = 20) -> DataFrame:
    """Percentiles 2.5 and 97.5 of the members with a value, widened to hold the point; NULL with too few members."""
    g = members.groupBy(entity).agg(F.count(value).alias("n"), F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"), F.max(point).alias("point"))
    ok = F.col("n") >= least
    return g.select(entity, "n", F.when(ok, F.least("lo", "point")).alias("lower"), F.when(ok, F.greatest("hi", "point")).alias("upper"))
