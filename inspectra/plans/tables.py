"""The pipelines from raw extracts to stored tables, models and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.functions.keys import digest
from inspectra.functions.names import normal_name
from inspectra.operators import evaluation, history, ingest_florida, ingest_nyc, models, serving
from inspectra.sources.artifacts import model_card, write_artifact


def restaurants(events: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """One row a restaurant from its latest event (smallest id); Florida addresses come from the visits by their id."""
    last = serving.latest_row(events, "restaurant_id", "inspection_date", F.asc("inspection_id"))
    out = last.select("restaurant_id", "jurisdiction", "source_id", F.col("dba").alias("name"), normal_name(F.col("dba")).alias("normalized_name"), "inspection_id",
                      F.concat_ws(" ", "building", "street").alias("address"), F.col("boro_raw").alias("city"), F.col("zipcode").alias("postal_code"), "latitude", "longitude",
                      F.col("cuisine_description").alias("cuisine"), F.col("inspection_date").alias("latest_inspection_date"), "source_snapshot_date")
    if visits is None:
        return out.drop("inspection_id")
    v = visits.select(F.concat(F.lit("florida:"), "inspection_visit_id").alias("inspection_id"), F.col("location_address").alias("_a"), F.col("location_city").alias("_c"), F.col("location_zip").alias("_z"))
    j = out.join(v, "inspection_id", "left")
    return j.withColumns({"address": F.coalesce("_a", F.nullif("address", F.lit(""))), "city": F.coalesce("_c", "city"), "postal_code": F.coalesce("_z", "postal_code")}).drop("_a", "_c", "_z", "inspection_id")


def build_tables(nyc_raw: DataFrame | None, florida_raw: DataFrame | None, **constants) -> dict[str, DataFrame]:
    """``restaurants``, ``inspection_events`` and ``violation_events`` of the given jurisdictions together."""
    parts: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    if nyc_raw is not None:
        e, v, _ = ingest_nyc.build_events(nyc_raw, **constants)
        parts.append((restaurants(e), e, v))
    if florida_raw is not None:
        e, v, _, _ = ingest_florida.build_events(florida_raw, **constants)
        visits, _ = ingest_florida.deduplicated(ingest_florida.staged(florida_raw).where("reject IS NULL"))
        parts.append((restaurants(e, visits), e, v))
    if not parts:
        raise ValueError("no extract is given")
    first, *rest = parts
    for p in rest:
        first = tuple(a.unionByName(b) for a, b in zip(first, p))
    return dict(zip(("restaurants", "inspection_events", "violation_events"), first))


def day_table(events: DataFrame, jurisdiction: str) -> DataFrame:
    """The day table whose history the models use."""
    if jurisdiction == "nyc":
        score = F.when(~F.coalesce("score_conflict", F.lit(False)), F.col("score"))
        return history.collapse_days(events, "restaurant_id", "inspection_date", additive={"critical": F.col("critical_violation_count").cast("double")}, single={"score": score})
    counts = {"high": "high_priority_count", "intermediate": "intermediate_count", "basic": "basic_count", "total": "violation_count"}
    days = history.collapse_days(events, "restaurant_id", "inspection_date", additive={k: F.col(c).cast("double") for k, c in counts.items()}, single={})
    flags = events.groupBy(F.col("restaurant_id").alias("entity"), F.col("inspection_date").alias("day")).agg(
        F.count_if(F.col("high_priority_count") > 0).alias("high_inspections"), F.count_if(F.col("disposition_status") == "follow_up_required").alias("follow_ups"), F.count_if(F.col("disposition_status") == "temporary_closure").alias("closures"))
    return days.join(flags, ["entity", "day"])


MEASURES = {"nyc": (["score", "critical"], []), "florida": (["high", "intermediate", "basic", "total"], ["high_inspections", "follow_ups", "closures"])}


def features(events: DataFrame, violations: DataFrame, jurisdiction: str) -> DataFrame:
    """History features of every inspection, from strictly earlier days."""
    evaluation.check_jurisdiction(events, jurisdiction)
    measures, counters = MEASURES[jurisdiction]
    days = day_table(events, jurisdiction)
    f = history.history_features(days, measures, counters).join(
        history.code_history(days, violations, entity="restaurant_id", day="inspection_date", inspection="inspection_id", code="violation_code", count="count"), ["entity", "day"], "left")
    return events.select("inspection_id", F.col("restaurant_id").alias("entity"), F.col("inspection_date").alias("day")).join(f, ["entity", "day"])


#: Members of the bootstrap.
MEMBERS = 30


def train(frame: DataFrame, columns: list[str], bounds: list[str], folder: str, *, jurisdiction: str, target: str, version: str, members: int = MEMBERS, needed: int = 20, boosted: bool = False, force: bool = False) -> str:
    """Split, select, calibrate, measure, bootstrap and write the artifact; returns its readiness. ``frame`` has label, day, entity, inspection_id."""
    split = evaluation.chronological_split(frame, "day", bounds)
    part = {p: split.where(F.col("part") == p).drop("part").persist() for p in ("train", "validation", "test")}
    chosen = models.select_model(part["train"], part["validation"], columns, "label", boosted=boosted)
    calibration = models.calibrate(models.scored(chosen.model, part["validation"], columns), "label")
    metrics = {}
    for p, df in part.items():
        s = models.calibrated(models.scored(chosen.model, df, columns), calibration).withColumn("part", F.lit(p))
        row = evaluation.threshold_metrics(s, "label", "calibrated", ["part"]).join(evaluation.average_precision(s, "label", "calibrated", ["part"]), "part").join(evaluation.calibration_error(s, "label", "calibrated", ["part"]), "part").first()
        metrics[p] = row.asDict() if row else {}
    fit = models.fit_boosted if chosen.name == "boosted" else models.fit_logistic
    drawn = [] if isinstance(chosen.model, float) else models.fit_members(part["train"], part["validation"], columns, "label", "entity", members, fit=fit, weight=chosen.weighted)
    good = sum(m.reason is None for m in drawn)
    status = models.readiness(model_status=chosen.status, calibration=calibration[0], members=good, needed=needed, features=columns, splits_ok=all(m.get("rows") for m in metrics.values()), test_ok=bool(metrics["test"]))
    meta = {"jurisdiction": jurisdiction, "target": target, "version": version, "readiness": status, "model": chosen.name, "weighted": chosen.weighted, "calibration": calibration[0], "bounds": bounds, "seed": models.SEED}
    kept = {"needed": needed, "members": [{"member": m.number, "calibration": m.calibration[0], "reason": m.reason} for m in drawn]}
    more = {"calibration": calibration[1]} | {f"members/{m.number}/{k}": x for m in drawn for k, x in (("model", m.model), ("calibration", m.calibration[1]))}
    write_artifact(folder, {"metadata.json": meta, "metrics.json": metrics, "features.json": columns, "calibration.json": {"method": calibration[0]}, "members.json": kept, "model_card.md": model_card(meta, metrics)},
                   None if isinstance(chosen.model, float) else chosen.model, more=more, force=force)
    for df in part.values():
        df.unpersist()
    return status


def score(trained: models.Trained, events: DataFrame, violations: DataFrame, columns: list[str], *, jurisdiction: str, target: str, version: str, as_of: str, generated_at: Column) -> DataFrame:
    """Calibrated predictions of every restaurant of the jurisdiction as of a day, with their intervals; only its own events are looked at."""
    own = events.where(F.col("jurisdiction") == jurisdiction)
    measures, counters = MEASURES[jurisdiction]
    days = day_table(own, jurisdiction)
    state = history.state_as_of(days, own.select(F.col("restaurant_id").alias("entity")), measures, as_of, counters)
    s = models.scored_with_interval(trained, state.withColumns({c: F.lit(None).cast("double") for c in columns if c not in state.columns}), columns, "entity")
    valid = "score_days" if jurisdiction == "nyc" else "high_days"
    b = evaluation.banded(s, depth="history_depth", valid=valid, p="probability_1", lower="lower", upper="upper")
    return b.select(digest("pred:", F.col("entity"), F.lit(jurisdiction), F.lit(target), F.lit(version), F.lit(as_of)).alias("prediction_id"), F.col("entity").alias("restaurant_id"), F.lit(jurisdiction).alias("jurisdiction"), F.lit(target).alias("target"),
                    F.lit(version).alias("model_version"), F.lit(as_of).cast("date").alias("as_of_date"), generated_at.alias("generated_at"), F.col("probability_1").alias("probability"), "lower", "upper", "risk_band", "reason")
