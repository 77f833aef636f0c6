"""City extracts, one row a citation, into inspection and violation events with counted rejections and conflicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra import schemas
from inspectra.functions.keys import digest
from inspectra.functions.names import normal_code, severity
from inspectra.functions.parse import clean, conform, iso_or_slash_date, lenient_double, reject_reason, require_columns, squeezed
from inspectra.operators.resolve import first_present, keep_first, resolve_conflicts
from inspectra.session import checkpoint

DATES, NUMBERS = ["inspection_date", "grade_date", "record_date"], ["score", "latitude", "longitude"]
DESCRIPTIVE = {"inspection_type_raw": "inspection_type", "dba": "dba", "boro_raw": "boro", "building": "building", "street": "street", "zipcode": "zipcode",
               "cuisine_description": "cuisine_description", "latitude": "latitude", "longitude": "longitude"}


def typed_rows(raw: DataFrame) -> DataFrame:
    """The known columns with typed dates and numbers; unknown columns stay, invalid rows stay.

    Rows have no order of their own, so ``row_key``, a hash of the raw columns, breaks ties.
    """
    require_columns(raw, schemas.NYC_REQUIRED)
    df = raw.withColumns({c: F.lit(None).cast("string") for c in schemas.NYC_OPTIONAL if c not in raw.columns})
    key = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(raw.columns)])
    typed = {c: iso_or_slash_date(F.col(c)) for c in DATES} | {c: lenient_double(F.col(c)) for c in NUMBERS}
    text = {c: clean(F.col(c)) for c in [*schemas.NYC_REQUIRED, *schemas.NYC_OPTIONAL] if c not in typed}
    return df.withColumn("row_key", key).withColumns(typed | text)


def staged(raw: DataFrame) -> DataFrame:
    """Typed rows with ``reject``: the first of invalid id, unparseable date, placeholder date, or NULL for rows that are kept."""
    rows = typed_rows(raw)
    reject = reject_reason(
        ("invalid_camis", F.coalesce(~F.col("camis").rlike(r"^\p{Nd}+$"), F.lit(True))), ("unparseable_date", F.col("inspection_date").isNull()),
        ("placeholder_date", F.col("inspection_date") == F.lit("1900-01-01").cast("date")))
    kind = squeezed(F.coalesce("inspection_type", F.lit("")))
    return rows.withColumns({
        "reject": reject, "type_norm": kind, "restaurant_id": F.concat(F.lit("nyc:"), "camis"),
        "inspection_id": F.concat(F.lit("nyc:"), "camis", F.lit(":"), F.date_format("inspection_date", "yyyy-MM-dd"), F.lit(":"), kind)})


def violations(kept: DataFrame) -> DataFrame:
    """One violation per inspection, normal code and normal description: the latest record, then flag, then row."""
    v = kept.where(clean(F.col("violation_code")).isNotNull()).withColumns({
        "violation_code_norm": normal_code(F.col("violation_code")), "violation_description_norm": normal_code(F.col("violation_description")),
        "_d": F.coalesce(F.unix_date("record_date"), F.lit(-800_000))})
    first = keep_first(v, ["inspection_id", "violation_code_norm", "violation_description_norm"],
                       [F.desc("_d"), F.coalesce("critical_flag", F.lit("")).asc(), F.asc("row_key")])
    return first.select(
        digest("nyc:v:", F.col("inspection_id"), F.col("violation_code_norm"), F.col("violation_description_norm")).alias("violation_event_id"), "inspection_id", "restaurant_id",
        F.lit("nyc").alias("jurisdiction"), "inspection_date", "violation_code", "violation_code_norm", "violation_description", "violation_description_norm",
        F.col("critical_flag").alias("critical_flag_raw"), severity(F.col("critical_flag")).alias("severity"), F.lit(1).alias("count"))


def build_events(raw: DataFrame, *, ingested_at: datetime | None = None, dataset: str | None = None, sha256: str | None = None, version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(inspection_events, violation_events, report)``; the snapshot is the latest record date of all raw rows.

    Descriptive fields take the first value present in the order latest record first; score, action and grade are
    resolved conservatively; the grade date is the latest one of the chosen grade.
    """
    all_rows = checkpoint(staged(raw))  # typed once; events, violations and the report read it
    kept = all_rows.where("reject IS NULL")
    keys = ["inspection_id"]
    conflicts = resolve_conflicts(kept, keys, {
        "score": F.col("score"), "action": F.when(F.col("action") != "Missing", F.col("action")), "grade": F.col("grade")}, "record_date")
    order = F.struct((-F.coalesce(F.unix_date("record_date"), F.lit(-800_000))).alias("a"), F.col("row_key"))
    base = kept.groupBy(*keys).agg(
        F.first("restaurant_id").alias("restaurant_id"), F.first("camis").alias("source_id"), F.first("inspection_date").alias("inspection_date"), F.first("type_norm").alias("inspection_type"),
        *[first_present(F.col(c), order).alias(n) for n, c in DESCRIPTIVE.items()])
    graded = kept.where("grade IS NOT NULL AND grade_date IS NOT NULL").groupBy(F.col("inspection_id").alias("_gid"), F.col("grade").alias("_g")).agg(F.max("grade_date").alias("grade_date"))
    v = violations(kept)
    counts = v.groupBy("inspection_id").agg(F.count("*").cast("int").alias("violation_count"), F.count_if(F.col("severity") == "critical").cast("int").alias("critical_violation_count"))
    snapshot = all_rows.agg(F.max("record_date").alias("source_snapshot_date"))
    constants = {"source_dataset": F.lit(dataset), "source_sha256": F.lit(sha256), "ingested_at": F.lit(ingested_at).cast("timestamp"), "pipeline_version": F.lit(version)}
    e = base.join(conflicts, keys, "left").join(counts, keys, "left").join(graded, (F.col("inspection_id") == F.col("_gid")) & (F.col("grade") == F.col("_g")), "left")
    e = e.crossJoin(F.broadcast(snapshot)).withColumns(constants | {  # the snapshot is one row
        "jurisdiction": F.lit("nyc"), "violation_count": F.coalesce("violation_count", F.lit(0)), "critical_violation_count": F.coalesce("critical_violation_count", F.lit(0)),
        **{f"{c}_conflict": F.coalesce(f"{c}_conflict", F.lit(False)) for c in ("score", "action", "grade")}})
    events = conform(e, schemas.INSPECTION_EVENTS)
    return events, conform(v.crossJoin(F.broadcast(snapshot)).withColumns(constants), schemas.VIOLATION_EVENTS), rejection_report(all_rows)


def rejection_report(all_rows: DataFrame) -> DataFrame:
    """Rows by outcome; ``kept`` for those that no rule rejects."""
    return all_rows.groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("rows"))
