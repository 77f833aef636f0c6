"""State extracts, one row a visit with a wide matrix of counts, into inspection and violation events."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra import schemas
from inspectra.functions.keys import digest
from inspectra.functions.names import mapped
from inspectra.functions.parse import clean, conform, reject_reason, require_columns, slash_or_iso_date
from inspectra.operators.resolve import duplicate_signatures
from inspectra.session import checkpoint

COUNTS = ["total_violations", "high_priority_count", "intermediate_count", "basic_count", "visit_number"]

# What a disposition means; dashes are plain.
DISPOSITIONS = {
    "Inspection Completed - No Further Action": "met_standards", "Callback - Complied": "met_standards", "Admin. Complaint Callback Complied": "met_standards",
    "Emergency Order Callback Complied": "met_standards", "Warning Issued": "follow_up_required", "Callback - Extension given, pending": "follow_up_required",
    "Callback - Administrative complaint recommended": "follow_up_required", "Administrative complaint recommended": "follow_up_required",
    "Admin. Complaint Callback Not Complied": "follow_up_required", "Administrative Complaint Time Extension": "follow_up_required",
    "Emergency Order Callback Time Extension": "follow_up_required", "Emergency order recommended": "temporary_closure",
    "Administrative determination recommended": "temporary_closure", "Emergency Order Callback Not Complied": "temporary_closure",
}
FOOD_LICENSES = ["2010", "2012", "2013", "2014", "2015", "2016"]


def staged(raw: DataFrame, *, licenses: list[str] | None = None) -> DataFrame:
    """Typed rows with ``reject``: scope, license, visit id, identity, date, in that order; NULL for rows that are kept."""
    require_columns(raw, schemas.FL_REQUIRED)
    columns = [*schemas.FL_REQUIRED, *schemas.FL_OPTIONAL]
    df = raw.withColumns({c: F.lit(None).cast("string") for c in schemas.FL_OPTIONAL if c not in raw.columns})
    key = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(raw.columns)])
    df = df.withColumn("row_key", key).withColumns({c: clean(F.col(c)) for c in columns})
    numbers = [*COUNTS, *schemas.FL_CATEGORIES]
    given = F.array_size(F.array_compact(F.array(*numbers)))
    df = df.withColumn("_given", given).withColumns({c: F.col(c).try_cast("int") for c in numbers}).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in numbers})
    df = df.withColumn("malformed", F.array_size(F.array_compact(F.array(*numbers))) < F.col("_given")).drop("_given").withColumn("inspection_day", slash_or_iso_date(F.col("inspection_date")))
    scope = (F.lower("inspection_class") == "food") & F.col("license_type_code").isin(FOOD_LICENSES if licenses is None else licenses)
    reject = reject_reason(
        ("out_of_scope", ~F.coalesce(scope, F.lit(False))), ("missing_license", F.col("license_number").isNull()), ("missing_visit_id", F.col("inspection_visit_id").isNull()),
        ("invalid_identity", F.col("inspection_number").isNull() | F.col("visit_number").isNull()), ("unparseable_date", F.col("inspection_day").isNull()))
    return df.withColumn("reject", reject)


def material(df: DataFrame) -> list:
    return [F.col(c) for c in ["license_number", "inspection_number", "visit_number", "inspection_class", "inspection_type", "inspection_disposition", "inspection_day", *COUNTS[:4], *schemas.FL_CATEGORIES]]


def deduplicated(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits once: equal rows keep one, rows that disagree in a material field are all dropped and reported."""
    order = [c for c in ("source_file", "row_key") if c in kept.columns]
    return duplicate_signatures(kept, "inspection_visit_id", material(kept), order)


def disposition_status(df: DataFrame) -> DataFrame:
    plain = F.translate("inspection_disposition", "–—", "--")
    return df.withColumn("disposition_status", mapped(plain, DISPOSITIONS, "unknown"))


def category_rows(visits: DataFrame) -> DataFrame:
    """The matrix of counts turned to rows ``(code, count)``; only counts above zero."""
    ids = ["inspection_visit_id", "license_number", "inspection_day"]
    long = visits.select(*ids, *schemas.FL_CATEGORIES).unpivot(ids, schemas.FL_CATEGORIES, "category", "count")
    return long.where("count > 0").withColumn("code", F.substring("category", 11, 2)).drop("category")


def reconciliation(visits: DataFrame) -> DataFrame:
    """One row: visits, totals that differ from the three priorities or from the categories, malformed rows, unknown dispositions."""
    total, parts = F.col("total_violations"), F.col("high_priority_count") + F.col("intermediate_count") + F.col("basic_count")
    categories = sum((F.col(c) for c in schemas.FL_CATEGORIES[1:]), F.col(schemas.FL_CATEGORIES[0]))  # NULL if any is
    v = disposition_status(visits)
    return v.agg(F.count("*").alias("visits"), F.count_if(total != parts).alias("total_differs_from_priorities"), F.count_if(total != categories).alias("total_differs_from_categories"),
                 F.count_if("malformed").alias("malformed_rows"), F.count_if(F.col("disposition_status") == "unknown").alias("unknown_dispositions"))


def build_events(raw: DataFrame, *, ingested_at: datetime | None = None, snapshot: date | None = None, dataset: str | None = None, version: str | None = None,
                 titles: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(inspection_events, violation_events, report, conflicting_visits)``. ``titles`` names the categories, if given."""
    all_rows = checkpoint(staged(raw))  # typed once; visits, conflicts, categories and the report read it
    visits, conflicts = deduplicated(all_rows.where("reject IS NULL"))
    constants = {"source_dataset": F.lit(dataset), "source_snapshot_date": F.lit(snapshot).cast("date"), "ingested_at": F.lit(ingested_at).cast("timestamp"), "pipeline_version": F.lit(version)}
    ids = {"inspection_id": F.concat(F.lit("florida:"), "inspection_visit_id"), "restaurant_id": F.concat(F.lit("florida:"), "license_number"), "jurisdiction": F.lit("florida"), "inspection_date": F.col("inspection_day")}
    e = disposition_status(visits).withColumns(constants | ids | {
        "source_id": F.col("license_number"), "inspection_type_raw": F.col("inspection_type"), "disposition": F.col("inspection_disposition"), "native_inspection_group_id": F.col("inspection_number"),
        "native_visit_sequence": F.col("visit_number"), "violation_count": F.col("total_violations"), "zipcode": F.col("location_zip")})
    title = mapped(F.col("code"), titles, "") if titles else F.lit("")
    v = category_rows(visits).withColumns(constants | ids | {
        "violation_event_id": digest("florida:v:", ids["inspection_id"], F.col("code")), "violation_code": F.col("code"), "violation_code_norm": F.col("code"),
        "violation_description": F.nullif(title, F.lit("")), "severity": F.lit("other")})
    report = all_rows.groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("rows"))
    return conform(e, schemas.INSPECTION_EVENTS), conform(v, schemas.VIOLATION_EVENTS), report, conflicts
