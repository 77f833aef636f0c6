"""Award lists: validated rows, identities by digest, events, and what contradicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.functions.keys import digest
from inspectra.functions.names import normal_address, normal_name
from inspectra.functions.parse import clean, lenient_double, reject_reason, require_columns
from inspectra.operators.resolve import keep_first
from inspectra.session import checkpoint

REQUIRED = ["name_as_published", "city", "region", "jurisdiction_candidate", "distinction", "guide_name", "guide_year", "source_url", "source_title", "source_publisher",
            "source_access_date", "source_license_note", "provenance_confidence"]
OPTIONAL = ["address_as_published", "postal_code", "latitude", "longitude", "announced_date", "source_row_ref", "curator_restaurant_ref"]
DISTINCTIONS = ["michelin_selected", "bib_gourmand", "one_star", "two_stars", "three_stars", "green_star"]
CONFIDENCES = ["verified_primary", "verified_secondary"]


def staged(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Clean rows with ``reject``, ids and ``row_key`` (the column ``order`` if given, else a hash of the row)."""
    require_columns(raw, REQUIRED)
    df = raw.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in raw.columns})
    key = F.col(order) if order else F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(raw.columns)])
    df = df.withColumn("row_key", key).withColumns({c: clean(F.col(c)) for c in [*REQUIRED, *OPTIONAL]})
    day = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    year = F.col("guide_year").try_cast("int")
    missing = lambda *cs: F.array_contains(F.array(*[F.col(c).isNull() for c in cs]), True)
    reject = reject_reason(
        ("missing_required_field", missing("name_as_published", "city", "region", "guide_name")),
        ("missing_jurisdiction_candidate", ~F.coalesce(F.col("jurisdiction_candidate").isin("nyc", "florida"), F.lit(False))),
        ("unsupported_distinction", ~F.coalesce(F.col("distinction").isin(DISTINCTIONS), F.lit(False))),
        ("invalid_provenance_confidence", ~F.coalesce(F.col("provenance_confidence").isin(CONFIDENCES), F.lit(False))),
        ("missing_provenance", missing("source_url", "source_title", "source_publisher", "source_license_note")),
        ("malformed_guide_year", year.isNull()), ("missing_provenance", day("source_access_date").isNull()),
        ("malformed_announced_date", F.col("announced_date").isNotNull() & day("announced_date").isNull()))
    df = df.withColumns({"reject": reject, "guide_year": year, "source_access_date": day("source_access_date"), "announced_date": day("announced_date"),
                         "latitude": lenient_double(F.col("latitude")), "longitude": lenient_double(F.col("longitude")),
                         "normalized_name": normal_name(F.col("name_as_published")), "normalized_address": normal_address(F.col("address_as_published"))["normal"]})
    df = df.withColumn("award_id", digest("michelin:r:", F.col("jurisdiction_candidate"), F.col("normalized_name"), F.col("normalized_address"), F.col("postal_code")))
    return df.withColumn("event_id", digest("michelin:e:", F.col("award_id"), F.col("guide_year"), F.col("distinction"), F.coalesce("source_row_ref", "source_url")))


def build(raw: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """``restaurants``, ``events``, ``rejected`` (by reason) and ``conflicts`` (kind, id).

    The first row of an id wins. ``city_region``: rows of one id disagree in city or region; ``event``: rows of
    one event id differ in content; ``identity_drift``: a curator reference that has several ids.
    """
    rows = checkpoint(staged(raw, order))  # an award list is short, its normal forms are long expressions
    kept = rows.where("reject IS NULL")
    places = kept.groupBy(F.col("award_id").alias("id")).agg(F.count_distinct(F.struct("city", "region")).alias("n")).where("n > 1")
    content = F.struct("distinction", "guide_name", "guide_year", "announced_date", "source_url", "source_title", "source_publisher", "source_access_date", "source_license_note", "provenance_confidence", "source_row_ref")
    events = kept.groupBy(F.col("event_id").alias("id")).agg(F.count_distinct(content).alias("n")).where("n > 1")
    drift = kept.where("curator_restaurant_ref IS NOT NULL").groupBy(F.col("curator_restaurant_ref").alias("id")).agg(F.count_distinct("award_id").alias("n")).where("n > 1")
    conflicts = None
    for kind, df in (("city_region", places), ("event", events), ("identity_drift", drift)):
        part = df.select(F.lit(kind).alias("kind"), "id")
        conflicts = part if conflicts is None else conflicts.unionByName(part)
    who = ["award_id", "name_as_published", "normalized_name", "address_as_published", "normalized_address", "city", "region", "postal_code", "latitude", "longitude", "jurisdiction_candidate", "curator_restaurant_ref"]
    what = ["event_id", "award_id", "distinction", "guide_name", "guide_year", "announced_date", "source_url", "source_title", "source_publisher", "source_access_date", "source_license_note", "provenance_confidence", "source_row_ref"]
    return {
        "restaurants": keep_first(kept, ["award_id"], [F.asc("row_key")]).select(*who), "events": keep_first(kept, ["event_id"], [F.asc("row_key")]).select(*what),
        "rejected": rows.where("reject IS NOT NULL").groupBy("reject").agg(F.count("*").alias("rows")), "conflicts": conflicts,
    }


def events_as_of(events: DataFrame, day: str) -> DataFrame:
    """Events announced on or before a day; those without a date are left out."""
    return events.where(F.col("announced_date") <= F.lit(day).cast("date"))


def orphan_events(events: DataFrame, restaurants: DataFrame) -> DataFrame:
    return events.join(restaurants.select("award_id"), "award_id", "left_anti")
