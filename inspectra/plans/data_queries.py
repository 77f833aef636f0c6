"""Queries of the general data problems (p1, p5, p6) over their whole tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions.keys import plain_id
from inspectra.operators import drift, references, rolling
from inspectra.session import table


def _existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    retired = t("retired_keys")
    kind = F.lower(F.trim("key_kind"))
    return (
        references.existence_deltas(t("restaurants"), "restaurant", F.col("restaurant_id"), F.col("first_loaded_at"))
        .unionByName(references.existence_deltas(t("michelin_seed_valid"), "michelin", F.col("michelin_restaurant_id"), F.col("loaded_at")))
        .unionByName(references.existence_deltas(retired, kind, F.col("key_value"), F.col("arrived_at"), F.col("retired_at")))
    )


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, events = table(spark, sf_dir, "restaurant_michelin_matches"), table(spark, sf_dir, "nyc_sample_expected")
    m = "restaurant_michelin_matches"
    return (
        references.references(matches, m, "official_restaurant_id", "match_no", "restaurant", "generated_at")
        .unionByName(references.references(matches, m, "michelin_restaurant_id", "match_no", "michelin", "generated_at"))
        .unionByName(references.references(events, "nyc_sample_expected", "restaurant_id", "event_no", "restaurant", "ingested_at"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(_references(spark, sf_dir), _existence(spark, sf_dir)).drop("key")


def p1_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(references.orphan_references(_references(spark, sf_dir), _existence(spark, sf_dir)))


def p1_current_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.current_orphans(references.count_state(_existence(spark, sf_dir), _references(spark, sf_dir)))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nyc_sample_expected").select(
        F.nullif(F.trim("inspection_id"), F.lit("")).alias("inspection_id"), "ingested_at", "event_no", plain_id(F.col("restaurant_id")).alias("restaurant_id"),
        "inspection_date", "violation_count", "critical_violation_count", "score")
    last = rolling.latest_version(rows, "inspection_id", ["ingested_at", "event_no"], [c for c in rows.columns if c != "inspection_id"])
    kept = last.where("restaurant_id IS NOT NULL AND inspection_date >= DATE '1990-01-01'")
    return rolling.daily_totals(
        kept, "restaurant_id", "inspection_date",
        sums={"violations": F.col("violation_count").cast("long"), "criticals": F.col("critical_violation_count").cast("long")},
        means={"score": F.when(~F.isnan("score"), F.col("score"))})


MEASURES = ["violations", "criticals", "score_sum", "score_n"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rolling.trailing_totals(_daily(spark, sf_dir), [7, 30], measures=MEASURES, idle_days=False)
    busy = (F.col("criticals_30d") >= 6) & (F.col("score_n_30d") > 0) & (F.col("score_sum_30d") >= 20 * F.col("score_n_30d")) & (F.col("violations_7d") == 0)
    return totals.where(busy).select(F.col("entity").alias("restaurant_id"), F.date_format("day", "yyyy-MM-dd").alias("as_of_day"))


def p5_trailing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolling.trailing_totals(_daily(spark, sf_dir), [7, 30], measures=MEASURES)
    mean = lambda p: F.try_divide(F.col(f"score_sum_{p}d"), F.col(f"score_n_{p}d")).alias(f"mean_score_{p}d")
    return t.select(F.col("entity").alias("restaurant_id"), F.date_format("day", "yyyy-MM-dd").alias("as_of_day"),
                    *[c for p in (7, 30) for c in (f"violations_{p}d", f"criticals_{p}d", f"score_n_{p}d")], mean(7), mean(30))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "extract_files"), table(spark, sf_dir, "extract_rows"))


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files' rows, parsed once and kept, and the field and type of each column."""
    files, rows = table(spark, sf_dir, "extract_files"), table(spark, sf_dir, "extract_rows")
    parsed = drift.checkpoint(drift.parsed_rows(files, rows))
    stats = drift.checkpoint(drift.path_statistics(drift.paths_of(parsed)))
    lineage = drift.column_lineage(files, drift.checkpoint(drift.schema_changes(files, rows, stats=stats)))
    return parsed, drift.checkpoint(drift.field_types(lineage, stats))


def p6_consistent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(*_typed(spark, sf_dir))


def p6_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, types = _typed(spark, sf_dir)
    return drift.failed_casts(drift.consistent_rows(drift.paths_of(parsed), types))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_report, p1_current_orphans, p5_found, p5_trailing_totals, p6_found, p6_consistent_table, p6_failed_casts)}

_PLAIN = "nullif(regexp_replace(regexp_replace(lower({0}), '[\\s\\x{{00A0}}]+', '', 'g'), '(^|:)0+([0-9]+)$', '\\1\\2'), '')"


def _plain(c: str) -> str:
    return _PLAIN.format(c)


_REFS = f"""
refs AS (
  SELECT 'restaurant_michelin_matches' child_table, 'official_restaurant_id' ref_column, match_no child_no,
         'restaurant|' || {_plain('official_restaurant_id')} AS key, generated_at AS t FROM restaurant_michelin_matches
  UNION ALL SELECT 'restaurant_michelin_matches', 'michelin_restaurant_id', match_no, 'michelin|' || {_plain('michelin_restaurant_id')}, generated_at FROM restaurant_michelin_matches
  UNION ALL SELECT 'nyc_sample_expected', 'restaurant_id', event_no, 'restaurant|' || {_plain('restaurant_id')}, ingested_at FROM nyc_sample_expected),
spans AS (
  SELECT 'restaurant|' || {_plain('restaurant_id')} AS key, min(first_loaded_at) AS a, NULL::TIMESTAMPTZ AS z FROM restaurants GROUP BY 1
  UNION ALL SELECT 'michelin|' || {_plain('michelin_restaurant_id')}, min(loaded_at), NULL::TIMESTAMPTZ FROM michelin_seed_valid GROUP BY 1
  UNION ALL SELECT DISTINCT lower(key_kind) || '|' || {_plain('key_value')}, arrived_at, retired_at FROM retired_keys),
judged AS (
  SELECT child_table, ref_column, child_no, r.key, r.t, count(s.key) AS known,
         count(*) FILTER (WHERE s.a <= r.t AND (s.z IS NULL OR r.t < s.z)) AS there, count(*) FILTER (WHERE s.z <= r.t) AS gone
  FROM refs r LEFT JOIN spans s ON r.key = s.key WHERE r.key IS NOT NULL GROUP BY ALL),
orphans AS (
  SELECT child_table, ref_column, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, child_no,
         CASE WHEN known = 0 THEN 'absent' WHEN gone > 0 THEN 'deleted' ELSE 'late' END AS reason, key
  FROM judged WHERE there = 0)"""

_DAILY = f"""
last AS (
  SELECT * FROM (SELECT {_plain('restaurant_id')} AS restaurant_id, inspection_date AS day, coalesce(violation_count, 0) v, coalesce(critical_violation_count, 0) c,
           CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
           row_number() OVER (PARTITION BY trim(inspection_id) ORDER BY ingested_at DESC NULLS LAST, event_no DESC) AS rn FROM nyc_sample_expected)
  WHERE rn = 1 AND restaurant_id IS NOT NULL AND day >= DATE '1990-01-01'),
bounds AS (SELECT restaurant_id, min(day) a, max(day) z FROM last GROUP BY 1),
calendar AS (SELECT restaurant_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM bounds),
totals AS (
  SELECT k.restaurant_id, k.day,
         coalesce(sum(v) FILTER (WHERE k.day - l.day < 7), 0)::BIGINT AS violations_7d, coalesce(sum(c) FILTER (WHERE k.day - l.day < 7), 0)::BIGINT AS criticals_7d,
         count(score) FILTER (WHERE k.day - l.day < 7) AS score_n_7d, sum(score) FILTER (WHERE k.day - l.day < 7) AS s7,
         coalesce(sum(v), 0)::BIGINT AS violations_30d, coalesce(sum(c), 0)::BIGINT AS criticals_30d, count(score) AS score_n_30d, sum(score) AS s30
  FROM calendar k LEFT JOIN last l ON k.restaurant_id = l.restaurant_id AND l.day <= k.day AND l.day > k.day - 30 GROUP BY 1, 2)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT child_table, ref_column, period, child_no, reason FROM orphans",
    "p1_orphan_report": f"WITH {_REFS} SELECT child_table, ref_column, period, reason, count(*) AS n_references, count(DISTINCT key) AS n_keys FROM orphans GROUP BY ALL",
    "p1_current_orphans": f"""WITH {_REFS},
e AS (SELECT key, count(*) - count(z) AS n FROM spans WHERE key IS NOT NULL GROUP BY 1),
r AS (SELECT key, count(*) AS n_references FROM refs WHERE key IS NOT NULL GROUP BY 1)
SELECT r.key, n_references FROM r LEFT JOIN e ON r.key = e.key WHERE coalesce(e.n, 0) <= 0""",
    "p5_found": f"""WITH {_DAILY} SELECT restaurant_id, strftime(day, '%Y-%m-%d') AS as_of_day FROM totals
WHERE criticals_30d >= 6 AND s30 / score_n_30d >= 20 AND violations_7d = 0""",
    "p5_trailing_totals": f"""WITH {_DAILY} SELECT restaurant_id, strftime(day, '%Y-%m-%d') AS as_of_day, violations_7d, criticals_7d, score_n_7d,
violations_30d, criticals_30d, score_n_30d, s7 / score_n_7d AS mean_score_7d, s30 / score_n_30d AS mean_score_30d FROM totals""",
}
