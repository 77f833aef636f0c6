"""Queries of the domain operators over their whole tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import names as nm
from inspectra.functions import parse as ps
from inspectra.functions.keys import digest, plain_id
from inspectra.functions.similarity import haversine_km
from inspectra.operators import awards, evaluation, forms, graph, history, ingest_florida, ingest_nyc, matching, questions, resolve, serving
from inspectra.plans import tables
from inspectra.session import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- shared parts of the SQL ---------------------------------------------------------------------------------------


def _clean(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _iso_slash(c: str) -> str:
    return f"coalesce(try_strptime(substr({_clean(c)}, 1, 10), '%Y-%m-%d'), try_strptime({_clean(c)}, '%m/%d/%Y'))::DATE"


def _slash_iso(c: str) -> str:
    return f"coalesce(try_strptime({_clean(c)}, '%m/%d/%Y'), try_strptime({_clean(c)}, '%Y-%m-%d'))::DATE"


def _double(c: str) -> str:
    return f"CASE WHEN isnan(try_cast({_clean(c)} AS DOUBLE)) THEN NULL ELSE try_cast({_clean(c)} AS DOUBLE) END"


def _count(c: str) -> str:
    return f"CASE WHEN try_cast(CASE WHEN regexp_matches({_clean(c)}, '^[+-]?[0-9]+$') THEN {_clean(c)} END AS INTEGER) >= 0 THEN try_cast({_clean(c)} AS INTEGER) END"


_NYC = f"""
typed AS (
  SELECT {_clean('camis')} AS camis, {_iso_slash('inspection_date')} AS day, {_squeeze("coalesce(inspection_type, '')")} AS kind, {_clean('action')} AS action, {_double('score')} AS score,
         {_clean('grade')} AS grade, {_iso_slash('grade_date')} AS grade_date, {_iso_slash('record_date')} AS rec, {_clean('violation_code')} AS code, {_clean('violation_description')} AS descr, {_clean('critical_flag')} AS flag
  FROM nyc_sample_display),
judged AS (
  SELECT *, CASE WHEN camis IS NULL OR NOT regexp_matches(camis, '^[0-9]+$') THEN 'invalid_camis' WHEN day IS NULL THEN 'unparseable_date' WHEN day = DATE '1900-01-01' THEN 'placeholder_date' END AS reject,
         'nyc:' || camis || ':' || strftime(day, '%Y-%m-%d') || ':' || kind AS id FROM typed),
kept AS (SELECT * FROM judged WHERE reject IS NULL),
v AS (
  SELECT * FROM (SELECT id, lower({_squeeze('code')}) AS code_norm, lower({_squeeze('descr')}) AS descr_norm, flag,
           row_number() OVER (PARTITION BY id, lower({_squeeze('code')}), coalesce(lower({_squeeze('descr')}), '') ORDER BY rec DESC NULLS LAST, coalesce(flag, '')) AS rn FROM kept WHERE code IS NOT NULL) WHERE rn = 1)"""


def _resolved(field: str, source: str, rows: str, key: str, recency: str) -> str:
    """CTE ``r_<field>``: key, value, conflict, values."""
    return f"""
p_{field} AS (SELECT {key} AS k, {source} AS v, max({recency}) AS t FROM {rows} WHERE {source} IS NOT NULL GROUP BY 1, 2),
l_{field} AS (SELECT k, max(t) AS latest FROM p_{field} GROUP BY 1),
r_{field} AS (
  SELECT p.k, CASE WHEN count(*) = 1 THEN max(p.v) WHEN count(*) FILTER (WHERE p.t = l.latest) = 1 THEN max(p.v) FILTER (WHERE p.t = l.latest) END AS value,
         count(*) > 1 AS conflict, CASE WHEN count(*) > 1 THEN list_sort(list(p.v)) END AS vals
  FROM p_{field} p JOIN l_{field} l ON p.k = l.k GROUP BY p.k)"""


_DIGEST = "'{0}' || substr(sha256({1}), 1, 32)"


# -- ingestion -----------------------------------------------------------------------------------------------------


def _nyc(spark: SparkSession, sf_dir: str):
    return ingest_nyc.build_events(table(spark, sf_dir, "nyc_sample_display"))


@query(f"""WITH {_NYC},{_resolved('score', 'score', 'kept', 'id', 'rec')},{_resolved('action', "CASE WHEN action <> 'Missing' THEN action END", 'kept', 'id', 'rec')},{_resolved('grade', 'grade', 'kept', 'id', 'rec')},
g AS (SELECT id, grade, max(grade_date) AS grade_date FROM kept WHERE grade IS NOT NULL AND grade_date IS NOT NULL GROUP BY 1, 2),
c AS (SELECT id, count(*)::INTEGER AS n, (count(*) FILTER (WHERE flag = 'Critical'))::INTEGER AS crit FROM v GROUP BY 1),
base AS (SELECT DISTINCT id, camis, day, kind FROM kept)
SELECT base.id AS inspection_id, 'nyc:' || camis AS restaurant_id, day AS inspection_date, kind AS inspection_type, s.value AS score, coalesce(s.conflict, false) AS score_conflict, s.vals AS score_conflict_values,
a.value AS action, coalesce(a.conflict, false) AS action_conflict, gr.value AS grade, coalesce(gr.conflict, false) AS grade_conflict, gr.vals AS grade_conflict_values, g.grade_date,
coalesce(c.n, 0)::INTEGER AS violation_count, coalesce(c.crit, 0)::INTEGER AS critical_violation_count, (SELECT max(rec) FROM typed) AS source_snapshot_date
FROM base LEFT JOIN r_score s ON s.k = base.id LEFT JOIN r_action a ON a.k = base.id LEFT JOIN r_grade gr ON gr.k = base.id LEFT JOIN g ON g.id = base.id AND g.grade = gr.value LEFT JOIN c ON c.id = base.id""")
def nyc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nyc(spark, sf_dir)[0].select("inspection_id", "restaurant_id", "inspection_date", "inspection_type", "score", "score_conflict", "score_conflict_values", "action", "action_conflict", "grade",
                                         "grade_conflict", "grade_conflict_values", "grade_date", "violation_count", "critical_violation_count", "source_snapshot_date")


@query(f"""WITH {_NYC} SELECT {_DIGEST.format('nyc:v:', "id || chr(31) || code_norm || chr(31) || coalesce(descr_norm, '')")} AS violation_event_id, id AS inspection_id, code_norm AS violation_code_norm, descr_norm AS violation_description_norm,
CASE flag WHEN 'Critical' THEN 'critical' WHEN 'Not Critical' THEN 'noncritical' WHEN 'Not Applicable' THEN 'not_applicable' ELSE 'unknown' END AS severity FROM v""")
def nyc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nyc(spark, sf_dir)[1].select("violation_event_id", "inspection_id", "violation_code_norm", "violation_description_norm", "severity")


@query(f"WITH {_NYC} SELECT coalesce(reject, 'kept') AS outcome, count(*) AS rows FROM judged GROUP BY 1")
def nyc_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nyc(spark, sf_dir)[2]


_CATS = [f"violation_{i:02d}" for i in range(1, 59)]
_FLN = ["total_violations", "high_priority_count", "intermediate_count", "basic_count", "visit_number", *_CATS]
_FLT = ["license_type_code", "license_number", "inspection_number", "inspection_class", "inspection_type", "inspection_disposition", "inspection_visit_id"]
_MATERIAL = ["license_number", "inspection_number", "visit_number", "inspection_class", "inspection_type", "inspection_disposition", "day", *_FLN[:4], *_CATS]
_DISPOSITION = "CASE translate(inspection_disposition, '–—', '--') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest_florida.DISPOSITIONS.items()) + " ELSE 'unknown' END"
_FLORIDA = f"""
typed AS (SELECT {', '.join(f'{_clean(c)} AS {c}' for c in _FLT)}, {', '.join(f'{_count(c)} AS {c}' for c in _FLN)}, {_slash_iso('inspection_date')} AS day,
  {' OR '.join(f'({_clean(c)} IS NOT NULL AND ({_count(c)}) IS NULL)' for c in _FLN)} AS malformed FROM fl_sample_current),
judged AS (SELECT *, CASE WHEN NOT coalesce(lower(inspection_class) = 'food' AND license_type_code IN ('2010','2012','2013','2014','2015','2016'), false) THEN 'out_of_scope' WHEN license_number IS NULL THEN 'missing_license'
  WHEN inspection_visit_id IS NULL THEN 'missing_visit_id' WHEN inspection_number IS NULL OR visit_number IS NULL THEN 'invalid_identity' WHEN day IS NULL THEN 'unparseable_date' END AS reject FROM typed),
signed AS (SELECT *, md5({" || '|' || ".join(f"coalesce({c}::VARCHAR, '~')" for c in _MATERIAL)}) AS sig FROM judged WHERE reject IS NULL),
per AS (SELECT inspection_visit_id AS vid, count(*) AS n, count(DISTINCT sig) AS sigs FROM signed GROUP BY 1),
visits AS (SELECT * EXCLUDE (rn) FROM (SELECT s.*, row_number() OVER (PARTITION BY inspection_visit_id ORDER BY malformed) AS rn FROM signed s JOIN per ON per.vid = s.inspection_visit_id WHERE sigs = 1) WHERE rn = 1)"""


def _florida(spark: SparkSession, sf_dir: str):
    return ingest_florida.build_events(table(spark, sf_dir, "fl_sample_current"))


def _visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ingest_florida.deduplicated(checkpoint(ingest_florida.staged(table(spark, sf_dir, "fl_sample_current"))).where("reject IS NULL"))


@query(f"""WITH {_FLORIDA} SELECT 'florida:' || inspection_visit_id AS inspection_id, 'florida:' || license_number AS restaurant_id, day AS inspection_date, inspection_type, total_violations AS violation_count,
high_priority_count, intermediate_count, basic_count, {_DISPOSITION} AS disposition_status, inspection_number AS native_inspection_group_id, visit_number AS native_visit_sequence FROM visits""")
def florida_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _florida(spark, sf_dir)[0].select("inspection_id", "restaurant_id", "inspection_date", "inspection_type", "violation_count", "high_priority_count", "intermediate_count", "basic_count", "disposition_status",
                                             "native_inspection_group_id", "native_visit_sequence")


@query(f"""WITH {_FLORIDA}, long AS ({' UNION ALL '.join(f"SELECT inspection_visit_id, '{c[-2:]}' AS code, {c} AS n FROM visits" for c in _CATS)})
SELECT {_DIGEST.format('florida:v:', "'florida:' || inspection_visit_id || chr(31) || code")} AS violation_event_id, 'florida:' || inspection_visit_id AS inspection_id, code AS violation_code, n AS count FROM long WHERE n > 0""")
def florida_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _florida(spark, sf_dir)[1].select("violation_event_id", "inspection_id", "violation_code", "count")


@query(f"WITH {_FLORIDA} SELECT coalesce(reject, 'kept') AS outcome, count(*) AS rows FROM judged GROUP BY 1")
def florida_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _florida(spark, sf_dir)[2]


@query(f"WITH {_FLORIDA} SELECT vid AS inspection_visit_id, n AS rows FROM per WHERE sigs > 1")
def florida_conflicting_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir)[1]


@query(f"""WITH {_FLORIDA} SELECT count(*) AS visits, count(*) FILTER (WHERE total_violations <> high_priority_count + intermediate_count + basic_count) AS total_differs_from_priorities,
count(*) FILTER (WHERE total_violations <> {' + '.join(_CATS)}) AS total_differs_from_categories, count(*) FILTER (WHERE {_DISPOSITION} = 'unknown') AS unknown_dispositions FROM visits""")
def florida_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_florida.reconciliation(_visits(spark, sf_dir)[0]).drop("malformed_rows")


_AWARDS = f"""
c AS (SELECT seed_row_no, {', '.join(f'{_clean(f"{x}::VARCHAR")} AS {x}' for x in [*awards.REQUIRED, *awards.OPTIONAL])} FROM michelin_seed_valid),
d AS (SELECT * REPLACE (CASE WHEN regexp_matches(source_access_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(source_access_date, '%Y-%m-%d')::DATE END AS source_access_date),
  announced_date AS raw_announced, CASE WHEN regexp_matches(announced_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(announced_date, '%Y-%m-%d')::DATE END AS ann, try_cast(guide_year AS INTEGER) AS yr FROM c),
j AS (SELECT *, CASE WHEN name_as_published IS NULL OR city IS NULL OR region IS NULL OR guide_name IS NULL THEN 'missing_required_field'
  WHEN jurisdiction_candidate IS NULL OR jurisdiction_candidate NOT IN ('nyc', 'florida') THEN 'missing_jurisdiction_candidate'
  WHEN distinction IS NULL OR distinction NOT IN ({', '.join(f"'{x}'" for x in awards.DISTINCTIONS)}) THEN 'unsupported_distinction'
  WHEN provenance_confidence IS NULL OR provenance_confidence NOT IN ('verified_primary', 'verified_secondary') THEN 'invalid_provenance_confidence'
  WHEN source_url IS NULL OR source_title IS NULL OR source_publisher IS NULL OR source_license_note IS NULL THEN 'missing_provenance'
  WHEN yr IS NULL THEN 'malformed_guide_year' WHEN source_access_date IS NULL THEN 'missing_provenance' WHEN raw_announced IS NOT NULL AND ann IS NULL THEN 'malformed_announced_date' END AS reject FROM d)"""


def _awards(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return awards.build(table(spark, sf_dir, "michelin_seed_valid"), "seed_row_no")


@query(f"WITH {_AWARDS} SELECT reject, count(*) AS rows FROM j WHERE reject IS NOT NULL GROUP BY 1")
def award_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _awards(spark, sf_dir)["rejected"]


@query()
def award_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _awards(spark, sf_dir)["restaurants"]


@query()
def award_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _awards(spark, sf_dir)["events"]


@query()
def award_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _awards(spark, sf_dir)["conflicts"]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN v1 WHEN at_latest = 1 THEN vl END AS quantity, n > 1 AS quantity_conflict, CASE WHEN n > 1 THEN vals END AS quantity_conflict_values FROM (
  SELECT p.l_orderkey, p.l_linenumber, count(*) AS n, max(q) AS v1, count(*) FILTER (WHERE t = latest) AS at_latest, max(q) FILTER (WHERE t = latest) AS vl, list_sort(list(q)) AS vals
  FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, max(l_shipdate) AS t FROM lineitem GROUP BY 1, 2, 3) p
  JOIN (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS latest FROM lineitem GROUP BY 1, 2) l ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber GROUP BY 1, 2)""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity")}, "l_shipdate")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_quantity, l_extendedprice, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resolve.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.asc("l_quantity"), F.asc("l_extendedprice"), F.asc("l_partkey")])
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# -- history -------------------------------------------------------------------------------------------------------


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nyc_sample_expected").withColumn("restaurant_id", plain_id(F.col("restaurant_id"))).where("restaurant_id IS NOT NULL AND inspection_date IS NOT NULL").withColumn("jurisdiction", F.lit("nyc"))


_EXPECTED = "e AS (SELECT * REPLACE (nullif(regexp_replace(regexp_replace(lower(restaurant_id), '\\s+', '', 'g'), '(^|:)0+([0-9]+)$', '\\1\\2'), '') AS restaurant_id) FROM nyc_sample_expected), x AS (SELECT * FROM e WHERE restaurant_id IS NOT NULL AND inspection_date IS NOT NULL)"
_DAYS = f"""{_EXPECTED},
s AS (SELECT restaurant_id AS entity, inspection_date AS day, critical_violation_count::DOUBLE AS c, CASE WHEN coalesce(score_conflict, false) THEN NULL ELSE score END AS s FROM x),
days AS (SELECT entity, day, count(*) AS events, CASE WHEN count(c) = count(*) THEN sum(c) END AS critical, CASE WHEN count(s) = count(*) AND min(round(s, 9)) = max(round(s, 9)) THEN min(s) END AS score,
  count(s) < count(*) AS score_incomplete, count(s) = count(*) AND min(round(s, 9)) <> max(round(s, 9)) AS score_disagree FROM s GROUP BY 1, 2),
m AS (SELECT *, (round(score * 100))::BIGINT AS v, CASE WHEN score IS NOT NULL THEN (day - DATE '1970-01-01')::BIGINT END AS xx, (round(critical * 100))::BIGINT AS cv FROM days)"""
_SUMS = "count(v) {w} AS n, sum(v) {w} AS sv, sum(v * v) {w} AS svv, sum(xx) {w} AS sx, sum(xx * xx) {w} AS sxx, sum(xx * v) {w} AS sxv, max(score) {w} AS mx"
_STATS = """n AS score_days, sv::DOUBLE / n / 100 AS score_mean, mx AS score_max,
CASE WHEN n >= 2 THEN greatest(0.0, (n * svv - sv * sv)::DOUBLE / (n * (n - 1)) / 10000) END AS score_variance,
CASE WHEN n >= 3 AND n * sxx - sx * sx > 0 THEN (n * sxv - sx * sv)::DOUBLE / (n * sxx - sx * sx)::DOUBLE / 100 * 365.0 END AS score_trend"""


@query(f"""WITH {_DAYS}, w AS (SELECT entity, day, coalesce(sum(events) OVER b, 0)::BIGINT AS history_depth, count(*) OVER b AS prior_days, day - lag(day) OVER o AS days_since_previous, lag(score) OVER o AS score_previous,
  coalesce(lag(score IS NOT NULL) OVER o, false) AS score_previous_complete, sum(cv) OVER b / 100.0 AS critical_sum, {_SUMS.format(w='OVER b')}
  FROM m WINDOW b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY entity ORDER BY day))
SELECT entity, day, history_depth, prior_days, days_since_previous::INTEGER AS days_since_previous, history_depth = 0 AS missing_history, score_previous, score_previous_complete, critical_sum::DOUBLE AS critical_sum, {_STATS} FROM w""")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.history_features(tables.day_table(_expected(spark, sf_dir), "nyc"), ["score", "critical"])
    return f.select("entity", "day", "history_depth", "prior_days", "days_since_previous", "missing_history", "score_previous", "score_previous_complete", "critical_sum", "score_days", "score_mean", "score_max", "score_variance", "score_trend")


@query(f"""WITH {_DAYS}, g AS (SELECT entity, sum(events) AS e, count(*) AS d, max(day) AS last_day, {_SUMS.format(w='')} FROM m WHERE day < DATE '2024-07-01' GROUP BY 1), k AS (SELECT DISTINCT entity FROM days)
SELECT k.entity, coalesce(e, 0)::BIGINT AS history_depth, coalesce(d, 0) AS prior_days, (DATE '2024-07-01' - last_day)::INTEGER AS days_since_previous, coalesce(e, 0) = 0 AS missing_history,
coalesce(n, 0) AS score_days, CASE WHEN n > 0 THEN sv::DOUBLE / n / 100 END AS score_mean, mx AS score_max, CASE WHEN n >= 2 THEN greatest(0.0, (n * svv - sv * sv)::DOUBLE / (n * (n - 1)) / 10000) END AS score_variance,
CASE WHEN n >= 3 AND n * sxx - sx * sx > 0 THEN (n * sxv - sx * sv)::DOUBLE / (n * sxx - sx * sx)::DOUBLE / 100 * 365.0 END AS score_trend FROM k LEFT JOIN g ON g.entity = k.entity""")
def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.day_table(_expected(spark, sf_dir), "nyc")
    f = history.state_as_of(days, days, ["score"], "2024-07-01")
    return f.select("entity", "history_depth", "prior_days", "days_since_previous", "missing_history", "score_days", "score_mean", "score_max", "score_variance", "score_trend")


@query(f"WITH {_DAYS} SELECT count(*) AS days, count(*) FILTER (WHERE score_incomplete) AS incomplete, count(*) FILTER (WHERE score_disagree) AS disagree FROM days")
def same_day_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.day_table(_expected(spark, sf_dir), "nyc")
    return d.agg(F.count("*").alias("days"), F.count_if("score_incomplete").alias("incomplete"), F.count_if("score_disagree").alias("disagree"))


_CODES = """v AS (SELECT o.o_custkey AS entity, o.o_orderdate::DATE AS vday, l_returnflag || l_linestatus AS code, l.l_orderkey AS insp, l_quantity::BIGINT AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
real AS (SELECT DISTINCT o_custkey AS entity, o_orderdate::DATE AS day FROM orders),
byc AS (SELECT r.entity, r.day, code, sum(n) AS n, count(DISTINCT insp) AS i FROM real r JOIN v ON v.entity = r.entity AND v.vday < r.day GROUP BY 1, 2, 3),
tot AS (SELECT r.entity, r.day, count(DISTINCT insp) AS i FROM real r JOIN v ON v.entity = r.entity AND v.vday < r.day GROUP BY 1, 2),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY n DESC, i DESC, code) AS rn FROM byc) WHERE rn = 1),
s AS (SELECT entity, day, sum(n)::BIGINT AS prior_citations, count(*) AS prior_codes FROM byc GROUP BY 1, 2)"""


@query(f"""WITH {_CODES} SELECT r.entity, r.day, s.prior_citations, tot.i AS prior_inspections, s.prior_codes, lead.code AS top_code, lead.n::BIGINT AS top_code_citations, lead.i AS top_code_inspections
FROM real r LEFT JOIN s ON s.entity = r.entity AND s.day = r.day LEFT JOIN tot ON tot.entity = r.entity AND tot.day = r.day LEFT JOIN lead ON lead.entity = r.entity AND lead.day = r.day""")
def prior_top_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))
    v = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("code", F.concat("l_returnflag", "l_linestatus"))
    return history.code_history(o, v, entity="entity", day="day", inspection="l_orderkey", code="code", count="l_quantity")


@query(f"""WITH {_EXPECTED} SELECT restaurant_id AS entity, inspection_date AS day, CASE WHEN min(g) = max(g) THEN min(g) END AS value FROM (SELECT *, CASE WHEN grade <> '' AND NOT coalesce(grade_conflict, false) THEN grade END AS g FROM x) GROUP BY 1, 2""")
def trusted_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trusted_value(_expected(spark, sf_dir), "restaurant_id", "inspection_date", "grade", "grade_conflict")


# -- restaurants and serving ---------------------------------------------------------------------------------------


@query(f"WITH {_EXPECTED} SELECT restaurant_id, inspection_date, count(*) AS rows FROM (SELECT *, rank() OVER (PARTITION BY restaurant_id ORDER BY inspection_date DESC) AS r FROM x) WHERE r = 1 GROUP BY 1, 2")
def latest_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_rows(_expected(spark, sf_dir), "restaurant_id", "inspection_date").groupBy("restaurant_id", "inspection_date").agg(F.count("*").alias("rows"))


@query(f"""WITH {_EXPECTED} SELECT restaurant_id, inspection_date, event_no, same_day FROM (SELECT *, count(*) OVER (PARTITION BY restaurant_id, inspection_date) AS same_day,
row_number() OVER (PARTITION BY restaurant_id ORDER BY inspection_date DESC, event_no DESC) AS r FROM x) WHERE r = 1""")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_with_ties(_expected(spark, sf_dir), "restaurant_id", "inspection_date", "event_no").select("restaurant_id", "inspection_date", "event_no", "same_day")


_REST = "q AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(restaurant_id), '\\s+', '', 'g'), '(^|:)0+([0-9]+)$', '\\1\\2'), '') AS id FROM restaurants), x AS (SELECT * FROM q WHERE id IS NOT NULL)"


def _restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "restaurants").withColumn("id", plain_id(F.col("restaurant_id"))).where("id IS NOT NULL")


@query(f"""WITH {_REST}, l AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY source_snapshot_date DESC) AS r FROM x) WHERE r = 1)
SELECT * FROM (SELECT id, 'name' AS field, list_sort(list(DISTINCT name)) AS values FROM l WHERE name IS NOT NULL GROUP BY 1 UNION ALL SELECT id, 'address', list_sort(list(DISTINCT address)) FROM l WHERE address IS NOT NULL GROUP BY 1) WHERE len(values) > 1""")
def latest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.field_conflicts(serving.latest_rows(_restaurants(spark, sf_dir), "id", "source_snapshot_date"), "id", ["name", "address"])


@query("SELECT record_no, normalized_name FROM restaurants WHERE contains(normalized_name, 'cafe') ORDER BY normalized_name, record_no LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_page(table(spark, sf_dir, "restaurants"), name="normalized_name", key="record_no", query="cafe", limit=20, offset=20)[0].select("record_no", "normalized_name")


def _match_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "restaurant_michelin_matches").select(plain_id(F.col("official_restaurant_id")).alias("restaurant_id"), plain_id(F.col("michelin_restaurant_id")).alias("award_id"), "decision")
    e = table(spark, sf_dir, "michelin_seed_valid").select(plain_id(F.col("michelin_restaurant_id")).alias("award_id"), ps.clean(F.col("guide_year").cast("string")).try_cast("int").alias("guide_year"), "distinction")
    return m.where("restaurant_id IS NOT NULL AND award_id IS NOT NULL").distinct(), e.where("award_id IS NOT NULL AND guide_year IS NOT NULL AND distinction IS NOT NULL").distinct()


_PLAIN = "nullif(regexp_replace(regexp_replace(lower({0}), '\\s+', '', 'g'), '(^|:)0+([0-9]+)$', '\\1\\2'), '')"
_MATCH = f"""m AS (SELECT DISTINCT {_PLAIN.format('official_restaurant_id')} AS restaurant_id, {_PLAIN.format('michelin_restaurant_id')} AS award_id, decision FROM restaurant_michelin_matches),
e AS (SELECT DISTINCT {_PLAIN.format('michelin_restaurant_id')} AS award_id, try_cast(trim(guide_year::VARCHAR) AS INTEGER) AS guide_year, distinction FROM michelin_seed_valid),
mm AS (SELECT * FROM m WHERE restaurant_id IS NOT NULL AND award_id IS NOT NULL), ee AS (SELECT * FROM e WHERE award_id IS NOT NULL AND guide_year IS NOT NULL AND distinction IS NOT NULL),
le AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY award_id ORDER BY guide_year DESC) AS r FROM ee) WHERE r = 1)"""


@query(f"WITH {_MATCH} SELECT DISTINCT restaurant_id FROM mm JOIN le ON le.award_id = mm.award_id WHERE decision = 'accept' AND distinction = 'bib_gourmand'")
def award_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _match_tables(spark, sf_dir)
    return serving.award_filter(m, e, category="bib_gourmand", latest_only=True)


@query(f"WITH {_MATCH} SELECT restaurant_id, mm.award_id, guide_year, distinction FROM mm JOIN ee ON ee.award_id = mm.award_id WHERE decision = 'accept'")
def award_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.award_history(*_match_tables(spark, sf_dir))


@query(f"WITH {_MATCH} SELECT award_id, max(guide_year) AS guide_year, list_sort(list(DISTINCT distinction)) AS distinctions FROM le GROUP BY 1")
def latest_distinctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_distinctions(_match_tables(spark, sf_dir)[1])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_prediction(table(spark, sf_dir, "orders"), as_of="o_orderdate", generated="o_totalprice", key="o_orderkey", entity="o_custkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, r_name FROM region")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return serving.upsert(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), ["k"])


@query("SELECT 'jurisdiction:' || jurisdiction AS item, true AS ok, count(*) AS rows FROM restaurants GROUP BY jurisdiction UNION ALL SELECT 'table:restaurants', true, NULL UNION ALL SELECT 'table:predictions', false, NULL")
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "restaurants")
    return serving.health(r, {"restaurants": r, "predictions": None})


# -- scalar functions ----------------------------------------------------------------------------------------------

#: What compatibility decomposition and case folding make of characters that SQL leaves alone; fixed values.
_COMPATIBLE = {
    "ª": "a", "º": "o", "¹": "1", "²": "2", "³": "3", "¼": "1 4", "½": "1 2", "¾": "3 4", "™": "tm", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "ˆ": " ",
}


def _normal(c: str) -> str:
    for a, b in _COMPATIBLE.items():
        c = f"replace({c}, '{a}', '{b}')"
    spaced = f"regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, ' +', ' ', 'g'))"


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _bare(c: str) -> str:
    return f"array_to_string(list_filter(string_split({_normal(c)}, ' '), lambda x: x NOT IN ({_sql_list(nm.LEGAL)})), ' ')"


_SHORT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (nm.SUFFIXES | nm.DIRECTIONS).items()) + "}"


def _short_address(c: str) -> str:
    body = _normal(f"regexp_replace({_clean(c)}, '(?i){nm.UNIT}', ' ', 'g')")
    return f"array_to_string(list_transform(string_split({body}, ' '), lambda x: coalesce({_SHORT}[x], x)), ' ')"


def _telling(name: str) -> str:
    words = f"list_distinct(list_filter(string_split({name}, ' '), lambda x: x <> ''))"
    kept = f"list_filter({words}, lambda x: x NOT IN ({_sql_list(nm.COMMON)}) AND length(x) > 1)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END"


@query(f"SELECT record_no, {_normal('name')} AS normal, {_bare('name')} AS bare FROM restaurants WHERE name IS NOT NULL")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every name, with and without legal forms."""
    r = table(spark, sf_dir, "restaurants").where(F.col("name").isNotNull())
    return r.select("record_no", nm.normal_text(F.col("name")).alias("normal"), nm.normal_name(F.col("name")).alias("bare"))


@query("SELECT record_no, CASE WHEN len(d) >= 5 THEN substr(d, 1, 5) END AS zip5, CASE WHEN len(d) >= 9 THEN substr(d, 6, 4) END AS plus4 FROM (SELECT record_no, regexp_replace(postal_code, '\\D', '', 'g') AS d FROM restaurants)")
def zip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = nm.zip_parts(F.col("postal_code"))
    return table(spark, sf_dir, "restaurants").select("record_no", z["zip5"].alias("zip5"), z["plus4"].alias("plus4"))


@query(f"""SELECT record_no, {_short_address('address')} AS normal, lower({_squeeze(f"nullif(regexp_extract({_clean('address')}, '(?i){nm.UNIT}'), '')")}) AS unit,
nullif(regexp_extract({_short_address('address')}, '^(\\d+)\\b', 1), '') AS number, list_sort({_telling("coalesce(normalized_name, '')")}) AS tokens FROM restaurants""")
def normal_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nm.normal_address(F.col("address"))
    tokens = F.array_sort(nm.telling_tokens(F.coalesce("normalized_name", F.lit(""))))
    return table(spark, sf_dir, "restaurants").select("record_no", a["normal"].alias("normal"), a["unit"].alias("unit"), nm.street_number(a["normal"]).alias("number"), tokens.alias("tokens"))


@query(f"SELECT event_no, {_DIGEST.format('pred:', 'coalesce(inspection_id, chr(32)) || chr(31) || event_no::VARCHAR')} AS id FROM nyc_sample_expected WHERE inspection_id IS NOT NULL")
def digest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nyc_sample_expected").where("inspection_id IS NOT NULL").select("event_no", digest("pred:", F.col("inspection_id"), F.col("event_no")).alias("id"))


@query("SELECT event_no, CASE WHEN month(inspection_date) IN (12, 1, 2) THEN 'winter' WHEN month(inspection_date) <= 5 THEN 'spring' WHEN month(inspection_date) <= 8 THEN 'summer' WHEN month(inspection_date) <= 11 THEN 'fall' END AS season FROM nyc_sample_expected")
def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nyc_sample_expected").select("event_no", nm.season(F.month("inspection_date")).alias("season"))


@query("""SELECT record_no, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(40.7 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.7)) * pow(sin(radians(-74.0 - longitude) / 2), 2)))), 3) AS km FROM restaurants WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "restaurants").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return r.select("record_no", F.round(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(40.7), F.lit(-74.0)), 3).alias("km"))


@query(f"SELECT inspection_visit_id AS id, {_slash_iso('inspection_date')} AS day, {_count('total_violations')} AS total, coalesce({_clean('total_violations')} IS NOT NULL AND ({_count('total_violations')}) IS NULL, false) AS bad FROM fl_sample_current")
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fl_sample_current").select(F.col("inspection_visit_id").alias("id"), ps.slash_or_iso_date(F.col("inspection_date")).alias("day"), ps.count_value(F.col("total_violations")).alias("total"), ps.count_malformed(F.col("total_violations")).alias("bad"))


@query()
def display_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "restaurants").select("record_no", nm.search_link(F.col("name"), F.col("address"), F.col("city"), F.col("region")).alias("link"), nm.safe_https(F.col("source_url")).alias("safe"))


# -- matching ------------------------------------------------------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides as published, with their normal forms and numeric coordinates."""
    def side(df: DataFrame, key: str, jurisdiction: str, name: str, address: str, *more: Column) -> DataFrame:
        num = lambda c: F.col(c).try_cast("double").alias(c)
        return df.select(
            F.col(key).cast("string").alias("id"), F.col(jurisdiction).alias("jurisdiction"), F.col(name).alias("name_as_published"), F.col(address).alias("address_as_published"),
            nm.normal_name(F.col(name)).alias("normalized_name"), nm.normal_address(F.col(address))["normal"].alias("normalized_address"), ps.clean(F.col("city")).alias("city"),
            nm.zip_parts(F.col("postal_code"))["zip5"].alias("postal_code"), num("latitude"), num("longitude"), *more)

    note = F.col("source_row_ref").alias("identity_source_note")
    return (side(table(spark, sf_dir, "restaurants"), "record_no", "jurisdiction", "name", "address"),
            side(table(spark, sf_dir, "michelin_seed_valid"), "seed_row_no", "jurisdiction_candidate", "name_as_published", "address_as_published", note))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(d.withColumnRenamed("normalized_name", "name").withColumnRenamed("normalized_address", "address") for d in _published(spark, sf_dir))


def _side_sql(key: str, jurisdiction: str, name: str, address: str, source: str) -> str:
    return f"""SELECT {key}::VARCHAR AS id, {jurisdiction} AS j, {_bare(name)} AS name, {_short_address(address)} AS address, nullif({_normal(_clean('city'))}, '') AS city,
CASE WHEN len(regexp_replace(postal_code, '\\D', '', 'g')) >= 5 THEN substr(regexp_replace(postal_code, '\\D', '', 'g'), 1, 5) END AS zip,
try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon FROM {source}"""


_BLOCKS = f"""
a0 AS ({_side_sql('record_no', 'jurisdiction', 'name', 'address', 'restaurants')}),
b0 AS ({_side_sql('seed_row_no', 'jurisdiction_candidate', 'name_as_published', 'address_as_published', 'michelin_seed_valid')}),
a AS (SELECT *, nullif(regexp_extract(address, '^(\\d+)\\b', 1), '') AS num, {_telling('name')} AS tokens FROM a0),
b AS (SELECT *, nullif(regexp_extract(address, '^(\\d+)\\b', 1), '') AS num, {_telling('name')} AS tokens FROM b0),
met AS (
  SELECT a.id AS l, b.id AS r, 0 AS rule FROM a JOIN b ON a.j = b.j AND a.zip = b.zip
  UNION SELECT a.id, b.id, 1 FROM a JOIN b ON a.j = b.j AND a.city = b.city AND a.num = b.num
  UNION SELECT a.id, b.id, 2 FROM (SELECT id, j, city, unnest(tokens) AS t FROM a) a JOIN (SELECT id, j, city, unnest(tokens) AS t FROM b) b ON a.j = b.j AND a.city = b.city AND a.t = b.t
  UNION SELECT a.id, b.id, 3 FROM a JOIN b ON a.j = b.j AND abs(a.lat - b.lat) <= 0.02 WHERE NOT isnan(a.lat) AND NOT isnan(b.lat)
    AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 2.0)"""


@query(f"WITH {_BLOCKS} SELECT l AS left_id, r AS right_id, list_transform(list_sort(list(rule)), lambda i: [{_sql_list(matching.RULES)}][i + 1]) AS rules FROM met GROUP BY l, r")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidate_pairs(*_sides(spark, sf_dir))


@query()
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.decided_pairs(*_sides(spark, sf_dir)).select("left_id", "right_id", "rules", "name_similarity", "address_similarity", "overall_score", "decision", "conflicting_candidates", "required_evidence_missing", "conflicting_evidence")


@query()
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "michelin_seed_valid").select(F.col("seed_row_no").cast("string").alias("award_id"), "guide_year", "distinction")
    generated = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return matching.review_queue(matching.reviewable_pairs(*_sides(spark, sf_dir)), *_published(spark, sf_dir), e, version="1", generated_at=generated)


@query("SELECT id, pairs FROM (SELECT official_restaurant_id AS id, count(*) AS pairs FROM restaurant_michelin_matches WHERE decision = 'accept' GROUP BY 1 UNION ALL SELECT michelin_restaurant_id, count(*) FROM restaurant_michelin_matches WHERE decision = 'accept' GROUP BY 1) WHERE pairs > 1")
def not_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "restaurant_michelin_matches").select(F.col("official_restaurant_id").alias("left_id"), F.col("michelin_restaurant_id").alias("right_id"), "decision")
    return matching.not_one_to_one(m)


# -- targets and metrics -------------------------------------------------------------------------------------------

_TYPES = ", ".join(f"'{t}'" for t in evaluation.NYC_TYPES)


@query(f"SELECT event_no::VARCHAR AS inspection_id, (score >= 14)::TINYINT AS label FROM nyc_sample_expected WHERE inspection_type IN ({_TYPES}) AND NOT coalesce(score_conflict, false) AND score IS NOT NULL")
def nyc_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nyc_target(table(spark, sf_dir, "nyc_sample_expected").withColumn("inspection_id", F.col("event_no").cast("string")))[0]


@query(f"""WITH {_FLORIDA}, f AS (SELECT 'florida:' || inspection_visit_id AS inspection_id, *, {_DISPOSITION} AS st FROM visits), g AS (SELECT inspection_number AS i, count(*) AS n FROM f WHERE inspection_type = 'Routine - Food' AND visit_number = 1 GROUP BY 1)
SELECT inspection_id, (high_priority_count >= 1 OR st IN ('follow_up_required', 'temporary_closure'))::TINYINT AS label FROM f JOIN g ON g.i = f.inspection_number
WHERE inspection_type = 'Routine - Food' AND visit_number = 1 AND n = 1 AND high_priority_count IS NOT NULL AND st <> 'unknown'""")
def florida_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.florida_target(_florida(spark, sf_dir)[0])[0]


_SPLIT = ["2022-06-01", "2024-01-01", "2024-10-01", "2025-09-01"]


@query(f"""SELECT part, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives, count(*) FILTER (WHERE label = 1) / count(*) AS prevalence, min(day) AS first_day, max(day) AS last_day FROM (
SELECT inspection_date AS day, (score >= 14)::INTEGER AS label, CASE WHEN inspection_date < DATE '{_SPLIT[0]}' THEN 'before' WHEN inspection_date < DATE '{_SPLIT[1]}' THEN 'train' WHEN inspection_date < DATE '{_SPLIT[2]}' THEN 'validation'
WHEN inspection_date < DATE '{_SPLIT[3]}' THEN 'test' ELSE 'after' END AS part FROM nyc_sample_expected WHERE score IS NOT NULL AND inspection_date IS NOT NULL) GROUP BY 1""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nyc_sample_expected").where("score IS NOT NULL AND inspection_date IS NOT NULL").select(F.col("inspection_date").alias("day"), (F.col("score") >= 14).cast("int").alias("label"))
    return evaluation.part_summary(evaluation.chronological_split(e, "day", _SPLIT), "label", "day")


#: A deterministic score in sixteenths, so that sums are exact, against a label from another column.
_SCORED = "sc AS (SELECT o_orderkey AS k, o_orderpriority AS grp, (o_totalprice > 100000)::INTEGER AS label, ((o_orderkey * 7 + (o_totalprice > 150000)::INTEGER * 5) % 16) / 16.0::DOUBLE AS p FROM orders)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") > 100000).cast("int").alias("label"), (((F.col("o_orderkey") * 7 + (F.col("o_totalprice") > 150000).cast("int") * 5) % 16) / 16.0).alias("p"))


@query(f"""WITH {_SCORED}, t AS (SELECT grp, p, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (PARTITION BY grp ORDER BY p DESC))
SELECT grp, round(sum(pos * (cp / cn)) / sum(pos), 9) AS average_precision, round(1.0 - sum(pos * ((cn - cp) - (n - pos)) + pos * (n - pos) / 2.0) / (sum(pos) * sum(n - pos)), 9) AS roc_auc FROM c GROUP BY 1""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.average_precision(_scored(spark, sf_dir), "label", "p", ["grp"])
    return m.select("grp", F.round("average_precision", 9).alias("average_precision"), F.round("roc_auc", 9).alias("roc_auc"))


@query(f"WITH {_SCORED}, b AS (SELECT grp, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(label)) AS gap FROM sc GROUP BY 1, 2) SELECT grp, round(sum(n * gap) / sum(n), 9) AS calibration_error FROM b GROUP BY 1")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_error(_scored(spark, sf_dir), "label", "p", ["grp"]).withColumn("calibration_error", F.round("calibration_error", 9))


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, k) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM sc)
SELECT grp, (count(*) FILTER (WHERE label = 1 AND rn <= greatest(1, ceil(n * 0.1)))) / sum(label) AS top_decile_recall, max(greatest(1, ceil(n * 0.1)))::BIGINT AS top_decile_rows FROM r GROUP BY 1""")
def top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_decile(_scored(spark, sf_dir), "label", "p", "k", ["grp"])


@query(f"""WITH {_SCORED} SELECT grp, count(*) AS rows, sum(label)::BIGINT AS positives, avg((p - label) * (p - label)) AS brier, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp,
count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND label = 1) / count(*) FILTER (WHERE p >= 0.5) AS precision, count(*) FILTER (WHERE p >= 0.5 AND label = 1) / sum(label) AS recall FROM sc GROUP BY 1""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_metrics(_scored(spark, sf_dir), "label", "p", ["grp"]).drop("log_loss")


@query()
def subgroup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subgroup_report(_scored(spark, sf_dir), "label", "p", "grp")


@query(f"WITH {_SCORED} SELECT k, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'moderate' ELSE 'high' END AS band FROM sc")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("k", evaluation.risk_band(F.col("p")).alias("band"))


@query(f"WITH {_SCORED} SELECT grp, count(p) AS n, least(quantile_cont(p, 0.025::DOUBLE), 0.5) AS lower, greatest(quantile_cont(p, 0.975::DOUBLE), 0.5) AS upper FROM sc GROUP BY 1")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.interval(_scored(spark, sf_dir).withColumn("point", F.lit(0.5)), "grp", "p", "point")


# -- graph and questions -------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str):
    events, violations = (checkpoint(df) for df in _nyc(spark, sf_dir)[:2])
    return graph.build_graph(restaurants=tables.restaurants(events), inspections=events, violations=violations)


@query(f"""WITH {_NYC} SELECT 'node' AS what, 'inspection' AS type, count(DISTINCT id) AS n FROM kept UNION ALL SELECT 'node', 'violation_occurrence', count(*) FROM v UNION ALL SELECT 'node', 'violation_code', count(DISTINCT code_norm) FROM v
UNION ALL SELECT 'node', 'restaurant', count(DISTINCT camis) FROM kept UNION ALL SELECT 'edge', 'has_inspection', count(DISTINCT id) FROM kept UNION ALL SELECT 'edge', 'documented_violation', count(*) FROM v UNION ALL SELECT 'edge', 'uses_violation_code', count(*) FROM v""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph.counts(nodes, edges).where("type NOT IN ('cuisine', 'location', 'has_cuisine', 'located_in')")


@query()
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, conflicts = _graph(spark, sf_dir)
    return graph.dangling_edges(nodes, edges).agg(F.count("*").alias("dangling")).crossJoin(conflicts.agg(F.count("*").alias("conflicts")))  # one row each


@query(f"""WITH {_NYC} SELECT 'nyc:' || split_part(id, ':', 2) AS restaurant_id, code_norm AS violation_code_norm, count(*) AS occurrences, count(DISTINCT id) AS inspections, count(*) AS citations FROM v GROUP BY 1, 2 HAVING count(*) >= 2""")
def recurring_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurring_codes(_nyc(spark, sf_dir)[1]).select("restaurant_id", "violation_code_norm", "occurrences", "inspections", "citations")


@query(f"""WITH {_EXPECTED} SELECT restaurant_id, count(*) AS n, min(inspection_date) AS first_date, max(inspection_date) AS last_date FROM x GROUP BY 1 HAVING count(*) >= 2""")
def inspection_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trend(_expected(spark, sf_dir)).drop("change")


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{p}')" for p in questions.PROHIBITED) + " AS refused FROM documents WHERE text IS NOT NULL")
def prohibited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", questions.prohibited(F.col("text")).alias("refused"))


@query()
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'owner_qa'").select("doc_id", questions.intent(F.col("text")).alias("i")).select("doc_id", "i.outcome", "i.intent")


@query()
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return questions.tfidf_top(d.where("source = 'guidance_page'"), d.where("source = 'owner_qa'").select(F.col("doc_id").alias("question_id"), "text"), doc="doc_id", text="text", query="question_id", query_text="text", stop=questions.STOP)


# -- forms ---------------------------------------------------------------------------------------------------------


def _form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nyc_sample_display")
    return d.select(F.xxhash64("camis", "inspection_date", "violation_code", "violation_description").alias("doc"), F.concat(
        F.lit("City of New York\nCAMIS: "), F.coalesce("camis", F.lit("")), F.lit("   DBA: "), F.coalesce("dba", F.lit("")), F.lit("\nInspection Date: "), F.coalesce("inspection_date", F.lit("")), F.lit("\tScore: "), F.coalesce("score", F.lit("")),
        F.lit("\nViolation Code: "), F.coalesce("violation_code", F.lit("")), F.lit("\nDescription: "), F.coalesce("violation_description", F.lit("")), F.lit("\n"), F.coalesce("critical_flag", F.lit("")))
        .alias("text")).dropDuplicates(["doc"])


@query()
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.fields(_form_texts(spark, sf_dir), "doc", "text", forms.NYC_LABELS)


@query()
def form_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.draft_status(forms.fields(_form_texts(spark, sf_dir), "doc", "text", forms.NYC_LABELS), "doc", ["restaurant_name", "inspection_date", "score"])


@query()
def form_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.violation_rows(_form_texts(spark, sf_dir), "doc", "text")


@query("SELECT doc_id, CASE WHEN n AND NOT f THEN 'nyc' WHEN f AND NOT n THEN 'florida' END AS jurisdiction FROM (SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{m}')" for m in forms.MARKS["nyc"]) + " AS n, " + " OR ".join(f"contains(lower(text), '{m}')" for m in forms.MARKS["florida"]) + " AS f FROM documents)")
def text_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", forms.jurisdiction(F.col("text")).alias("jurisdiction"))
