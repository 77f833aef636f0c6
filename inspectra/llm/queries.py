"""Queries of the training-data problems over their whole tables, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions.keys import plain_id
from inspectra.llm import addresses, leakage, linkage, packing, spam, survivorship
from inspectra.operators.skew import broadcast_if_small, spread
from inspectra.session import table

SURVIVORS = [survivorship.Field("name"), survivorship.Field("address"), survivorship.Field("latest_inspection_date", "date")]


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = table(spark, sf_dir, "extract_sources").groupBy("source_filename").agg(F.max("trust_rank").alias("trust_rank"))
    records = table(spark, sf_dir, "restaurants").select(
        plain_id(F.col("restaurant_id")).alias("key"), "record_no", "name", "address", "latest_inspection_date", "source_snapshot_date", "source_filename")
    ranked = records.join(broadcast_if_small(trust), "source_filename", "left")
    return survivorship.surviving_values(ranked, key="key", record="record_no", fields=SURVIVORS, trust="trust_rank", snapshot="source_snapshot_date")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select(F.col("key").alias("restaurant_id"), "field_name", F.col("record").alias("record_no"))


def p2_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden_records(_survivors(spark, sf_dir), SURVIVORS).withColumnRenamed("key", "restaurant_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = addresses.same_place_pairs(table(spark, sf_dir, "address_records"), record="address_id", address="address", city="city", postal="postal_code")
    return pairs.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {"city": "city", "postal": "postal_code", "latitude": "latitude", "longitude": "longitude"}
    seeds = table(spark, sf_dir, "michelin_seed_valid").where("nullif(trim(michelin_restaurant_id), '') IS NULL")
    records = table(spark, sf_dir, "restaurants").withColumn("restaurant_id", plain_id(F.col("restaurant_id")))
    left = linkage.Source(seeds, ("seed_row_no",), name="name_as_published", address="address_as_published", **place)
    right = linkage.Source(records, ("record_no", "restaurant_id"), name="name", address="address", **place)
    return linkage.link(left, right, left_id="seed_row_no", right_id="record_no", entity="restaurant_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("seed_row_no", "restaurant_id")


def p4_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", packing.token_count(F.col("text")).alias("tokens"))
    return packing.pack(sized, table(spark, sf_dir, "pack_sizes"), item="doc_id", size="tokens", kind="container_kind", capacity="capacity_tokens")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "pack_sizes").select("container_kind", "capacity_tokens")
    return packing.filled(_packed(spark, sf_dir)).join(broadcast_if_small(sizes), "container_kind").withColumn("unused", F.col("capacity_tokens") - F.col("used"))


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id").withColumnRenamed("size", "tokens")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id")


def p9_spam_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", min_share=0.0)


QUERIES = {f.__name__: f for f in (p2_found, p2_golden_records, p3_found, p4_found, p4_confidences, p7_containers, p7_assignments, p8_found, p8_leaked_items, p9_found, p9_spam_shares)}

_UNKNOWN = ", ".join(f"'{x}'" for x in survivorship.UNKNOWN)
_BROKEN = survivorship.BROKEN
_TRIM = "regexp_replace({0}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_SURVIVE = f"""
records AS (
  SELECT record_no, nullif(regexp_replace(regexp_replace(lower(restaurant_id), '\\s+', '', 'g'), '(^|:)0+([0-9]+)$', '\\1\\2'), '') AS id, name, address,
         latest_inspection_date AS day, source_snapshot_date AS snap, coalesce(s.trust_rank, -1000000) AS trust
  FROM restaurants r LEFT JOIN extract_sources s ON r.source_filename = s.source_filename),
big AS (SELECT id FROM records WHERE id IS NOT NULL GROUP BY id HAVING count(*) >= 2),
texts AS (
  SELECT id, record_no, field_name, {_TRIM.format('v')} AS value, trust, snap FROM (
    SELECT id, record_no, trust, snap, 'name' AS field_name, name AS v FROM records UNION ALL SELECT id, record_no, trust, snap, 'address', address FROM records)
  WHERE id IN (SELECT id FROM big) AND regexp_matches({_TRIM.format('v')}, '[\\p{{L}}\\p{{N}}]') AND lower({_TRIM.format('v')}) NOT IN ({_UNKNOWN}) AND NOT regexp_matches(v, '{_BROKEN}')),
whole AS (
  SELECT * FROM texts a WHERE NOT EXISTS (
    SELECT 1 FROM texts b WHERE b.id = a.id AND b.field_name = a.field_name AND length(b.value) > length(a.value) AND starts_with(lower(b.value), lower(a.value)))),
ranked AS (
  SELECT id, field_name, record_no, value, row_number() OVER (PARTITION BY id, field_name ORDER BY trust DESC, snap DESC NULLS LAST, length(value) DESC, record_no) AS rn FROM whole
  UNION ALL
  SELECT id, 'latest_inspection_date', record_no, strftime(day, '%Y-%m-%d'), row_number() OVER (PARTITION BY id ORDER BY day DESC, trust DESC, record_no)
  FROM records WHERE id IN (SELECT id FROM big) AND day >= DATE '1990-01-01' AND day <= snap)"""

SQL = {
    "p2_found": f"WITH {_SURVIVE} SELECT id AS restaurant_id, field_name, record_no FROM ranked WHERE rn = 1",
    "p2_golden_records": f"""WITH {_SURVIVE} SELECT id AS restaurant_id,
max(value) FILTER (WHERE field_name = 'name') AS name, max(record_no) FILTER (WHERE field_name = 'name') AS name_record,
max(value) FILTER (WHERE field_name = 'address') AS address, max(record_no) FILTER (WHERE field_name = 'address') AS address_record,
max(value) FILTER (WHERE field_name = 'latest_inspection_date') AS latest_inspection_date, max(record_no) FILTER (WHERE field_name = 'latest_inspection_date') AS latest_inspection_date_record
FROM ranked WHERE rn = 1 GROUP BY id""",
}
