"""The guidance corpus: a manifest and documents with checksums, loaded whole or not at all, or audited finding by finding."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.sources.files import safe_path

PASSAGE = "document_id string, jurisdiction string, passage_id string, section_locator string, text string, sha256 string, applicable_violation_codes array<string>, topics array<string>, permitted_uses array<string>, superseded boolean"
MAX_BYTES = 5_000_000


def audit(spark: SparkSession, manifest_path: str, hosts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(passages, findings)``: every violated rule as ``(document_id, passage_id, problem)``.

    Files are looked at on the driver (a manifest is small and bounded); passages are checked as a plan.
    """
    findings, rows = [], []
    base = os.path.dirname(manifest_path)
    with open(manifest_path, encoding="utf-8") as f:
        manifest = json.load(f)
    for entry in manifest.get("documents", manifest if isinstance(manifest, list) else []):
        doc = entry.get("document_id")
        url = entry.get("source_url", "")
        host = url.split("/")[2] if url.startswith("https://") and url.count("/") >= 2 else ""
        if not host or "@" in host or (hosts is not None and host not in hosts):
            findings.append((doc, None, "unofficial_url"))
        try:
            path = safe_path(base, entry.get("file", ""))
            if os.path.getsize(path) > MAX_BYTES:
                raise ValueError("too large")
            with open(path, "rb") as f:
                data = f.read()
        except (OSError, ValueError):
            findings.append((doc, None, "unreadable_file"))
            continue
        if hashlib.sha256(data).hexdigest() != entry.get("sha256"):
            findings.append((doc, None, "document_checksum"))
        content = json.loads(data)
        if content.get("jurisdiction") != entry.get("jurisdiction"):
            findings.append((doc, None, "jurisdiction_differs"))
        rows += [(doc, entry.get("jurisdiction"), p.get("passage_id"), p.get("section_locator"), p.get("text"), p.get("sha256"), p.get("applicable_violation_codes") or [], p.get("topics") or [], p.get("permitted_uses") or [], bool(entry.get("superseded"))) for p in content.get("passages", [])]
    passages = spark.createDataFrame(rows, PASSAGE)
    wrong = lambda where, name: passages.where(where).select("document_id", "passage_id", F.lit(name).alias("problem"))
    twice = passages.groupBy("passage_id").agg(F.first("document_id").alias("document_id"), F.count("*").alias("n")).where("n > 1").select("document_id", "passage_id", F.lit("passage_twice").alias("problem"))
    found = spark.createDataFrame(findings, "document_id string, passage_id string, problem string")
    return passages, found.unionByName(wrong(~F.sha2("text", 256).eqNullSafe(F.col("sha256")), "passage_checksum")).unionByName(wrong(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text")).unionByName(twice)


def load(spark: SparkSession, manifest_path: str, hosts: list[str] | None = None) -> tuple[str, DataFrame | None]:
    """``(outcome, passages)``: loaded, absent (no manifest) or invalid; one finding rejects all."""
    if not os.path.exists(manifest_path):
        return "absent", None
    try:
        passages, findings = audit(spark, manifest_path, hosts)
    except (ValueError, KeyError, TypeError):
        return "invalid", None
    return ("invalid", None) if findings.limit(1).count() else ("loaded", passages)
