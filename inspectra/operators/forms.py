"""Fields and violations read off the text of inspection forms by labels, without guessing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of the fields, and marks of the issuing offices.
NYC_LABELS = {"camis": ["CAMIS"], "restaurant_name": ["Restaurant Name", "Establishment", "DBA"], "inspection_date": ["Inspection Date"], "inspection_type": ["Inspection Type"], "score": ["Score"], "grade": ["Grade"]}
FLORIDA_LABELS = {
    "license_number": ["License Number"], "inspection_visit_id": ["Inspection Visit ID"], "restaurant_name": ["Restaurant Name", "Establishment"], "inspection_date": ["Inspection Date"], "inspection_type": ["Inspection Type"],
    "visit_sequence": ["Visit Sequence"], "high_priority_count": ["High Priority"], "intermediate_count": ["Intermediate"], "basic_count": ["Basic"], "disposition_status": ["Disposition"], "correction_deadline": ["Correction Deadline", "Callback Date"]}
MARKS = {"nyc": ["department of health and mental hygiene", "dohmh", "city of new york"], "florida": ["division of hotels and restaurants", "dbpr", "department of business and professional regulation"]}


def jurisdiction(text: Column) -> Column:
    """The one office whose marks a text has; NULL for none or both."""
    has = lambda k: reduce(lambda a, m: a | F.contains(F.lower(text), F.lit(m)), MARKS[k], F.lit(False))
    nyc, fl = has("nyc"), has("florida")
    return F.when(nyc & ~fl, "nyc").when(fl & ~nyc, "florida")


def media_type(data: Column) -> Column:
    """PDF, PNG or JPEG by the first bytes of a binary column; NULL otherwise."""
    h = F.hex(F.substring(data, 1, 8))
    return F.when(h.startswith("255044462D"), "application/pdf").when(h == "89504E470D0A1A0A", "image/png").when(h.startswith("FFD8FF"), "image/jpeg")


#: Put behind a label, so that it is known again once the text is cut.
_MARK = "\x01"


def _any_of(labels: list[str]) -> str:
    return "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))


def segments(text: Column, labels: list[str]) -> Column:
    """The text cut before every label with a colon or hyphen and at line ends, tabs and wide gaps; labels carry a mark behind them.

    A label without a separator starts no new segment, so a value may hold such a word.
    """
    own_line = F.regexp_replace(text, rf"(?i)({_any_of(labels)})[ \t]*[:-][ \t]*", f"\n$1{_MARK}")
    marked = F.regexp_replace(own_line, rf"(?i)({_any_of(labels)})(?!{_MARK})(?=[ \t])", f"$1{_MARK}")
    return F.split(marked, r"\n|\t| {2,}")


def labelled_values(cut: Column, labels: list[str], *, longest: int = 80) -> Column:
    """What follows any of the labels within its segment; blank values and those longer than ``longest`` are none."""
    after = lambda label: F.transform(
        F.filter(cut, lambda x: F.contains(F.lower(x), F.lit(label.lower() + _MARK))),
        lambda x: F.trim(F.replace(F.regexp_extract(x, rf"(?i){re.escape(label)}{_MARK}(.*)", 1), F.lit(_MARK), F.lit(""))))
    found = F.concat(*[after(label) for label in labels])
    return F.filter(found, lambda v: (v != "") & (F.length(v) <= longest))


def fields(documents: DataFrame, doc: str, text: str, labels: dict[str, list[str]]) -> DataFrame:
    """``(doc, field, value, status, n)``: one distinct value is it, several are ambiguous, none is missing."""
    stop = [x for v in labels.values() for x in v]
    cut = documents.select(F.col(doc), segments(F.col(text), stop).alias("_cut"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), labelled_values(F.col("_cut"), ls).alias("v")) for f, ls in labels.items()]))
    d = cut.select(F.col(doc), each.alias("e")).select(doc, "e.field", F.array_sort(F.array_distinct("e.v")).alias("distinct"), F.size("e.v").alias("n"))
    n = F.size("distinct")
    return d.select(doc, "field", F.when(n == 1, F.col("distinct")[0]).alias("value"), F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous").alias("status"), "n")


def confidence(n: Column, ocr: Column) -> Column:
    """0.85 and 0.02 more a further agreeing match, at most 0.95; read by OCR it needs review."""
    return F.struct(F.least(F.lit(0.95), 0.85 + 0.02 * (n - 1)).alias("confidence"), F.coalesce(ocr, F.lit(False)).alias("needs_review"))


#: Labels of a citation's parts, and the lines after a code's own that still belong to it.
CODE, DESCRIPTION, NEXT_LABELS, TRAILING_LINES = "Violation Code", ["Violation Description", "Description"], ["Critical Flag", "Score", "Grade", "Action"], 2


def _description(line: Column) -> Column:
    """The text behind a description label of a line, up to a wide gap, a tab or another label; NULL if there is none."""
    behind = F.regexp_extract(line, rf"(?i)(?:{_any_of(DESCRIPTION)})[ \t]*[:-]?[ \t]*(.*)$", 1)
    value = F.element_at(F.split(behind, rf"(?i) {{2,}}|\t|(?:{_any_of([*DESCRIPTION, *NEXT_LABELS, CODE])})[ \t]*[:-]"), 1)
    return F.nullif(F.trim(F.substring(value, 1, 200)), F.lit(""))


def violation_rows(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, code, description, critical)`` of each citation: a code behind its label, what its line and the next two say.

    A code ends at a blank, comma or semicolon and loses a trailing full stop or colon. A description is looked for on the code's
    line first, then on the next ones, up to the next code; nothing is inferred from a code. NULL and empty texts have no rows.
    """
    lines = F.split(F.col(text), "\n")
    numbered = documents.select(doc, lines.alias("_lines"), F.posexplode(lines).alias("_i", "_line")).where(F.contains(F.lower("_line"), F.lit(CODE.lower())))
    following = F.slice("_lines", F.col("_i") + 2, TRAILING_LINES)
    own = F.aggregate(following, F.array().cast("array<string>"), lambda a, x: F.when(  # the lines before the next code
        F.element_at(F.concat(F.array(F.lit("")), a), -1).isNull() | F.contains(F.lower(x), F.lit(CODE.lower())), F.array_append(a, F.lit(None).cast("string"))).otherwise(F.array_append(a, x)))
    parts = F.split("_line", rf"(?i){re.escape(CODE)}[ \t]*[:-]?[ \t]*")
    each = numbered.withColumn("_own", F.array_compact(own)).withColumn("_parts", parts).select(doc, "_own", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_k", "_part")).where("_k > 0")
    code = F.nullif(F.regexp_replace(F.regexp_extract("_part", r"^([^\s,;]{1,20})", 1), r"[.,;:]+$", ""), F.lit(""))
    candidates = F.concat(F.array(F.regexp_replace("_part", r"^[^\s,;]{1,20}", "")), F.when(F.col("_k") == F.col("_n") - 1, F.col("_own")).otherwise(F.array().cast("array<string>")))
    each = each.select(doc, code.alias("code"), candidates.alias("_said")).where("code IS NOT NULL")
    window = F.lower(F.array_join("_said", "\n"))
    critical = F.when(window.rlike(r"\bnot\s+critical\b|\bnon-?critical\b"), False).when(window.rlike(r"\bcritical\b"), True)
    return each.select(doc, "code", F.element_at(F.concat(F.array_compact(F.transform("_said", _description)), F.array(F.lit(None).cast("string"))), 1).alias("description"), critical.alias("critical"))


def draft_status(found: DataFrame, doc: str, required: list[str]) -> DataFrame:
    """Per document: missing and ambiguous required fields, and whether the draft can be confirmed."""
    need = found.where(F.col("field").isin(required))
    g = need.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("field")))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("status") == "ambiguous", F.col("field")))).alias("ambiguous"))
    return g.withColumn("confirmable", (F.size("missing") == 0) & (F.size("ambiguous") == 0))


def block_problems(blocks: DataFrame, *, pages: int = 100, per_page: int = 500, chars: int = 5000) -> DataFrame:
    """``(document_id, problem, blocks)``: why a document's blocks are rejected; the limits hold for page, length, source, box, confidence and number."""
    b = F.col("bounding_box")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < 1e308)
    box = b.isNull() | ((b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]) & finite(b["x0"]) & finite(b["x1"]) & finite(b["y0"]) & finite(b["y1"]))
    conf = F.when(F.col("source") == "ocr", F.col("ocr_confidence").between(0, 1)).otherwise(F.col("ocr_confidence").isNull())
    holds = {
        "page": F.col("page").between(1, pages), "text": F.length("text") <= chars, "source": F.col("source").isin("embedded_text", "ocr"), "bounding_box": box, "ocr_confidence": conf}
    each = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in holds.items()]), lambda x: x.isNotNull())
    bad = blocks.select("document_id", F.explode(each).alias("problem")).groupBy("document_id", "problem").agg(F.count("*").alias("blocks"))
    full = blocks.groupBy("document_id", "page").agg(F.count("*").alias("n")).where(F.col("n") > per_page)
    return bad.unionByName(full.groupBy("document_id").agg(F.lit("blocks_per_page").alias("problem"), F.sum("n").alias("blocks")))


def valid_blocks(blocks: DataFrame, *, pages: int = 100, per_page: int = 500, chars: int = 5000) -> DataFrame:
    """The blocks of the documents that obey all limits. A document with one bad block, or with too many blocks on a page, is
    rejected as a whole (``block_problems`` tells why); no block is cut off."""
    rejected = block_problems(blocks, pages=pages, per_page=per_page, chars=chars).select("document_id").distinct()
    return blocks.join(rejected, "document_id", "left_anti")


def checked_corrections(corrections: DataFrame, *, chars: int = 500, total: int = 20_000) -> DataFrame:
    """``status`` per correction: rejected if too long (alone or together), unparseable if its kind cannot be read, else parsed."""
    all_chars = F.sum(F.length("value")).over(Window.partitionBy("document_id"))
    number, day = F.col("value").try_cast("double"), F.coalesce(F.try_to_date("value", "M/d/yyyy"), F.try_to_date("value", "yyyy-MM-dd"))
    unread = ((F.col("kind") == "number") & (number.isNull() | (number < 0))) | ((F.col("kind") == "date") & day.isNull())
    return corrections.withColumn("status", F.when((F.length("value") > chars) | (all_chars > total) | (F.trim("value") == ""), "rejected").when(unread, "unparseable").otherwise("parsed"))
