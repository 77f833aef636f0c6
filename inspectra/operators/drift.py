"""Schemas that drift between files: every row as a map of path and raw value, statistics per file and path, changes
between consecutive files of a feed, and one consistent typed table with the casts that failed.

Nothing is typed at load time: values stay text, and what a column holds is read from the statistics of its values.
No list of headers is needed: that two headers name one thing is learnt from the transitions where their data tell it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.session import checkpoint

WHOLE, DECIMAL, ISO, SLASH, TEXT = "whole number", "decimal number", "ISO date", "slash date", "text"

#: Number words that stand for digits in a value.
NUMBER_WORDS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5}

_OUTER = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def clean_header(c: Column) -> Column:
    """Without outer blanks and byte-order marks; inner characters and case are kept."""
    return F.regexp_replace(c, _OUTER, "")


def field_pattern(delimiter: Column) -> Column:
    """A pattern for a delimiter and the field behind it: quoted (quotes are doubled inside) or up to the next delimiter."""
    literal = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    escaped = F.when(delimiter.rlike("^[\\p{L}\\p{N}]$"), delimiter).otherwise(F.concat(F.lit("\\"), delimiter))
    until = F.when(F.length(delimiter) == 1, F.concat(F.lit("[^"), escaped, F.lit("]*"))).otherwise(F.concat(F.lit("(?:(?!"), literal, F.lit(").)*")))
    return F.concat(F.lit("(?s)"), literal, F.lit('("(?:[^"]|"")*"|'), until, F.lit(")"))


def split_fields(line: Column, delimiter: Column, pattern: Column) -> Column:
    """The fields of one CSV line, blank ones as NULL; any number of fields and any delimiter, also of several characters."""
    raw = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    return F.transform(raw, lambda v: F.nullif(F.when(
        F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"')) & (F.length(v) >= 2), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v), F.lit("")))


def value_kind(v: Column) -> Column:
    """The kind of one value; NULL for a blank one."""
    t = F.trim(v)
    return (
        F.when(t.isNull() | (t == ""), None)
        .when(t.rlike(r"^[+-]?[0-9]+$"), WHOLE)
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), DECIMAL)
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), ISO)
        .when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/([0-9]{4}|[0-9]{2})([T ].*)?$"), SLASH)
        .otherwise(TEXT)
    )


def parsed_headers(files: DataFrame) -> DataFrame:
    """``(file_id, delimiter, pattern, snapshot_date, header)``: the header cells of each file, cleaned; blank cells stay as NULL."""
    f = files.where("file_id IS NOT NULL").select(
        "file_id", F.coalesce(F.nullif("delimiter", F.lit("")), F.lit(",")).alias("delimiter"), "snapshot_date", F.regexp_replace("header_line", r"^\x{FEFF}", "").alias("_line"))
    f = f.withColumn("pattern", field_pattern(F.col("delimiter")))
    cells = F.transform(split_fields(F.col("_line"), F.col("delimiter"), F.col("pattern")), lambda c: F.nullif(clean_header(c), F.lit("")))
    return f.select("file_id", "delimiter", "pattern", "snapshot_date", F.coalesce(cells, F.array().cast("array<string>")).alias("header"))


def parsed_rows(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``(file_id, row_no, snapshot_date, paths, values)``: each row parsed once with the delimiter of its file, in the JVM.

    Entries without a header are named ``column <n>``, also where the header has a blank cell; a row shorter than the
    header lacks the rest (NULL). Rows of unknown files and rows without a line are left out.
    """
    lines = rows.where("raw_line IS NOT NULL").select("file_id", "row_no", "raw_line").join(parsed_headers(files), "file_id")
    split = lines.select("file_id", "row_no", "snapshot_date", _without_end(F.col("header")).alias("_h"), _without_end(split_fields(F.col("raw_line"), F.col("delimiter"), F.col("pattern"))).alias("_v"))
    length = F.greatest(F.size("_h"), F.size("_v"))
    each = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    path = lambda i: F.coalesce(F.try_element_at("_h", i), F.concat(F.lit("column "), i.cast("string")))
    return split.select("file_id", "row_no", "snapshot_date", F.transform(each, path).alias("paths"), F.transform(each, lambda i: F.try_element_at("_v", i)).alias("values"))


def paths_of(parsed: DataFrame) -> DataFrame:
    """``(file_id, row_no, snapshot_date, position, path, value)``: the map of path and raw value of each parsed row, one entry a row."""
    entries = F.posexplode(F.arrays_zip("paths", "values"))
    return parsed.select("file_id", "row_no", "snapshot_date", entries.alias("position", "e")).select(
        "file_id", "row_no", "snapshot_date", "position", F.col("e.paths").alias("path"), F.col("e.values").alias("value"))


def load_paths(files: DataFrame, rows: DataFrame) -> DataFrame:
    return paths_of(parsed_rows(files, rows))


def _without_end(cells: Column) -> Column:
    """The cells up to the last one that is not NULL."""
    last = F.aggregate(F.transform(cells, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i))
    return F.when(cells.isNotNull(), F.slice(cells, 1, last)).otherwise(F.array().cast("array<string>"))


def _with_profile(df: DataFrame) -> DataFrame:
    """Adds ``profile``: a coarse class of a value that survives a change of format, from ``value``, ``kind`` and ``snapshot_date``.

    The class is the size of its number, the age of its date or the form of its text. Steps are separate columns,
    so that each is computed once.
    """
    t = F.lower(F.trim("value"))
    words = reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", str(kv[1])), NUMBER_WORDS.items(), t)
    df = df.withColumn("_t", F.when((F.col("kind") == TEXT) & t.rlike("|".join(NUMBER_WORDS)), words).otherwise(t))
    df = df.withColumns({
        "_letters": F.when(F.col("kind") == TEXT, F.length(F.regexp_replace("_t", r"[^\p{L}]", ""))).otherwise(0),
        "_groups": F.when(F.col("kind") == TEXT, F.size(F.regexp_extract_all("_t", F.lit(r"([0-9][0-9,.-]*)"), F.lit(1)))).otherwise(1),
        "_digits": F.when(~F.col("kind").isin(ISO, SLASH), F.ltrim(F.lit("0"), F.translate(F.regexp_extract("_t", r"([0-9][0-9,-]*)", 1), ",-", ""))),
        "_age": F.when(F.col("kind").isin(ISO, SLASH), F.datediff("snapshot_date", F.coalesce(
            F.try_to_date(F.substring("_t", 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract("_t", r"^[0-9]+/[0-9]+/[0-9]+", 0), "M/d/yyyy")))),
    })
    number = (
        F.when(F.length("_digits") >= 5, F.concat(F.lit("n"), F.length("_digits"), F.lit(":"), F.substring("_digits", 1, 1)))
        .when(F.length("_digits") == 0, F.lit("n:0"))
        .otherwise(F.concat(F.lit("n:"), F.floor(F.log2(F.expr("try_cast(_digits AS double)")))))
    )
    text = F.concat(F.when(F.col("_groups") > 0, "a:").otherwise("t:"), F.least(F.lit(4), F.size(F.split("_t", r"\s+"))))
    profile = (
        F.when(F.col("kind").isNull(), None)
        .when(F.col("kind").isin(ISO, SLASH), F.concat(F.lit("d:"), F.when(F.col("_age") < 0, "future").when(F.col("_age") < 90, "recent").otherwise("old")))
        .when((F.col("_groups") == 1) & (F.col("_letters") <= 4), number).otherwise(text)
    )
    return df.withColumn("profile", profile).drop("_t", "_letters", "_groups", "_digits", "_age")


def path_statistics(paths: DataFrame) -> DataFrame:
    """Per file and path: position, values, blanks, values by kind, the histogram of profiles, a sketch of the values, the kind.

    Two aggregations with map-side combine; a file of any number of rows becomes a few hundred partial rows per
    path. The sketch (theta, 4096 entries) is exact up to that many distinct values.
    """
    kind = value_kind(F.col("value"))
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim("value")), r"\.0+$", ""), r"[^\p{L}\p{N}]", "")
    same = F.regexp_replace(bare, r"^\p{L}{1,3}(?=[0-9]{3,}$)", "")  # an identifier with and without a short prefix
    each = _with_profile(paths.withColumn("kind", kind)).withColumn("same", F.when(F.col("kind").isNotNull(), same))
    by = ["file_id", "position", "path"]
    fine = each.groupBy(*by, "kind", "profile").agg(F.count("*").alias("n"), F.theta_sketch_agg("same", 12).alias("sketch"))
    stats = fine.groupBy(*by).agg(
        F.sum("n").alias("n_values"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("n_blank"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k.split()[0].lower()}") for k in (WHOLE, DECIMAL, ISO, SLASH, TEXT)],
        F.collect_list(F.when(F.col("profile").isNotNull(), F.struct("profile", "n"))).alias("_hist"), F.theta_union_agg("sketch").alias("sketch"),
    )
    full = F.col("n_values") - F.col("n_blank")
    enough = lambda n: F.col(n) * 5 >= full * 4
    chosen = (F.when(full == 0, None).when(enough("n_whole"), WHOLE).when(enough("n_decimal"), DECIMAL)
              .when(enough("n_iso"), ISO).when(enough("n_slash"), SLASH).otherwise(TEXT))
    return stats.select(*by, "n_values", "n_blank", "n_whole", "n_decimal", "n_iso", "n_slash", "n_text", chosen.alias("kind"), F.col("_hist").alias("histogram"), "sketch")


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}#+]", "")


def _header_words(c: Column) -> Column:
    """The words of a header with three letters or more, lower case, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))


def _assign(pairs: pd.Series) -> pd.Series:
    """One file's scored pairs, best first, each column used once."""
    def one(ps):
        old, new, out = set(), set(), []
        for p in sorted(ps, key=lambda p: (-p["score"], p["old_name"], p["new_name"])):
            if p["old_name"] not in old and p["new_name"] not in new:
                old.add(p["old_name"])
                new.add(p["new_name"])
                out.append({"old_name": p["old_name"], "new_name": p["new_name"]})
        return out

    return pairs.map(one)


def file_pairs(files: DataFrame) -> DataFrame:
    """``(file_id, prev_id)``: each file and the one before it in its feed by snapshot date; the first has none."""
    w = Window.partitionBy("feed").orderBy("snapshot_date", "file_id")
    return files.where("file_id IS NOT NULL").select("file_id", F.lag("file_id").over(w).alias("prev_id")).where("prev_id IS NOT NULL")


def rename_evidence(gone: DataFrame, come: DataFrame) -> DataFrame:
    """Removed and added columns of one transition with the evidence that they hold the same data, between 0 and 1.

    ``content``: overlap of the histograms of value profiles or of the values themselves (``overlap``, if there are four);
    ``slot``: the column kept a neighbour; ``name``: trigrams or words that the headers share; ``same``: they are spelt alike.
    """
    pairs = gone.join(come, "file_id")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(_letters(c)) - 2)), lambda i: F.substring(_letters(c), i, F.lit(3)))
    n = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x["n"])
    totals = lambda h: F.map_from_entries(F.transform(F.array_distinct(h["profile"]), lambda p: F.struct(p, F.aggregate(F.filter(h, lambda x: x["profile"] == p), F.lit(0.0), lambda a, x: a + x["n"]))))
    pairs = pairs.withColumn("_p", totals(F.col("old_histogram"))).withColumn("_q", totals(F.col("new_histogram")))
    hist = F.aggregate(F.map_keys("_p"), F.lit(0.0), lambda a, k: a + F.least(F.col("_p")[k] / n(F.col("old_histogram")), F.coalesce(F.try_element_at("_q", k), F.lit(0.0)) / n(F.col("new_histogram"))))
    least = F.least(F.theta_sketch_estimate("old_sketch"), F.theta_sketch_estimate("new_sketch"))
    overlap = F.coalesce(F.try_divide(F.theta_sketch_estimate(F.theta_intersection("old_sketch", "new_sketch")), least), F.lit(0.0))
    empty = (F.size("old_histogram") == 0) | (F.size("new_histogram") == 0)
    pairs = pairs.withColumns({"_a": _letters(F.col("old_name")), "_b": _letters(F.col("new_name")), "_overlap": F.when(empty | (least < 4), 0.0).otherwise(overlap)})
    ga, gb = grams(F.col("old_name")), grams(F.col("new_name"))
    jaccard = F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb))
    wa, wb = _header_words(F.col("old_name")), _header_words(F.col("new_name"))
    common = F.filter(wa, lambda x: F.exists(wb, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    alike = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.size(common), F.least(F.size(wa), F.size(wb))), F.lit(0.0)))
    slot = F.when((F.col("old_left") == F.col("new_left")) | (F.col("old_right") == F.col("new_right")), 1.0).otherwise(0.0)
    return pairs.select(
        "file_id", "old_name", "new_name", "_a", "_b", F.when(empty, 0.5).otherwise(F.greatest(hist, "_overlap")).alias("content"), F.col("_overlap").alias("overlap"),
        slot.alias("slot"), (F.col("_a") == F.col("_b")).alias("same"), F.greatest(jaccard, alike).alias("name"))


def rename_scores(evidence: DataFrame, known: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Adds ``score`` to the evidence; NULL where two columns do not hold the same data.

    ``known(a, b, support)`` holds pairs of headers that name one thing in other transitions than this one (whose own pairs are in
    ``chosen``): such a pair needs little of the data, nothing if several transitions say so, while two headers that are both
    known, but not as one thing, need the same values in the same place.
    """
    if known is None:
        e = evidence.withColumns({"support": F.lit(0).cast("long"), "other": F.lit(False)})
    else:
        named = known.select("a").distinct()
        e = evidence.join(known.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("support").alias("_support")), ["_a", "_b"], "left")
        e = e.join(named.select(F.col("a").alias("_a"), F.lit(True).alias("_ka")), "_a", "left").join(named.select(F.col("a").alias("_b"), F.lit(True).alias("_kb")), "_b", "left")
        e = e.join(chosen.select("file_id", "old_name", "new_name", F.lit(1).alias("_own")), ["file_id", "old_name", "new_name"], "left")
        other = F.coalesce(F.col("_ka") & F.col("_kb") & F.col("_support").isNull(), F.lit(False))
        e = e.withColumns({"other": other, "support": F.coalesce(F.col("_support") - F.coalesce("_own", F.lit(0)), F.lit(0))})
    unknown = 0.55 * F.col("content") + 0.25 * F.col("slot") + 0.2 * F.col("name")
    few = (F.col("support") == 1) & (F.col("content") + 0.25 * F.col("slot") >= 0.1)
    score = (
        F.when(F.col("same"), 2.0 + F.col("content"))
        .when((F.col("support") > 1) | few, 1.0 + 0.5 * F.col("content") + 0.1 * F.col("slot") + 0.5 * F.col("support") / (F.col("support") + 1))
        .when(F.col("other"), F.when((F.col("overlap") >= 0.8) & (F.col("slot") == 1.0), 0.6 * F.col("overlap")))
        .when((F.col("content") >= 0.4) & (unknown >= 0.6), unknown)
    )
    return e.select("file_id", "old_name", "new_name", score.alias("score"))


def learnt_names(chosen: DataFrame, heads: DataFrame) -> DataFrame:
    """``(a, b, support)``: pairs of headers (letters and digits only) that name one thing, with the number of transitions that say so.

    Pairs come from chosen renames, either way round, and from pairs with a common partner. Headers that stand together
    in one file name different things. There is one row a pair of spellings, however many files there are.
    """
    direct = chosen.select(_letters(F.col("old_name")).alias("a"), _letters(F.col("new_name")).alias("b")).where("a <> b")
    direct = direct.unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("support"))
    spelt = heads.select("file_id", _letters(F.col("path")).alias("x")).distinct()
    sets = spelt.groupBy("file_id").agg(F.array_sort(F.collect_set("x")).alias("xs")).select("xs").distinct()  # layouts, not files
    together = sets.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b")).where("a <> b").distinct()
    direct = checkpoint(direct.join(together, ["a", "b"], "left_anti"))
    onward = direct.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("support").alias("s"))
    through = direct.join(onward, "b").where("a <> c").groupBy("a", F.col("c").alias("b")).agg(F.max(F.least("support", "s")).alias("support"))
    through = through.join(together, ["a", "b"], "left_anti").join(direct, ["a", "b"], "left_anti")
    return checkpoint(direct.unionByName(through))


def _one_to_one(scored: DataFrame) -> DataFrame:
    """``(file_id, old_name, new_name)``: of the scored pairs of a file the best ones, each column used once."""
    pick = F.pandas_udf(_assign, "array<struct<old_name:string,new_name:string>>")
    listed = scored.where("score IS NOT NULL").groupBy("file_id").agg(F.collect_list(F.struct("old_name", "new_name", "score")).alias("p"))
    return listed.select("file_id", F.explode(pick("p")).alias("p")).select("file_id", "p.*")


def schema_changes(files: DataFrame, rows: DataFrame, *, stats: DataFrame | None = None, learn: bool = True) -> DataFrame:
    """``(file_id, change_kind, old_name, new_name)`` of each file against the one before it in its feed.

    ``added`` and ``removed`` leave the other name empty; ``renamed`` is the same data under another header;
    ``retyped`` is a change of kind between the old and the new name of a column. A column with no value in
    either file has no kind and is not retyped. Columns are compared by exact name without outer blanks and
    byte-order mark; a name used twice in one file counts once, with its first position. Files without rows still
    have columns; blank header cells are no columns. Removed and added columns of one file, both bounded by its header, are paired
    twice: by their data and spelling alone, then also by what the first round has learnt of the headers (``learn``).
    """
    stats = path_statistics(load_paths(files, rows)) if stats is None else stats
    heads = checkpoint(header_columns(files))
    s = heads.join(stats.drop("position").groupBy("file_id", "path").agg(
        F.min_by("kind", "n_blank").alias("kind"), F.flatten(F.collect_list("histogram")).alias("histogram"), F.theta_union_agg("sketch").alias("sketch")), ["file_id", "path"], "left")
    s = s.withColumn("histogram", F.coalesce("histogram", F.array().cast("array<struct<profile:string,n:bigint>>")))
    pairs = file_pairs(files)
    new = s.join(pairs, "file_id")
    old = s.withColumnRenamed("file_id", "prev_id").join(pairs, "prev_id")
    both = old.select("file_id", F.col("path").alias("old_name"), F.col("kind").alias("old_kind"), F.col("left").alias("old_left"), F.col("right").alias("old_right"), F.col("histogram").alias("old_histogram"), F.col("sketch").alias("old_sketch")).join(
        new.select(F.col("file_id").alias("_f"), F.col("path").alias("new_name"), F.col("kind").alias("new_kind"), F.col("left").alias("new_left"), F.col("right").alias("new_right"), F.col("histogram").alias("new_histogram"), F.col("sketch").alias("new_sketch")),
        (F.col("file_id") == F.col("_f")) & (F.col("old_name") == F.col("new_name")), "full")
    both = both.withColumn("file_id", F.coalesce("file_id", "_f")).drop("_f")
    both = checkpoint(both)
    gone = both.where("new_name IS NULL").select("file_id", "old_name", "old_kind", "old_left", "old_right", "old_histogram", "old_sketch")
    come = both.where("old_name IS NULL").select("file_id", "new_name", "new_kind", "new_left", "new_right", "new_histogram", "new_sketch")
    evidence = checkpoint(rename_evidence(gone, come))
    chosen = _one_to_one(rename_scores(evidence))
    if learn:
        chosen = checkpoint(chosen)
        chosen = _one_to_one(rename_scores(evidence, learnt_names(chosen, heads), chosen))
    renamed = chosen.join(gone.select("file_id", "old_name", "old_kind"), ["file_id", "old_name"]).join(come.select("file_id", "new_name", "new_kind"), ["file_id", "new_name"])
    renamed = checkpoint(renamed)
    kept = both.where("old_name IS NOT NULL AND new_name IS NOT NULL").select("file_id", "old_name", "new_name", "old_kind", "new_kind").unionByName(renamed)
    out = lambda df, kind, a, b: df.select("file_id", F.lit(kind).alias("change_kind"), a.alias("old_name"), b.alias("new_name"))
    o, n, none = F.col("old_name"), F.col("new_name"), F.lit("")
    return (
        out(renamed, "renamed", o, n)
        .unionByName(out(kept.where("old_kind <> new_kind"), "retyped", o, n))
        .unionByName(out(gone.join(renamed, ["file_id", "old_name"], "left_anti"), "removed", o, none))
        .unionByName(out(come.join(renamed, ["file_id", "new_name"], "left_anti"), "added", none, n))
    )


def header_columns(files: DataFrame) -> DataFrame:
    """``(file_id, path, left, right)``: the columns each header declares, with their neighbours' names."""
    h = parsed_headers(files).select("file_id", _without_end(F.col("header")).alias("_h"))
    each = F.transform("_h", lambda c, i: F.struct(
        c.alias("path"), F.when(i == 0, "<").otherwise(F.coalesce(F.try_element_at("_h", F.greatest(i, F.lit(1))), F.lit(""))).alias("left"),
        F.when(i + 1 == F.size("_h"), ">").otherwise(F.coalesce(F.try_element_at("_h", i + 2), F.lit(""))).alias("right"), i.alias("i")))
    named = h.select("file_id", F.explode(each).alias("c")).select("file_id", "c.*").where("path IS NOT NULL")
    return named.groupBy("file_id", "path").agg(F.min_by(F.struct("left", "right"), "i").alias("n")).select("file_id", "path", "n.left", "n.right")


def column_lineage(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``(file_id, path, field)``: the field of the consistent table that each column of each file feeds.

    A column is followed back through its renames to the first header it had (pointer doubling, so the number of
    joins is the logarithm of the longest chain of files). Roots of several feeds are one field if their headers are
    spelt alike or renames tie them together (the commonest spelling names the field), unless a file holds both.
    """
    heads = checkpoint(header_columns(files).select("file_id", "path"))
    own = heads.withColumn("id", F.concat_ws("\x1f", F.col("file_id").cast("string"), "path"))
    renames = changes.where("change_kind = 'renamed'").select("file_id", F.col("new_name").alias("path"), "old_name")
    added = changes.where("change_kind = 'added'").select("file_id", F.col("new_name").alias("path"), F.lit(True).alias("_new"))
    parent = own.join(file_pairs(files), "file_id", "left").join(renames, ["file_id", "path"], "left").join(added, ["file_id", "path"], "left").select(
        "file_id", "path", "id", F.when(F.col("prev_id").isNull() | F.col("_new"), F.col("id")).otherwise(F.concat_ws("\x1f", F.col("prev_id").cast("string"), F.coalesce("old_name", "path"))).alias("root"))
    while True:
        parent = checkpoint(parent)
        up = parent.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        nxt = parent.join(up, parent["root"] == up["_id"], "left").select("file_id", "path", "id", F.coalesce("_root", "root").alias("next"), "root")
        moved = nxt.where("next <> root").limit(1).count()
        parent = nxt.select("file_id", "path", "id", F.col("next").alias("root"))
        if not moved:
            break
    return _named_fields(parent, renames, heads)


def _named_fields(parent: DataFrame, renames: DataFrame, heads: DataFrame) -> DataFrame:
    """Gives roots of several feeds one name: spellings that renames tie together are one group (labels spread over the pairs)."""
    first = parent.withColumn("spelt", _letters(F.substring_index("root", "\x1f", -1)))
    known = learnt_names(renames.select("file_id", "old_name", F.col("path").alias("new_name")), heads)
    used = first.groupBy("spelt").agg(F.count("*").alias("n"), F.max(F.lower(F.regexp_replace(F.substring_index("root", "\x1f", -1), r"[^\p{L}\p{N}]+", "_"))).alias("name"))
    label = used.select("spelt", F.struct((-F.col("n")).alias("n"), "name").alias("best"))
    while True:  # as many rounds as the longest chain of spellings has steps
        label = checkpoint(label)
        near = known.join(label.withColumnRenamed("spelt", "b"), "b").groupBy(F.col("a").alias("spelt")).agg(F.min("best").alias("_near"))
        nxt = label.join(near, "spelt", "left").select("spelt", F.least("best", "_near").alias("best"), (F.col("_near") < F.col("best")).alias("_moved"))
        moved = nxt.where("_moved").limit(1).count()
        label = nxt.drop("_moved")
        if not moved:
            break
    named = first.join(label.select("spelt", F.col("best.name").alias("field")), "spelt", "left")
    own = F.lower(F.regexp_replace(F.substring_index("root", "\x1f", -1), r"[^\p{L}\p{N}]+", "_"))
    shared = named.groupBy("file_id", "field").agg(F.count("*").alias("_n")).where("_n > 1").select("field").distinct().withColumn("_shared", F.lit(True))
    named = named.join(shared, "field", "left")
    return named.select("file_id", "path", F.when(F.coalesce("_shared", F.lit(False)), own).otherwise(F.col("field")).alias("field"))


def field_types(lineage: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(file_id, path, field, type)``: the type of a field is the kind that most of its non-blank values have over all files
    (a number if whole and decimal numbers together lead; a date likewise). Entries without a header have a field by their position."""
    field = F.coalesce("field", F.lower(F.regexp_replace("path", r"[^\p{L}\p{N}]+", "_")))
    each = kinds.join(lineage, ["file_id", "path"], "left").withColumn("field", field)
    per = each.groupBy("field").agg(F.sum(F.col("n_whole") + F.col("n_decimal")).alias("num"), F.sum(F.col("n_iso") + F.col("n_slash")).alias("dat"), F.sum("n_text").alias("txt"))
    number, day = (F.col("num") >= F.col("dat")) & (F.col("num") > F.col("txt")), F.col("dat") > F.col("txt")
    typed = per.select("field", F.when(number, "number").when(day, "date").otherwise("text").alias("type"))
    return each.select("file_id", "path", "field").distinct().join(typed, "field").select("file_id", "path", "field", "type")


def as_number(v: Column) -> Column:
    return F.trim(v).try_cast("double")


def as_day(v: Column) -> Column:
    iso, slash = F.try_to_date(F.substring(F.trim(v), 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(F.trim(v), r"^[0-9]+/[0-9]+/[0-9]+", 0), "M/d/yyyy")
    return F.coalesce(iso, slash)


def consistent_table(parsed: DataFrame, types: DataFrame) -> DataFrame:
    """``(file_id, row_no, <field> ...)``: one wide table with a typed column a field, NULL where a file lacks it or a cast fails.

    The fields of each file's columns travel as one small map a file; rows are neither exploded nor regrouped. Several
    columns of a file with one field (repeated headers) give the first value. The list of fields, one a distinct column over all
    files, is read to the driver, as it is the schema of the result.
    """
    fields = [(r["field"], r["type"]) for r in types.select("field", "type").distinct().orderBy("field").collect()]
    maps = types.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "field"))).alias("_fields"))
    named = parsed.join(maps, "file_id").select("file_id", "row_no", F.transform("paths", lambda p: F.try_element_at("_fields", p)).alias("_f"), "values")

    def column(field: str, kind: str) -> Column:
        v = F.nullif(F.trim(F.try_element_at("values", F.nullif(F.array_position("_f", field), F.lit(0)).cast("int"))), F.lit(""))
        typed = as_number(v) if kind == "number" else as_day(v) if kind == "date" else v
        return typed.alias(field if field not in ("file_id", "row_no") else f"{field}_value")

    return named.select("file_id", "row_no", *[column(*f) for f in fields])


def consistent_rows(paths: DataFrame, types: DataFrame) -> DataFrame:
    """``(file_id, row_no, field, value, number, day, failed)``: every value of every row under its field, typed, in long form.

    ``failed`` marks a non-blank value that does not have the type of its field.
    """
    v = F.nullif(F.trim("value"), F.lit(""))
    number, day = F.when(F.col("type") == "number", as_number(F.col("value"))), F.when(F.col("type") == "date", as_day(F.col("value")))
    failed = v.isNotNull() & (((F.col("type") == "number") & number.isNull()) | ((F.col("type") == "date") & day.isNull()))
    return paths.join(types, ["file_id", "path"]).select("file_id", "row_no", "field", v.alias("value"), number.alias("number"), day.alias("day"), failed.alias("failed"))


def failed_casts(consistent: DataFrame) -> DataFrame:
    """Failed casts per file and field, with the share of its non-blank values."""
    return consistent.groupBy("file_id", "field").agg(F.count("value").alias("n_values"), F.count_if("failed").alias("n_failed")).where("n_failed > 0")
