"""The property graph as two tables, nodes and edges, with integrity checks and the queries over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_NODES, MAX_EDGES = 500_000, 2_000_000


def code_node(jurisdiction: Column, code: Column) -> Column:
    return F.concat(F.lit("code:"), jurisdiction, F.lit(":"), code)


def cuisine_node(cuisine: Column) -> Column:
    return F.concat(F.lit("cuisine:"), F.lower(F.trim(F.regexp_replace(cuisine, r"\s+", " "))))


def location_node(jurisdiction: Column, city: Column, postal: Column) -> Column:
    part = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("_unknown"))
    return F.concat(F.lit("location:"), jurisdiction, F.lit(":"), part(city), F.lit(":"), part(postal))


def _nodes(df: DataFrame, node_id: Column, kind: str, attrs: dict[str, Column]) -> DataFrame:
    return df.select(node_id.alias("node_id"), F.lit(kind).alias("node_type"), F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in attrs.items()])).alias("attrs")).where("node_id IS NOT NULL")


def _edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def build_graph(*, restaurants: DataFrame | None, inspections: DataFrame | None, violations: DataFrame | None, awards: DataFrame | None = None, editions: DataFrame | None = None,
                matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, conflicts)``; a missing table gives no nodes. An edge needs both its nodes; only accepted matches count.

    A node id with several contents keeps the smallest one in order and is listed in ``conflicts``.
    """
    nodes, edges = [], []
    r, i, v = restaurants, inspections, violations
    if r is not None:
        place, food = location_node(F.col("jurisdiction"), F.col("city"), F.col("postal_code")), cuisine_node(F.col("cuisine"))
        nodes += [_nodes(r, F.col("restaurant_id"), "restaurant", {"name": F.col("name"), "jurisdiction": F.col("jurisdiction")}),
                  _nodes(r, place, "location", {"jurisdiction": F.col("jurisdiction")}), _nodes(r, food, "cuisine", {"cuisine": F.lower(F.trim("cuisine"))})]
        edges += [_edges(r, F.col("restaurant_id"), place, "located_in"), _edges(r, F.col("restaurant_id"), food, "has_cuisine")]
    if i is not None:
        nodes.append(_nodes(i, F.col("inspection_id"), "inspection", {"date": F.col("inspection_date"), "type": F.col("inspection_type"), "score": F.col("score")}))
        edges.append(_edges(i, F.col("restaurant_id"), F.col("inspection_id"), "has_inspection"))
    if v is not None:
        code = code_node(F.col("jurisdiction"), F.col("violation_code_norm"))
        nodes += [_nodes(v, F.col("violation_event_id"), "violation_occurrence", {"code": F.col("violation_code_norm"), "severity": F.col("severity")}), _nodes(v, code, "violation_code", {"code": F.col("violation_code_norm")})]
        edges += [_edges(v, F.col("inspection_id"), F.col("violation_event_id"), "documented_violation"), _edges(v, F.col("violation_event_id"), code, "uses_violation_code")]
    if awards is not None:
        nodes.append(_nodes(awards, F.col("award_id"), "award", {"name": F.col("name_as_published")}))
    if editions is not None:
        nodes.append(_nodes(editions, F.col("event_id"), "edition", {"year": F.col("guide_year"), "distinction": F.col("distinction"), "announced": F.col("announced_date")}))
        edges.append(_edges(editions, F.col("award_id"), F.col("event_id"), "has_edition"))
    if matches is not None:
        edges.append(_edges(matches.where("decision = 'accept'"), F.col("restaurant_id"), F.col("award_id"), "matched_to"))
    if not nodes:
        raise ValueError("no table to build a graph from")
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    g = union(nodes).groupBy("node_id", "node_type").agg(F.min("attrs").alias("attrs"), F.count_distinct("attrs").alias("contents"))
    conflicts = g.where("contents > 1").select("node_id", "node_type", "contents")
    all_nodes = g.drop("contents")
    ids = all_nodes.select("node_id")
    e = union(edges) if edges else all_nodes.limit(0).select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("node_type").alias("edge_type"))
    e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type")
    return all_nodes, e, conflicts


def check_capacity(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> None:
    for name, df, most in (("nodes", nodes, max_nodes), ("edges", edges, max_edges)):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} {name}")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids, edges["src"] == ids["node_id"], "left_anti").unionByName(edges.join(ids, edges["dst"] == ids["node_id"], "left_anti")).distinct()


def misdated_editions(editions: DataFrame) -> DataFrame:
    """Editions announced in another year than their guide's."""
    return editions.where(F.year("announced_date") != F.col("guide_year"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("type")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


def recurring_codes(violations: DataFrame, *, least: int = 2) -> DataFrame:
    """Codes that a restaurant was cited for on at least ``least`` occasions: occurrences, inspections, citations, dates, latest text."""
    times = F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.lit(1)).cast("long")
    latest = F.max_by(F.struct("violation_description", "severity"), F.struct("inspection_date", "violation_event_id"))
    g = violations.where("violation_code_norm IS NOT NULL").groupBy("restaurant_id", "violation_code_norm").agg(
        F.count("*").alias("occurrences"), F.count_distinct("inspection_id").alias("inspections"), F.sum(times).alias("citations"), F.array_sort(F.collect_set("inspection_date")).alias("dates"), latest.alias("l"))
    return g.where(F.col("occurrences") >= least).select("restaurant_id", "violation_code_norm", "occurrences", "inspections", "citations", "dates", "l.violation_description", "l.severity")


def trend(inspections: DataFrame) -> DataFrame:
    """First and last inspection of restaurants with at least two, with the change of the score."""
    key = F.struct("inspection_date", "inspection_id")
    g = inspections.groupBy("restaurant_id").agg(F.count("*").alias("n"), F.min_by(F.struct("inspection_date", "score"), key).alias("a"), F.max_by(F.struct("inspection_date", "score"), key).alias("z"))
    return g.where("n >= 2").select("restaurant_id", "n", F.col("a.inspection_date").alias("first_date"), F.col("z.inspection_date").alias("last_date"), (F.col("z.score") - F.col("a.score")).alias("change"))


def neighbours(edges: DataFrame, start: DataFrame, kinds: list[str]) -> DataFrame:
    """``(start, node)`` reached along the given kinds of edges in turn; the start table has one column ``node_id``."""
    at = start.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"))
    for k in kinds:
        e = edges.where(F.col("edge_type") == k).select(F.col("src").alias("node"), "dst")
        at = at.join(e, "node").select("start", F.col("dst").alias("node"))
    return at


def latest_description(violations: DataFrame) -> DataFrame:
    w = Window.partitionBy("restaurant_id", "violation_code_norm").orderBy(F.desc("inspection_date"), F.desc("violation_event_id"))
    return violations.where("violation_description IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("restaurant_id", "violation_code_norm", "violation_description")
