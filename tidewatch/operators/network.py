"""Dependency graph of infrastructure: edges, bounded cascades from all sources at once, alternatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import banded
from ..storage import written


def cable_edges(landings: DataFrame) -> DataFrame:
    """Edges cable -> country by served share, then by landing; landings are (cable_id, country, capacity_share, redundant)."""
    serves = landings.select(F.col("cable_id").alias("src"), F.col("country").alias("dst"), F.lit("serves").alias("kind"), F.col("capacity_share").alias("strength"), F.when(F.col("redundant"), 0.5).otherwise(0.0).alias("redundancy"))
    lands = landings.select(F.col("cable_id").alias("src"), F.col("country").alias("dst"), F.lit("lands_at").alias("kind"), F.lit(0.3).alias("strength"), F.lit(0.5).alias("redundancy"))
    return serves.unionByName(lands)


#: Kinds of edges in the order in which a source's edges are taken.
EDGE_KINDS = ["serves", "lands_at", "trade_route", "controls_access", "trade_dependency"]


def _edges(df: DataFrame, src: str, dst: str, kind: str, strength: Column, redundancy: Column) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), strength.cast("double").alias("strength"), redundancy.cast("double").alias("redundancy"))


def dependency_edges(landings: DataFrame, pipelines: DataFrame, ports: DataFrame, routes: DataFrame, access: DataFrame, dependents: DataFrame) -> DataFrame:
    """All edges, numbered by source: cables as in cable_edges; pipelines (pipeline_id, country) serve countries with 0.2; ports
    (port_id, country, kind, rank) serve theirs by importance and others by trade routes (port_id, country, strength); chokepoints
    control access to ports (edges of access_edges) and countries depend on them (chokepoint_id, country, strength, redundancy)."""
    served = _edges(ports, "port_id", "country", "serves", port_importance(F.col("kind"), F.col("rank")), F.when(F.col("rank") <= 5, 0.2).otherwise(0.4))
    every = [
        cable_edges(landings),
        _edges(pipelines, "pipeline_id", "country", "serves", F.lit(0.2), F.lit(0.3)),
        served,
        _edges(routes, "port_id", "country", "trade_route", F.col("strength"), F.lit(0.5)),
        access,
        _edges(dependents, "chokepoint_id", "country", "trade_dependency", F.col("strength"), F.col("redundancy")),
    ]
    return with_sequence(reduce(DataFrame.unionByName, every), EDGE_KINDS)


def with_sequence(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Numbers the edges of each source in the order of their kind, then target."""
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return edges.withColumn("edge_seq", F.row_number().over(Window.partitionBy("src").orderBy(order, "dst")).cast("long"))


def cascade(edges: DataFrame, sources: DataFrame | None = None, disruption: float = 1.0, depth: int = 3, mode: str = "first_edge_wins", weakest: float = 0.05) -> DataFrame:
    """(source, node, level, impact, capacity along the chain, severity) of what a loss of each source reaches in at most depth steps.

    Each step joins the frontier to the edges. A node is taken at its first edge, in the order of the frontier and of edges,
    even if that is too weak to pass anything on; with mode strongest_edge at its strongest."""
    start = (edges.select("src").distinct() if sources is None else sources.select("src")).select(F.col("src").alias("source"), F.col("src").alias("node"))
    visited = start.select("source", "node", F.lit(0).alias("level"), F.lit(disruption).alias("impact"), F.lit(0).cast("long").alias("rank"), F.lit(True).alias("passes"), F.lit(1.0).alias("capacity"))
    frontier = visited
    for level in range(1, depth + 1):
        reach = frontier.filter("passes").join(edges, frontier.node == edges.src).select("source", "dst", "rank", "edge_seq", (F.col("strength") * (1 - F.col("redundancy")) * disruption).alias("impact"), (F.col("capacity") * F.col("strength") * (1 - F.col("redundancy"))).alias("capacity"))
        new = reach.join(visited.select("source", F.col("node").alias("dst")), ["source", "dst"], "left_anti")
        order = (F.col("rank"), F.col("edge_seq")) if mode == "first_edge_wins" else (F.desc("impact"), F.col("rank"), F.col("edge_seq"))
        first = new.withColumn("nth", F.row_number().over(Window.partitionBy("source", "dst").orderBy(*order))).filter("nth = 1")
        numbered = first.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", "edge_seq")).cast("long"))
        frontier = written(numbered.select("source", F.col("dst").alias("node"), F.lit(level).alias("level"), "impact", F.col("place").alias("rank"), (F.col("impact") >= weakest).alias("passes"), "capacity"), "frontier")
        visited = visited.unionByName(frontier)
    found = visited.filter("level > 0 and passes").select("source", "node", "level", "impact", "capacity")
    return found.withColumn("severity", banded(F.col("impact"), [(0.8, "critical"), (0.5, "high"), (0.2, "medium")], "low"))


def affected_countries(impacts: DataFrame, edges: DataFrame, landings: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries that cascades reach, with their lost capacity and rank: of a cable the share it serves, else the strongest direct
    edge, else the product along the chain; by severity, then capacity to six places. Countries are (country)."""
    hit = impacts.join(countries.select(F.col("country").alias("node")), "node", "left_semi")
    served = landings.groupBy(F.col("cable_id").alias("source"), F.col("country").alias("node")).agg(F.max("capacity_share").alias("served"))
    cables = landings.select(F.col("cable_id").alias("source")).distinct().withColumn("is_cable", F.lit(True))
    direct = edges.groupBy(F.col("src").alias("source"), F.col("dst").alias("node")).agg(F.max(F.col("strength") * (1 - F.col("redundancy"))).alias("direct"))
    known = hit.join(served, ["source", "node"], "left").join(direct, ["source", "node"], "left").join(cables, "source", "left")
    lost = F.round(F.when(F.col("is_cable"), F.coalesce("served", F.lit(0.0))).otherwise(F.coalesce("direct", "capacity")), 6)
    level = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(level, F.desc("lost"), "node"))
    return known.withColumn("lost", lost).withColumn("rank", rank.cast("long")).select("source", F.col("node").alias("country"), "severity", "lost", "rank")


def graph_stats(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets")).join(F.broadcast(nodes))


def cable_alternatives(landings: DataFrame, k: int = 5, listed: str | None = None) -> DataFrame:
    """For each cable up to k others that serve its countries, with their mean share there: those that share most countries, or the first by the column listed, a cable's place in the list. Joined on country."""
    a = landings.select("cable_id", "country")
    b = landings.select(F.col("cable_id").alias("other_id"), "country", "capacity_share", (F.col(listed) if listed else F.lit(0)).alias("_place"))
    shared = a.join(b, "country").filter("cable_id <> other_id").groupBy("cable_id", "other_id").agg(F.count("*").alias("shared"), F.avg("capacity_share").alias("mean_share"), F.min("_place").alias("_place"))
    order = ["_place", "other_id"] if listed else [F.desc("shared"), F.desc(F.round("mean_share", 9)), "other_id"]
    rank = F.row_number().over(Window.partitionBy("cable_id").orderBy(*order))
    return shared.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).drop("_place")


def port_importance(kind, rank):
    """Weight of the port's type plus up to 0.3 for a rank under 20, 1 at most."""
    weight = F.lit(0.5)
    for k, v in {"oil": 0.9, "lng": 0.85, "container": 0.7, "mixed": 0.6, "bulk": 0.5, "naval": 0.4}.items():
        weight = F.when(kind == k, v).otherwise(weight)
    return F.least(F.lit(1.0), weight + F.greatest(F.lit(0.0), (20 - rank) / 20.0) * 0.3)
