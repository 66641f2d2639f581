"""Questions to a graph of typed nodes (node_id, type, layer, x, y) and directed typed edges (source, target, type), as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    """Nodes or edges of a type."""
    return rows.filter(F.col("type") == kind)


def of_layer(nodes: DataFrame, layer: str) -> DataFrame:
    return nodes.filter(F.col("layer") == layer)


def _ends(nodes: DataFrame, edges: DataFrame, ask: DataFrame, near: str, far: str, kind: str | None) -> DataFrame:
    e = edges if kind is None else of_type(edges, kind)
    met = e.join(ask.select(F.col("node_id").alias("_ask")), F.col(near) == F.col("_ask"))
    return met.select(F.col("_ask").alias("of"), F.col(far).alias("node_id"), F.col("type").alias("edge_type")).join(nodes.select("node_id", "type"), "node_id").select("of", "node_id", "type", "edge_type")


def neighbors(nodes: DataFrame, edges: DataFrame, ask: DataFrame, kind: str | None = None) -> DataFrame:
    """(of, node_id, type, edge_type): where edges of the asked nodes lead, to nodes that exist."""
    return _ends(nodes, edges, ask, "source", "target", kind)


def incoming(nodes: DataFrame, edges: DataFrame, ask: DataFrame, kind: str | None = None) -> DataFrame:
    """(of, node_id, type, edge_type): where edges to the asked nodes come from."""
    return _ends(nodes, edges, ask, "target", "source", kind)


def within(nodes: DataFrame, x: float, y: float, radius: float, kind: str | None = None) -> DataFrame:
    """Nodes with a place within a radius, whatever their number."""
    own = nodes if kind is None else of_type(nodes, kind)
    dx, dy = F.col("x") - x, F.col("y") - y
    return own.filter(dx * dx + dy * dy <= radius * radius)
