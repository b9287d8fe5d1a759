"""The tables that plots are drawn from; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import aggregate, scaled
from .graph import degrees


def cell_points(points: DataFrame, colors: DataFrame | None = None, dims: int = 2) -> DataFrame:
    """(cell_id, x1.., color): places of cells with what colours them; colors is (cell_id, grp)."""
    out = points.select("cell_id", *(F.get("vec", F.lit(k)).alias(f"x{k + 1}") for k in range(dims)))
    return out if colors is None else out.join(colors.select("cell_id", F.col("grp").alias("color")), "cell_id", "left")


def graph_segments(nodes: DataFrame, edges: DataFrame, dims: int = 2) -> DataFrame:
    """(src, dst, src_x1.., dst_x1..): edges with the places of their ends, by two left joins."""
    at = lambda side: nodes.select(F.col("node").alias(side), *(F.get("vec", F.lit(k)).alias(f"{side}_x{k + 1}") for k in range(dims)))
    return edges.select("src", "dst").join(F.broadcast(at("src")), "src", "left").join(F.broadcast(at("dst")), "dst", "left").select("src", "dst", *(f"{s}_x{k + 1}" for s in ("src", "dst") for k in range(dims)))


def node_points(nodes: DataFrame, edges: DataFrame, roots: list | None = None, dims: int = 2) -> DataFrame:
    """(node, kind, x1..): root, branch and leaf nodes; roots are neither branch nor leaf."""
    kind = F.when(F.col("node").isin(list(roots or [])), "root").otherwise(F.col("kind"))
    marked = degrees(nodes, edges).select("node", kind.alias("kind")).where("kind <> 'inner'")
    return marked.join(nodes, "node").select("node", "kind", *(F.get("vec", F.lit(k)).alias(f"x{k + 1}") for k in range(dims)))


def grouped_values(values: DataFrame, gene_groups: DataFrame) -> DataFrame:
    """(row, col, value): sums over gene groups as log10(sum + 1), as z scores over cells within 2."""
    sums = aggregate(values, gene_groups, drop_singletons=False)
    return scaled(sums.withColumn("value", F.log10(F.col("value") + 1)), -2, 2)


def variance_explained(sdev: list[float]) -> list[tuple[int, float]]:
    total = sum(s * s for s in sdev) or 1.0
    return [(k + 1, s * s / total) for k, s in enumerate(sdev)]
