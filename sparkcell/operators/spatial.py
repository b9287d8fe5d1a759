"""Spatial autocorrelation of gene values over a neighbour graph: Moran's I and Geary's C."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_sf_udf, p_adjust


def weights(neighbors: DataFrame) -> DataFrame:
    """(src, dst, w): row-standardised weights of a neighbour table."""
    deg = neighbors.groupBy("cell_id").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return neighbors.select("cell_id", "neighbor").join(deg, "cell_id").select(F.col("cell_id").alias("src"), F.col("neighbor").alias("dst"), "w")


def feasible(neighbors: DataFrame, closest: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Neighbour pairs whose closest vertices are equal or joined by a principal edge; closest is
    (cell_id, node)."""
    near = neighbors.join(closest.select("cell_id", F.col("node").alias("a")), "cell_id").join(closest.select(F.col("cell_id").alias("neighbor"), F.col("node").alias("b")), "neighbor")
    e = graph_edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return near.join(F.broadcast(both.withColumn("joined", F.lit(True))), ["a", "b"], "left").where("a = b or joined").select("cell_id", "neighbor")


def constants(w: DataFrame, n: DataFrame) -> DataFrame:
    """One row: n, s0, s1, s2 of a weight table."""
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    pair = w.join(back, ["src", "dst"], "full").select((F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("s"))
    s1 = pair.agg((F.sum(F.col("s") * F.col("s")) / 2).alias("s1"))
    out = w.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("o"))
    into = w.groupBy(F.col("dst").alias("i")).agg(F.sum("w").alias("p"))
    s2 = out.join(into, "i", "full").agg(F.sum(F.pow(F.coalesce("o", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)), 2)).alias("s2"))
    return n.crossJoin(w.agg(F.sum("w").alias("s0"))).crossJoin(s1).crossJoin(s2)


def graph_statistics(values: DataFrame, cells: DataFrame, w: DataFrame, zero: float = 0.0) -> DataFrame:
    """Per gene: morans_i with e_i, v_i, z_i and gearys_c with v_c, z_c, over all cells.

    values (cell_id, gene_id, value) are stored entries and `zero` is the value of the others.
    With y = value - zero, only pairs with two stored ends add to the sum of w y y'; the other
    moments follow from sums over entries and over each cell's total weights, so the table is
    never made dense.
    """
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n"))
    y = values.select("cell_id", "gene_id", (F.col("value") - zero).alias("y"))
    sums = y.groupBy("gene_id").agg(*(F.sum(F.pow("y", k)).alias(f"q{k}") for k in (1, 2, 3, 4)))
    out = w.groupBy(F.col("src").alias("cell_id")).agg(F.sum("w").alias("o"))
    into = w.groupBy(F.col("dst").alias("cell_id")).agg(F.sum("w").alias("p"))
    ends = y.join(out, "cell_id", "left").join(into, "cell_id", "left").fillna(0.0, ["o", "p"])
    ends = ends.groupBy("gene_id").agg(F.sum(F.col("y") * (F.col("o") + F.col("p"))).alias("wy"), F.sum(F.col("y") * F.col("y") * (F.col("o") + F.col("p"))).alias("wyy"))
    cross = w.join(y.select(F.col("cell_id").alias("src"), "gene_id", F.col("y").alias("a")), "src").join(y.select(F.col("cell_id").alias("dst"), "gene_id", F.col("y").alias("b")), ["dst", "gene_id"])
    cross = cross.groupBy("gene_id").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("wab"))
    t = sums.join(ends, "gene_id").join(cross, "gene_id", "left").fillna(0.0, ["wab"]).crossJoin(F.broadcast(constants(w, n)))
    c = F.col
    m = c("q1") / c("n")
    t = t.withColumn("ss", c("q2") - c("n") * m * m).withColumn("m", m)
    t = t.withColumn("s4", c("q4") - 4 * c("m") * c("q3") + 6 * c("m") * c("m") * c("q2") - 3 * c("n") * F.pow("m", 4))
    t = t.withColumn("k", F.try_divide(c("s4") * c("n"), c("ss") * c("ss"))).withColumn("s02", c("s0") * c("s0"))
    i = F.try_divide(c("n") * (c("wab") - c("m") * c("wy") + c("m") * c("m") * c("s0")), c("s0") * c("ss"))
    e = F.try_divide(F.lit(-1.0), c("n") - 1)
    nn = c("n") * c("n")
    vi = F.try_divide(c("n") * (c("s1") * (nn - 3 * c("n") + 3) - c("n") * c("s2") + 3 * c("s02")) - c("k") * (c("s1") * (nn - c("n")) - 2 * c("n") * c("s2") + 6 * c("s02")), (c("n") - 1) * (c("n") - 2) * (c("n") - 3) * c("s02")) - e * e
    g = F.try_divide((c("n") - 1) * (c("wyy") - 2 * c("wab")), 2 * c("s0") * c("ss"))
    vc = (c("n") - 1) * c("s1") * (nn - 3 * c("n") + 3 - c("k") * (c("n") - 1)) - 0.25 * (c("n") - 1) * c("s2") * (nn + 3 * c("n") - 6 - c("k") * (nn - c("n") + 2)) + c("s02") * (nn - 3 - c("k") * F.pow(c("n") - 1, 2))
    vc = F.try_divide(vc, c("n") * (c("n") - 2) * (c("n") - 3) * c("s02"))
    t = t.where("ss > 0").select("gene_id", i.alias("morans_i"), e.alias("e_i"), vi.alias("v_i"), g.alias("gearys_c"), vc.alias("v_c"))
    return t.withColumn("z_i", F.try_divide(c("morans_i") - c("e_i"), F.sqrt("v_i"))).withColumn("z_c", F.try_divide(1 - c("gearys_c"), F.sqrt("v_c")))


def graph_test(values: DataFrame, genes: DataFrame, cells: DataFrame, w: DataFrame, method: str = "Moran_I", alternative: str = "greater", zero: float = 0.0) -> DataFrame:
    """(gene_id, status, statistic, z, p_value, q_value) for every gene; q is BH over tested genes."""
    if method not in ("Moran_I", "Geary_C"):
        raise ValueError("method must be Moran_I or Geary_C")
    stat, z = ("morans_i", "z_i") if method == "Moran_I" else ("gearys_c", "z_c")
    t = graph_statistics(values, cells, w, zero).select("gene_id", F.col(stat).alias("statistic"), F.col(z).alias("z"))
    tail = {"greater": normal_sf_udf(F.col("z")), "less": 1 - normal_sf_udf(F.col("z")), "two.sided": 2 * normal_sf_udf(F.abs("z"))}[alternative]
    t = genes.select("gene_id").join(t, "gene_id", "left").withColumn("status", F.when(F.col("z").isNull() | F.isnan("z"), "FAIL").otherwise("OK"))
    return p_adjust(t.withColumn("p_value", F.when(F.col("status") == "OK", tail)), "p_value", "q_value", method="bh")
