"""Size factors, normalised counts, tf-idf, detection and moments. Implicit zeros always count."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import CellDataset
from ..functions.scalar import half_even

METHODS = ("mean-geometric-mean-total", "mean-geometric-mean-log-total")


def totals(counts: DataFrame, cells: DataFrame, round_values: bool = True) -> DataFrame:
    """(cell_id, total) of every cell, 0 for a cell without entries."""
    value = half_even(F.col("value")) if round_values else F.col("value")
    sums = counts.groupBy("cell_id").agg(F.sum(value).alias("total"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def size_factors(counts: DataFrame, cells: DataFrame, method: str = METHODS[0], round_values: bool = True) -> DataFrame:
    """(cell_id, size_factor). The mean of logs is a one-row aggregate joined back."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    x = F.col("total") if method == METHODS[0] else F.ln("total")
    t = totals(counts, cells, round_values)
    scale = t.agg(F.exp(F.avg(F.ln(x))).alias("scale"))
    factor = F.try_divide(x, F.col("scale"))
    return t.crossJoin(F.broadcast(scale)).select("cell_id", F.when(F.isnan(factor) | factor.isNull(), 1.0).otherwise(factor).alias("size_factor"))


def estimate_size_factors(ds: CellDataset, method: str = METHODS[0], round_values: bool = True) -> CellDataset:
    """The dataset with cells.size_factor; unchanged, with a warning, if a cell's total is zero."""
    if not totals(ds.counts, ds.cells, round_values).where("total = 0").isEmpty():
        warnings.warn("The dataset contains cells with zero reads, so size factors can't be calculated. Remove them first.")
        return ds
    return replace(ds, cells=ds.cells.drop("size_factor").join(size_factors(ds.counts, ds.cells, method, round_values), "cell_id"))


def normalized(counts: DataFrame, factors: DataFrame, method: str = "log", pseudocount: float = 1) -> DataFrame:
    """counts with value as log10(x / factor + 1), x / factor ("size_only") or 0/1 ("binary")."""
    if method == "binary":
        return counts.withColumn("value", (F.col("value") > 0).cast("double"))
    scaled = counts.join(factors.select("cell_id", "size_factor"), "cell_id")
    ratio = F.try_divide("value", "size_factor")
    if method == "log":
        if pseudocount != 1:
            raise ValueError("Pseudocount must equal 1 with sparse expression matrices")
        ratio = F.log10(ratio + 1)
    elif method != "size_only":
        raise ValueError(f"unknown norm_method {method!r}")
    return scaled.select("cell_id", "gene_id", ratio.alias("value"))


def log2_normalized(counts: DataFrame, factors: DataFrame, method: str = "log", pseudocount: float | None = None) -> tuple[DataFrame, float]:
    """Stored entries before a reduction, and the value of all implicit zeros."""
    pseudo = (1.0 if method == "log" else 0.0) if pseudocount is None else float(pseudocount)
    if method == "none":
        return counts.withColumn("value", F.col("value") + pseudo), pseudo
    ratio = F.try_divide("value", "size_factor") + pseudo
    out = counts.join(factors.select("cell_id", "size_factor"), "cell_id").select("cell_id", "gene_id", (F.log2(ratio) if method == "log" else ratio).alias("value"))
    return out, math.log2(pseudo) if method == "log" else pseudo


def gene_moments(values: DataFrame, n_cells: DataFrame, zero: float = 0.0) -> DataFrame:
    """(gene_id, mean, variance) over all cells; entries that aren't stored have the value `zero`.

    Sums are of value - zero, so zeros add nothing. Variance is the sample variance.
    """
    d = F.col("value") - zero
    sums = values.groupBy("gene_id").agg(F.sum(d).alias("s"), F.sum(d * d).alias("q")).crossJoin(F.broadcast(n_cells))
    mean = F.try_divide("s", "n")
    return sums.select("gene_id", (mean + zero).alias("mean"), F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1).alias("variance"))


def tfidf(counts: DataFrame, n_cells: DataFrame, scale: float = 1e5) -> DataFrame:
    """ln(1 + scale * x / cell total) * ln(1 + cells / cells that have the gene)."""
    live = counts.where("value <> 0")
    cell = live.groupBy("cell_id").agg(F.sum("value").alias("t"))
    gene = live.groupBy("gene_id").agg(F.count(F.lit(1)).alias("df"))
    joined = live.join(cell, "cell_id").join(gene, "gene_id").crossJoin(F.broadcast(n_cells))
    return joined.select("cell_id", "gene_id", (F.log1p(F.try_divide("value", "t") * scale) * F.ln(1 + F.col("n") / F.col("df"))).alias("value"))


def detect_genes(ds: CellDataset, min_expr: float = 0) -> CellDataset:
    """genes.num_cells_expressed and cells.num_genes_expressed: entries above min_expr. Below 0,
    implicit zeros are above it and are counted from the sizes of the tables."""
    seen = ds.counts.where(F.col("value") > min_expr)
    gone = ds.counts.where(F.col("value") <= min_expr)

    def counted(table: DataFrame, key: str, others: DataFrame, name: str) -> DataFrame:
        if min_expr >= 0:
            n = seen.groupBy(key).agg(F.count(F.lit(1)).alias(name))
            return table.drop(name).join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
        less = gone.groupBy(key).agg(F.count(F.lit(1)).alias("__g"))
        all_ = F.broadcast(others.agg(F.count(F.lit(1)).alias("__a")))
        return table.drop(name).join(less, key, "left").crossJoin(all_).withColumn(name, F.col("__a") - F.coalesce("__g", F.lit(0))).drop("__g", "__a")

    return replace(ds, genes=counted(ds.genes, "gene_id", ds.cells, "num_cells_expressed"), cells=counted(ds.cells, "cell_id", ds.genes, "num_genes_expressed"))


def umi_cutoff(counts: DataFrame, cells: DataFrame, cutoff: float, strict: bool) -> DataFrame:
    """Cells whose total is above (strict) or at least the cutoff, with n_umi."""
    t = totals(counts, cells, round_values=False)
    return t.where(F.col("total") > cutoff if strict else F.col("total") >= cutoff).select("cell_id", F.col("total").alias("n_umi"))
