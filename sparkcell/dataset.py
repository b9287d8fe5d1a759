"""The container: counts, cells and genes as lazy DataFrames, with what operators add to them."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellDataset:
    """counts(cell_id, gene_id, value) holds non-zero entries, unique by (cell_id, gene_id).

    Every operator returns a new dataset; members are lazy, so Catalyst sees through it. coords,
    clusters, graphs and models are keyed by the method that made them.
    """

    counts: DataFrame
    cells: DataFrame
    genes: DataFrame
    coords: Mapping[str, DataFrame] = field(default_factory=dict)
    clusters: Mapping[str, DataFrame] = field(default_factory=dict)
    graphs: Mapping[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    pseudotime: Mapping[str, DataFrame] = field(default_factory=dict)
    models: Mapping[str, dict] = field(default_factory=dict)
    lineage: tuple[tuple[str, str, str, str], ...] = ()
    indexes: Mapping[str, object] = field(default_factory=dict)

    def with_(self, **members) -> "CellDataset":
        return replace(self, **members)

    def part(self, name: str, method: str):
        """A member of one method; says what has to run first if it is missing."""
        found = getattr(self, name).get(method)
        if found is None:
            first = {"coords": "preprocess or reduce_dimension", "clusters": "cluster_cells", "graphs": "learn_graph", "pseudotime": "order_cells", "models": "preprocess", "indexes": "make_index"}[name]
            raise ValueError(f"No {name} calculated for method {method}. Please run {first} with method {method} first.")
        return found

    def put(self, name: str, method: str, value, model: str = "") -> "CellDataset":
        made = hashlib.sha256(f"{self.lineage}{name}{method}".encode()).hexdigest()[:12]
        before = self.lineage[-1][2] if self.lineage else ""
        return replace(self, **{name: {**getattr(self, name), method: value}}, lineage=(*self.lineage, (name, method, made, before)))

    def identity(self) -> DataFrame:
        """kind, method, matrix_id and prev_matrix_id of what was made, in order."""
        return self.counts.sparkSession.createDataFrame(list(self.lineage), "kind string, method string, matrix_id string, prev_matrix_id string")

    def cleared(self) -> "CellDataset":
        """Without anything that operators derived."""
        return CellDataset(self.counts, self.cells, self.genes)

    def subset(self, genes: Column | None = None, cells: Column | None = None) -> "CellDataset":
        """The genes and cells whose metadata satisfy the predicates; entries follow by semi-join."""
        g = self.genes if genes is None else self.genes.where(genes)
        c = self.cells if cells is None else self.cells.where(cells)
        x = self.counts
        if genes is not None:
            x = x.join(g.select("gene_id"), "gene_id", "left_semi")
        if cells is not None:
            x = x.join(c.select("cell_id"), "cell_id", "left_semi")
        coords = {k: v if cells is None else v.join(c.select("cell_id"), "cell_id", "left_semi") for k, v in self.coords.items()}
        return CellDataset(x, c, g, coords)


def new_dataset(counts: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None, check: bool = True) -> CellDataset:
    """A dataset from its tables. Metadata default to the ids that occur. With check, duplicate ids,
    duplicate entries and entries without metadata are errors; genes without gene_short_name warn."""
    x = counts.select("cell_id", "gene_id", F.col("value").cast("double").alias("value")).where("value <> 0")
    c = cells if cells is not None else x.select("cell_id").distinct().withColumn("cell", F.col("cell_id"))
    g = genes if genes is not None else x.select("gene_id").distinct()
    if "gene_short_name" not in g.columns:
        warnings.warn("genes must contain a column named 'gene_short_name' for certain functions")
    if check:
        for what, table, keys in (("cells", c, ["cell_id"]), ("genes", g, ["gene_id"]), ("counts", x, ["cell_id", "gene_id"])):
            if not table.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ValueError(f"{what} must have unique {' and '.join(keys)}")
        if not x.join(c, "cell_id", "left_anti").isEmpty():
            raise ValueError("cells must contain every cell_id of counts")
        if not x.join(g, "gene_id", "left_anti").isEmpty():
            raise ValueError("genes must contain every gene_id of counts")
    return CellDataset(x, c, g)


def gene_ids(genes: DataFrame, names: DataFrame, order: str = "gene_id") -> DataFrame:
    """(name, gene_id): each name as an id if it is one, else the first gene with that short name."""
    as_id = names.join(genes, F.col("name").cast("string") == F.col("gene_id").cast("string")).select("name", "gene_id")
    rest = names.join(as_id, "name", "left_anti")
    by_name = rest.join(genes, F.col("name") == F.col("gene_short_name")).groupBy("name").agg(F.min_by("gene_id", order).alias("gene_id"))
    return as_id.unionByName(by_name)


def combine(datasets: Mapping[str, CellDataset], keep_all_genes: bool = True, cell_names_unique: bool = False, sample_col: str = "sample", keep_reduced_dims: bool = False) -> CellDataset:
    """One dataset of several. Cell ids get "_<name>" unless they are unique; genes are the union or
    the intersection; missing metadata are null; gene metadata that differ become "conf", and columns
    without any such gene keep their type. With keep_reduced_dims, coordinates of methods that all
    datasets have are kept."""
    if not datasets:
        raise ValueError("there is nothing to combine")
    if len(datasets) == 1:
        return next(iter(datasets.values()))
    rename = lambda df, name: df if cell_names_unique else df.withColumn("cell_id", F.concat_ws("_", F.col("cell_id").cast("string"), F.lit(name)))
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    counts = union([rename(d.counts, k) for k, d in datasets.items()])
    cells = union([rename(d.cells, k).withColumn(sample_col, F.lit(k)) for k, d in datasets.items()])
    rows = union([d.genes.withColumn("__n", F.lit(n)) for n, d in enumerate(datasets.values())])
    attributes = [c for c in rows.columns if c not in ("gene_id", "__n")]
    differ = rows.groupBy("gene_id").agg(*((F.count_distinct(c) > 1).alias(c) for c in attributes)).agg(*(F.max(c).alias(c) for c in attributes)).first() if attributes else {}
    merged = [F.when(F.count_distinct(c) > 1, F.lit("conf")).otherwise(F.min(F.col(c).cast("string"))).alias(c) if differ[c] else F.min(c).alias(c) for c in attributes]
    genes = rows.groupBy("gene_id").agg(*merged, F.count_distinct("__n").alias("__n"))
    if not keep_all_genes:
        genes = genes.where(F.col("__n") == len(datasets))
        counts = counts.join(genes.select("gene_id"), "gene_id", "left_semi")
    shared = [m for m in next(iter(datasets.values())).coords if all(m in d.coords for d in datasets.values())] if keep_reduced_dims else []
    coords = {m: union([rename(d.coords[m], k) for k, d in datasets.items()]) for m in shared}
    return CellDataset(counts, cells, genes.drop("__n"), coords)
