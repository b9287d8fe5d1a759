"""The analysis as calls on a CellDataset: each needs what came before and returns a new dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import CellDataset
from .operators import aggregate as _agg
from .operators import cluster as _cl
from .operators import graph as _gr
from .operators import markers as _mk
from .operators import models as _md
from .operators import neighbors as _nb
from .operators import normalize as _nz
from .operators import reduce as _rd
from .operators import spatial as _sp
from .operators import transfer as _tr

REDUCTIONS = ("PCA", "LSI", "Aligned", "UMAP", "tSNE")


def _factors(ds: CellDataset) -> DataFrame:
    if "size_factor" not in ds.cells.columns:
        raise ValueError("No size factors. Please run estimate_size_factors first.")
    return ds.cells.select("cell_id", "size_factor")


def _values(ds: CellDataset, method: str, norm_method: str, pseudo_count: float | None) -> tuple[DataFrame, float]:
    x, zero = _nz.log2_normalized(ds.counts, _factors(ds), norm_method, pseudo_count)
    return (_nz.tfidf(x, ds.cells.agg(F.count(F.lit(1)).alias("n"))), 0.0) if method == "LSI" else (x, zero)


def preprocess(ds: CellDataset, method: str = "PCA", num_dim: int = 50, norm_method: str = "log", use_genes: DataFrame | None = None, pseudo_count: float | None = None, scaling: bool = True) -> CellDataset:
    """PCA or LSI coordinates and their model."""
    if method not in ("PCA", "LSI"):
        raise ValueError("method must be one of 'PCA' or 'LSI'")
    used = ds if use_genes is None else ds.with_(counts=ds.counts.join(use_genes.select("gene_id"), "gene_id", "left_semi"))
    x, zero = _values(used, method, norm_method, pseudo_count)
    model = _rd.fit(x, ds.cells, num_dim, method, scaling, zero)
    kept = {"reduction": model, "norm_method": norm_method, "pseudo_count": pseudo_count}
    return ds.put("coords", method, model.project(x, ds.cells)).with_(models={**ds.models, method: kept})


def preprocess_transform(ds: CellDataset, models: dict, method: str = "PCA") -> CellDataset:
    """New cells in the space of a fitted PCA or LSI; under half of its genes is a warning."""
    import warnings

    kept = models[method]
    model = kept["reduction"]
    x, _ = _values(ds, method, kept["norm_method"], kept["pseudo_count"])
    shared = ds.genes.join(model.table(ds.counts.sparkSession).select("gene_id"), "gene_id", "left_semi").count()
    if shared == 0:
        raise ValueError("no genes are shared with the model")
    if 2 * shared < len(model.genes):
        warnings.warn(f"only {shared} of the model's {len(model.genes)} genes are in the dataset")
    return ds.put("coords", method, model.project(x, ds.cells)).with_(models={**ds.models, method: kept})


def align(ds: CellDataset, preprocess_method: str = "PCA", alignment_group: str | None = None, alignment_k: int = 20, residual_columns: list[str] | None = None) -> CellDataset:
    """Aligned coordinates: less the columns' linear effects, then batches joined by mutual neighbours."""
    x = ds.part("coords", preprocess_method)
    if residual_columns:
        x = _rd.residuals(x, ds.cells.select("cell_id", *residual_columns), residual_columns)
    if alignment_group:
        x = x.join(ds.cells.select("cell_id", alignment_group), "cell_id")
        order = [r[0] for r in x.groupBy(alignment_group).count().orderBy(F.desc("count"), alignment_group).collect()]
        x = _rd.mnn_align(x, alignment_group, order, alignment_k).select("cell_id", "vec")
    return ds.put("coords", "Aligned", x)


def reduce_dimension(ds: CellDataset, method: str = "UMAP", preprocess_method: str | None = None, max_components: int = 2, **options) -> CellDataset:
    """UMAP or t-SNE of preprocessed coordinates, or those as they are; what was learned on the
    method before is dropped."""
    base = preprocess_method or ("Aligned" if "Aligned" in ds.coords else "PCA")
    if method not in REDUCTIONS:
        raise ValueError(f"method must be one of {REDUCTIONS}")
    x = ds.part("coords", base if method in ("UMAP", "tSNE") else method)
    y = _rd.umap(x, dims=max_components, **options) if method == "UMAP" else _rd.tsne(x, max_components, **options) if method == "tSNE" else x
    drop = lambda m: {k: v for k, v in m.items() if k != method}
    ds = ds.with_(clusters=drop(ds.clusters), graphs=drop(ds.graphs), pseudotime=drop(ds.pseudotime))
    return ds.put("coords", method, y)


def reduce_dimension_transform(ds: CellDataset, reference: CellDataset, preprocess_method: str = "PCA", **options) -> CellDataset:
    """New cells on the reference's UMAP, by their neighbours in the preprocessed space."""
    y = _rd.umap_transform(reference.part("coords", preprocess_method), reference.part("coords", "UMAP"), ds.part("coords", preprocess_method), **options)
    return ds.put("coords", "UMAP", y)


def cluster_cells(ds: CellDataset, method: str = "UMAP", cluster_method: str = "leiden", **options) -> CellDataset:
    if cluster_method not in ("leiden", "louvain"):
        raise ValueError("cluster_method must be one of 'leiden', 'louvain'")
    return ds.put("clusters", method, _cl.cluster_cells(ds.part("coords", method), method=cluster_method, **options)[0])


def learn_graph(ds: CellDataset, method: str = "UMAP", **options) -> CellDataset:
    return ds.put("graphs", method, _gr.learn_graph(ds.part("coords", method), ds.part("clusters", method), **options))


def order_cells(ds: CellDataset, method: str = "UMAP", root_nodes: list | None = None, root_cells: list | None = None) -> CellDataset:
    nodes, edges = ds.part("graphs", method)
    return ds.put("pseudotime", method, _gr.order_cells(ds.part("coords", method), nodes, edges, root_nodes, root_cells))


def _groups(ds: CellDataset, by: str, method: str) -> DataFrame:
    if by in ("cluster", "partition"):
        return ds.part("clusters", method).select("cell_id", F.col(by).cast("string").alias("grp"))
    if by not in ds.cells.columns:
        raise ValueError(f"{by} is not a column of the cells")
    return ds.cells.select("cell_id", F.col(by).cast("string").alias("grp"))


def top_markers(ds: CellDataset, group_cells_by: str = "cluster", genes_to_test_per_group: int = 25, method: str = "UMAP", marker_sig_test: bool = True, reference_cells: int | None = None) -> DataFrame:
    groups = _groups(ds, group_cells_by, method)
    top = _mk.top_n(_mk.marker_scores(ds.counts, _factors(ds), groups), genes_to_test_per_group)
    if marker_sig_test:
        top = _mk.marker_test(top, ds.counts, _factors(ds), groups, reference_cells)
    return top.join(ds.genes.select("gene_id", "gene_short_name"), "gene_id").withColumnRenamed("grp", "cell_group")


def aggregate_gene_expression(ds: CellDataset, gene_group_df: DataFrame | None = None, cell_group_df: DataFrame | None = None, norm_method: str = "log", pseudocount: float = 1, scale_agg_values: bool = True, max_agg_value: float = 3, min_agg_value: float = -3, exclude_na: bool = True, gene_agg_fun: str = "sum", cell_agg_fun: str = "mean") -> DataFrame:
    x = _agg.aggregate(_nz.normalized(ds.counts, _factors(ds), norm_method, pseudocount), gene_group_df, cell_group_df, gene_agg_fun, cell_agg_fun, exclude_na=exclude_na)
    return _agg.scaled(x, min_agg_value, max_agg_value) if scale_agg_values else x


def fit_models(ds: CellDataset, model_formula_str: str, expression_family: str = "quasipoisson", method: str = "UMAP", **options) -> DataFrame:
    """Models whose formulas may also use cluster, partition and pseudotime."""
    cells = ds.cells
    if method in ds.clusters:
        cells = cells.join(ds.clusters[method].select("cell_id", F.col("cluster").cast("string").alias("cluster"), F.col("partition").cast("string").alias("partition")), "cell_id", "left")
    if method in ds.pseudotime:
        cells = cells.join(ds.pseudotime[method], "cell_id", "left")
    _factors(ds)
    return _md.fit_models(ds.counts, cells, model_formula_str, expression_family, **options)


def graph_test(ds: CellDataset, neighbor_graph: str = "knn", method: str = "UMAP", k: int = 25, statistic: str = "Moran_I", alternative: str = "greater") -> DataFrame:
    """Autocorrelation over the neighbour graph, or over those of its pairs that the principal graph
    allows; values are log10(x / size factor + 0.1)."""
    x = ds.part("coords", method)
    near = _nb.knn(x, x, k, exclude_self=True).select("cell_id", "neighbor")
    if neighbor_graph == "principal_graph":
        nodes, edges = ds.part("graphs", method)
        near = _sp.feasible(near, _nb.nearest_vertex(x, nodes), edges)
    elif neighbor_graph != "knn":
        raise ValueError("neighbor_graph must be one of 'knn', 'principal_graph'")
    value = F.log10(F.try_divide("value", "size_factor") + 0.1)
    values = ds.counts.join(_factors(ds), "cell_id").select("cell_id", "gene_id", value.alias("value"))
    return _sp.graph_test(values, ds.genes, ds.cells, _sp.weights(near), statistic, alternative, zero=-1.0)


def find_gene_modules(ds: CellDataset, preprocess_method: str = "PCA", **options) -> DataFrame:
    if preprocess_method not in ds.models:
        ds.part("models", preprocess_method)
    model = ds.models[preprocess_method]["reduction"]
    return _cl.gene_modules(model.table(ds.counts.sparkSession), model.sdev.tolist(), **options)


def transfer_cell_labels(query: CellDataset, reference: CellDataset, column: str, method: str = "UMAP", k: int = 10, **options) -> CellDataset:
    """The query with the reference's column by its neighbours."""
    labels = reference.cells.select("cell_id", F.col(column).alias("label"))
    found = _tr.transfer(reference.part("coords", method), query.part("coords", method), labels, k, **options)
    return query.with_(cells=query.cells.drop(column).join(found.withColumnRenamed("label", column), "cell_id", "left"))


def make_index(ds: CellDataset, method: str = "UMAP", config: _nb.KnnConfig = _nb.KnnConfig(method="ivf")) -> CellDataset:
    """ds with a neighbour index of its cells' coordinates: built once, searched many times."""
    return ds.put("indexes", method, _nb.KnnIndex.build(ds.part("coords", method), config))


def search_index(ds: CellDataset, query: DataFrame, k: int, method: str = "UMAP", **options) -> DataFrame:
    """The k nearest of ds's cells to each row of query (cell_id, vec)."""
    return ds.part("indexes", method).search(query, k, **options)


def has_index(ds: CellDataset, method: str = "UMAP") -> bool:
    return method in ds.indexes


def clear_indexes(ds: CellDataset, method: str | None = None) -> CellDataset:
    """ds without the index of a method, or without any."""
    return ds.with_(indexes={} if method is None else {k: i for k, i in ds.indexes.items() if k != method})


def fix_missing_cell_labels(ds: CellDataset, column: str, method: str = "UMAP", k: int = 10, **options) -> CellDataset:
    labels = ds.cells.select("cell_id", F.col(column).alias("label"))
    found = _tr.fill_missing(ds.part("coords", method), labels, k, **options)
    return ds.with_(cells=ds.cells.drop(column).join(found.withColumnRenamed("label", column), "cell_id", "left"))


def choose_cells(ds: CellDataset, predicate: Column, method: str = "UMAP") -> CellDataset:
    """The cells whose place (columns x1, x2, ...) satisfies the predicate."""
    x = ds.part("coords", method)
    dims = len(x.first()["vec"])
    chosen = x.select("cell_id", *(F.get("vec", F.lit(k)).alias(f"x{k + 1}") for k in range(dims))).where(predicate).select("cell_id")
    semi = lambda t: t.join(chosen, "cell_id", "left_semi")
    return CellDataset(semi(ds.counts), semi(ds.cells), ds.genes, {k: semi(v) for k, v in ds.coords.items()})


def choose_graph_segments(ds: CellDataset, start, ends: list, method: str = "UMAP") -> CellDataset:
    """The cells whose nearest vertex is on a shortest path from start to one of ends."""
    nodes, edges = ds.part("graphs", method)
    keep = _gr.path_nodes(ds.counts.sparkSession, edges, start, ends)
    chosen = _nb.nearest_vertex(ds.part("coords", method), nodes).join(F.broadcast(keep), "node", "left_semi").select("cell_id")
    semi = lambda t: t.join(chosen, "cell_id", "left_semi")
    return CellDataset(semi(ds.counts), semi(ds.cells), ds.genes, {k: semi(v) for k, v in ds.coords.items()})
