"""Queries over iterative kernels, persistence, loaders and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import api
from ..dataset import CellDataset
from ..functions.scalar import r6
from ..operators import cluster as cl
from ..operators import graph as gr
from ..operators import mapping as mp
from ..operators import neighbors as nb
from ..operators import normalize as nz
from ..operators import reduce as rd
from ..sources import matrix as mx
from ..sources import store
from ..streaming import ingest
from . import views as v
from .tables import X1, r
from .vectors import COSINE, V, knn_sql


def log2_values(s, d):
    ds = v.x2(s, d)
    x, zero = nz.log2_normalized(ds.counts, v.factors(ds), "log")
    return ds, x, zero


def q35(s, d):
    ds, x, zero = log2_values(s, d)
    model = rd.fit(x, ds.cells, 10, "PCA", zero=zero)
    return s.createDataFrame([(k + 1, float(a * a), float(b)) for k, (a, b) in enumerate(zip(model.sdev, model.variance_explained))], "pc int, variance double, prop_var_expl double").select("pc", r6("variance").alias("variance"), r6("prop_var_expl").alias("prop_var_expl"))


def q36(s, d):
    ds, x, _ = log2_values(s, d)
    t = nz.tfidf(nz.normalized(ds.counts, v.factors(ds), "size_only"), v.n_cells(ds))
    return rd.fit(t, ds.cells, 8, "LSI").project(t, ds.cells).select("cell_id", F.transform("vec", lambda z: r6(z)).alias("vec"))


def q37(s, d):
    """Scores of the fitted cells by projection, with what a dense product gives for their length."""
    ds, x, zero = log2_values(s, d)
    scores = rd.fit(x, ds.cells, 24, "PCA", zero=zero).project(x, ds.cells)
    return scores.select("cell_id", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, z: a + z * z)), 4).alias("norm"))


def q38(s, d):
    x = v.r1(s, d)
    design = x.select("cell_id", (F.col("label") % 2).alias("odd"))
    return rd.residuals(x.select("cell_id", "vec"), design, ["odd"]).select("cell_id", F.posexplode("vec").alias("dim", "z")).select("cell_id", "dim", r6("z").alias("value"))


S38 = f"with {V}, y as (select id, label % 2 as odd, (k - 1)::int as dim, e[k] as z from v, range(1, 65) t(k)), m as (select dim, avg(z) filter (odd = 0) as m0, avg(z) filter (odd = 1) as m1 from y group by 1) select id as cell_id, dim, {r('z - case when odd = 1 then m1 - m0 else 0 end')} as value from y join m using (dim)"


def q38b(s, d):
    """The label as a factor."""
    x = v.r1(s, d)
    out = rd.residuals(x.select("cell_id", "vec"), x.select("cell_id", F.col("label").cast("string").alias("label")), "~ label")
    return out.select("cell_id", F.posexplode("vec").alias("dim", "z")).select("cell_id", "dim", r6("z").alias("value"))


S38B = f"with {V}, y as (select id, label, (k - 1)::int as dim, e[k] as z from v, range(1, 65) t(k)), m as (select dim, label, avg(z) as m from y group by 1, 2), b as (select dim, arg_min(m, label::varchar) as m0 from m group by 1) select id as cell_id, dim, {r('z - (m - m0)')} as value from y join m using (dim, label) join b using (dim)"


def q39b(s, d):
    v.scratch(s)
    x = v.r1(s, d).select("cell_id", "vec", (F.col("cell_id") % 2).alias("side"))
    moved = x.withColumn("vec", F.when(F.col("side") == 1, F.transform("vec", lambda z: z + 0.3)).otherwise(F.col("vec")))
    return rd.mnn_align(moved, "side", [0, 1], k=10).select("cell_id", "batch", F.transform("vec", lambda z: r6(z)).alias("vec"))


def q40a(s, d):
    return rd.umap(v.r1(s, d), epochs=60).select("cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))


def q40b(method):
    def q(s, d):
        v.scratch(s)
        x = v.r1(s, d)
        return cl.cluster_cells(x, 15, method, weight=True, resolution=[0.01, 0.05] if method == "leiden" else None)[0]

    return q


def q40d(s, d):
    v.scratch(s)
    ds, x, zero = log2_values(s, d)
    model = rd.fit(x, ds.cells, 6, "PCA", zero=zero)
    return cl.gene_modules(model.table(s), model.sdev.tolist(), k=5, resolution=0.1)


def q40e(s, d):
    x = v.r1(s, d)
    ref, query = x.where("cell_id % 4 <> 0"), x.where("cell_id % 4 = 0")
    return rd.umap_transform(ref, ref.select("cell_id", F.slice("vec", 1, 2).alias("vec")), query).select("cell_id", r6(F.get("vec", F.lit(0))).alias("x"), r6(F.get("vec", F.lit(1))).alias("y"))


NEAR15 = knn_sql(15, COSINE, "s.id % 4 <> 0", "q.id % 4 = 0")
S40E = f"with {V}, k as ({NEAR15}), w as (select k.id, 1 / (d + 1e-9::double) as w, e from k join v on v.id = nb) select id as cell_id, {r('sum(w * e[1]) / sum(w)')} as x, {r('sum(w * e[2]) / sum(w)')} as y from w group by 1"


def q40f(s, d):
    v.scratch(s)
    x = v.r1(s, d)
    return cl.label_propagation(nb.jaccard_edges(nb.knn(x, x, 10, exclude_self=True)), x, 4)


def q40g(s, d):
    return rd.tsne(v.r1(s, d)).select("cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))


def flat(s, d):
    """Vectors on a noisy curve, so that a tree has a shape to find: the label's angle and place."""
    a = F.col("label") / 10.0 * 3.1 + F.get("vec", F.lit(0)) * 0.2
    return v.r1(s, d).select("cell_id", F.array(3 * F.cos(a) + F.get("vec", F.lit(1)) * 0.3, 3 * F.sin(a) + F.get("vec", F.lit(2)) * 0.3).alias("vec"))


def q41(s, d):
    x = flat(s, d)
    placed, _ = gr.kmeans(x, 12)
    return gr.medoids(placed, nb.knn(x, x, 10, exclude_self=True)).select("center", "cell_id", r6("density").alias("density"))


def q42a(s, d):
    nodes, edges = gr.learn_graph(flat(s, d), n_center=15, minimal_branch_len=3)
    return edges.select("src", "dst", r6("weight").alias("weight"))


def q42b(s, d):
    x = flat(s, d)
    nodes, edges = gr.learn_graph(x, n_center=15, minimal_branch_len=3, close_loop=False)
    return gr.order_cells(x, nodes, edges, root_nodes=[1]).select("cell_id", r6("pseudotime").alias("pseudotime"))


def q48(s, d):
    ds = nz.estimate_size_factors(v.x1(s, d))
    path = v.scratch(s)
    store.save(ds, path, "round trip")
    again = store.load(s, path)
    return again.counts.join(again.cells.select("cell_id", "size_factor"), "cell_id").groupBy("cell_id").agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n_genes"), r6(F.max("size_factor")).alias("size_factor"))


S48 = f"with {X1} select cell_id, {r('sum(value)')} as total, count(*) as n_genes, {r('max(size_factor)')} as size_factor from x join sf using (cell_id) group by 1"


def reloaded(s, ds):
    path = v.scratch(s)
    mx.write_matrix(ds, path)
    again = mx.load_mm(s, f"{path}/matrix.mtx", f"{path}/genes.tsv", f"{path}/barcodes.tsv", feature_columns=["gene_short_name"], cutoff=100)
    return again.counts.join(again.genes, "gene_id").groupBy("gene_short_name").agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


def q49(s, d):
    return reloaded(s, v.x1(s, d))


S49 = f"with {X1}, k as (select cell_id from x group by 1 having sum(value) >= 100) select gene_short_name, {r('sum(value)')} as total, count(*) as n from x join k using (cell_id) join genes using (gene_id) group by 1"


def by_gene(ds):
    named = ds.counts.join(ds.genes, "gene_id")
    return named.groupBy("gene_short_name").agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


def q49c(s, d):
    """A folder as Cell Ranger 2 leaves it; cells with more than 100."""
    path = v.scratch(s)
    mx.write_matrix(v.x1(s, d), f"{path}/outs/filtered_gene_bc_matrices/tpch")
    return by_gene(mx.load_cellranger(s, path))


S49C = S49.replace("sum(value) >= 100", "sum(value) > 100")


def q49d(s, d):
    """A folder as Cell Ranger 3 leaves it: every fifth feature is no gene and stays out."""
    path, ds = v.scratch(s), v.x1(s, d)
    folder = f"{path}/outs/filtered_feature_bc_matrix"
    mx.write_matrix(ds, f"{path}/plain")
    for old, new in (("matrix.mtx", "matrix.mtx.gz"), ("barcodes.tsv", "barcodes.tsv.gz")):
        s.read.text(f"{path}/plain/{old}").coalesce(1).write.text(f"{folder}/{new}")
    kind = F.when(F.split("value", "\t")[0].cast("long") % 5 == 0, "Antibody Capture").otherwise("Gene Expression")
    s.read.text(f"{path}/plain/genes.tsv").select(F.concat_ws("\t", "value", kind).alias("value")).coalesce(1).write.text(f"{folder}/features.tsv.gz")
    return by_gene(mx.load_cellranger(s, path))


S49D = S49C.replace("from x group by 1", "from x where gene_id % 5 <> 0 group by 1").replace("using (gene_id) group by 1", "using (gene_id) where gene_id % 5 <> 0 group by 1")


def q49e(s, d):
    """Lines of gene, cell and count; cells with at least 100."""
    path = v.scratch(s)
    mx.write_matrix(v.x1(s, d), path)
    s.read.text(f"{path}/matrix.mtx").where("not startswith(value, '%')").withColumn("i", F.monotonically_increasing_id()).where("i > 0").select("value").coalesce(1).write.text(f"{path}/triplets.txt")
    return by_gene(mx.load_mtx(s, f"{path}/triplets.txt", f"{path}/genes.tsv", f"{path}/barcodes.tsv"))


def q56(s, d):
    """A function of one gene: its largest and mean stored count, and in how many cells."""
    def one(gene, rows):
        return pd.DataFrame([(gene, float(rows["value"].max()), float(rows["value"].mean()), len(rows))], columns=["gene_id", "largest", "mean", "n"])

    out = mp.map_genes(v.x1(s, d).counts, one, "gene_id long, largest double, mean double, n long")
    return out.select("gene_id", "largest", r6("mean").alias("mean"), "n")


S56 = f"with {X1} select gene_id, max(value)::double as largest, {r('avg(value)')} as mean, count(*) as n from x group by 1"


def q57(s, d):
    """The cells of a region, with their entries."""
    x = v.r1(s, d)
    counts = x.select("cell_id", F.posexplode("vec").alias("gene_id", "value")).where("value > 0")
    ds = CellDataset(counts, x.select("cell_id", "label"), counts.select("gene_id").distinct(), {"PCA": x.select("cell_id", "vec")})
    chosen = api.choose_cells(ds, F.expr("x1 > 0 and x2 < 0.05"), "PCA")
    return chosen.counts.join(chosen.cells, "cell_id").groupBy("cell_id", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


S57 = f"with {V} select id as cell_id, label, len(list_filter(e, lambda z: z > 0)) as n, {r('list_sum(list_filter(e, lambda z: z > 0))')} as total from v where e[1] > 0 and e[2] < 0.05::double and len(list_filter(e, lambda z: z > 0)) > 0"


def q50(s, d):
    events = v.table(s, d, "events").select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id"), "value")
    path = v.scratch(s)
    events.repartition(4, "cell_id").write.parquet(f"{path}/in")
    stream = ingest.read_stream(s, f"{path}/in", events.schema)
    out = ingest.run_once(ingest.running_counts(stream), f"{path}/out")
    return out.select("cell_id", "gene_id", r6("value").alias("value"))


S50 = f"select user_id as cell_id, event_type as gene_id, {r('sum(value)')} as value from events group by 1, 2"


def q54(s, d):
    v.scratch(s)
    nodes = s.createDataFrame([(k, [0.0] * 64) for k in range(6)], "node int, vec array<double>")
    edges = s.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (1, 3, 0.5), (4, 5, 1.0)], "src int, dst int, weight double")
    return gr.pseudotime(edges, nodes, nodes.where("node = 0").select("node")).select("node", r6("pseudotime").alias("pseudotime"))


S54 = "select * from (values (0, 0.0::double), (1, 1.0::double), (2, 3.0::double), (3, 1.5::double), (4, 'Infinity'::double), (5, 'Infinity'::double)) t(node, pseudotime)"

QUERIES: dict[str, tuple] = {
    "q35_pca": (q35, None), "q36_lsi": (q36, None), "q37_projection": (q37, None), "q38_residual_alignment": (q38, S38), "q38b_residual_factor": (q38b, S38B), "q39b_mnn_alignment": (q39b, None),
    "q40a_umap": (q40a, None), "q40b_leiden": (q40b("leiden"), None), "q40c_louvain": (q40b("louvain"), None), "q40d_gene_modules": (q40d, None),
    "q40e_umap_transform": (q40e, S40E), "q40f_label_propagation": (q40f, None), "q40g_tsne": (q40g, None), "q41_kmeans_medoids": (q41, None),
    "q42a_principal_graph": (q42a, None), "q42b_pseudotime": (q42b, None), "q48_save_load": (q48, S48), "q49_matrix_files": (q49, S49),
    "q49c_cellranger2": (q49c, S49C), "q49d_cellranger3": (q49d, S49D), "q49e_triplets": (q49e, S49), "q56_map_genes": (q56, S56), "q57_choose_cells": (q57, S57), "q50_stream_counts": (q50, S50), "q54_unreachable_nodes": (q54, S54),
}
