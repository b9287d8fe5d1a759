import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcell import api
from sparkcell.dataset import new_dataset
from sparkcell.operators.mapping import entropy, js_distance, map_genes, ward_order
from sparkcell.operators.normalize import estimate_size_factors
from sparkcell.sources import store


@pytest.fixture(scope="module")
def ds(spark):
    r = np.random.default_rng(1)
    rows = [(f"c{c:03d}", f"g{g}", float(r.poisson(6 if g // 4 == c // 30 else 0.6))) for c in range(90) for g in range(12)]
    counts = spark.createDataFrame([x for x in rows if x[2]], "cell_id string, gene_id string, value double")
    cells = spark.createDataFrame([(f"c{c:03d}", f"t{c // 30}", "u" if c % 2 else "v") for c in range(90)], "cell_id string, kind string, side string")
    genes = spark.createDataFrame([(f"g{g}", f"n{g}") for g in range(12)], "gene_id string, gene_short_name string")
    return estimate_size_factors(new_dataset(counts, cells, genes))


def test_the_whole_way(spark, ds):
    with pytest.raises(ValueError, match="No clusters calculated"):
        api.learn_graph(api.preprocess(ds, num_dim=5), method="PCA")
    x = api.preprocess(ds, num_dim=5)
    assert x.identity().count() == 1
    again = api.preprocess_transform(ds, x.models).coords["PCA"]
    a, b = (np.array([r.vec for r in t.orderBy("cell_id").collect()]) for t in (x.coords["PCA"], again))
    assert np.allclose(a, b, atol=1e-6)
    x = api.cluster_cells(x, "PCA", k=8, resolution=0.3)
    tab = x.clusters["PCA"].join(ds.cells, "cell_id").groupBy("kind").agg(F.count_distinct("cluster").alias("n")).collect()
    assert len(tab) == 3
    top = api.top_markers(x, "kind", 3, "PCA").collect()
    assert len(top) >= 9 and all(int(r.gene_id[1:]) // 4 == int(r.cell_group[1:]) and (r.marker_test_p_value < 0.01 or r.marker_test_p_value == 1) for r in top)
    moran = api.graph_test(x, method="PCA", k=8).collect()
    assert all(r.status == "OK" and r.q_value < 0.05 for r in moran)
    blank = x.with_(cells=x.cells.withColumn("kind", F.when(F.col("cell_id") > "c005", F.col("kind"))))
    full = api.fix_missing_cell_labels(blank, "kind", "PCA", 9).cells.collect()
    assert sum(r.kind == f"t{int(r.cell_id[1:]) // 30}" for r in full) >= 88
    fits = api.fit_models(x, "~ kind", "poisson")
    assert fits.where("status = 'OK'").count() == 12


def test_trajectory(spark, ds):
    x = api.cluster_cells(api.reduce_dimension(api.preprocess(ds, num_dim=3), "PCA"), "PCA", k=10)
    x = api.learn_graph(x, "PCA", use_partition=False, n_center=8, minimal_branch_len=1)
    x = api.order_cells(x, "PCA", root_cells=["c000"])
    t = x.pseudotime["PCA"].agg(F.min("pseudotime"), F.count("pseudotime")).first()
    assert t[0] >= 0 and t[1] == 90
    nodes, _ = x.graphs["PCA"]
    ids = sorted(r.node for r in nodes.collect())
    assert 0 < api.choose_graph_segments(x, ids[0], ids[-1:], "PCA").cells.count() <= 90
    assert api.choose_cells(x, F.col("x1") > 0, "PCA").cells.count() < 90


def test_alignment_and_errors(spark, ds):
    x = api.preprocess(ds, num_dim=4)
    assert api.align(x, alignment_group="side", alignment_k=5).coords["Aligned"].count() == 90
    with pytest.raises(ValueError, match="must be one of"):
        api.preprocess(ds, "other")
    with pytest.raises(ValueError, match="cluster_method"):
        api.cluster_cells(x, "PCA", cluster_method="other")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert api.aggregate_gene_expression(ds, cell_group_df=ds.cells.select("cell_id", F.col("kind").alias("grp"))).count() == 36


def test_helpers(spark, ds):
    assert entropy(np.array([0.5, 0.5])) == 1 and entropy(np.array([-1.0])) == float("inf")
    assert js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert sorted(ward_order(np.random.default_rng(2).normal(size=(5, 4)))) == list(range(5))
    sums = map_genes(ds.counts, lambda g, rows: rows.groupby(lambda _: g)["value"].sum().reset_index().rename(columns={"index": "gene_id"}), "gene_id string, value double")
    assert {r.gene_id: r.value for r in sums.collect()} == {r.gene_id: r.s for r in ds.counts.groupBy("gene_id").agg(F.sum("value").alias("s")).collect()}


def test_index_goes_with_the_dataset(spark, tmp_path):
    x = spark.createDataFrame([(k, [float(k % 7), float(k // 7)]) for k in range(70)], "cell_id long, vec array<double>")
    counts = spark.createDataFrame([(k, 1, 2.0) for k in range(70)], "cell_id long, gene_id long, value double")
    ds = new_dataset(counts).with_(coords={"PCA": x})
    with pytest.raises(ValueError, match="make_index"):
        api.search_index(ds, x, 3, "PCA")
    ds = api.make_index(ds, "PCA")
    assert api.has_index(ds, "PCA") and not api.has_index(api.clear_indexes(ds, "PCA"), "PCA") and not api.clear_indexes(ds).indexes
    store.save(ds, str(tmp_path / "d"))
    again = store.load(spark, str(tmp_path / "d"))
    pick = lambda d: sorted(map(tuple, api.search_index(d, x.where("cell_id < 9"), 4, "PCA").collect()))
    assert pick(again) == pick(ds) and len(pick(ds)) == 36
