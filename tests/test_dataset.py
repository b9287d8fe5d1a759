import warnings

import pytest
from pyspark.sql import functions as F

from sparkcell.dataset import CellDataset, combine, gene_ids, new_dataset
from sparkcell.operators import aggregate as agg
from sparkcell.operators import normalize as nz
from sparkcell.operators.markers import marker_lines, specificity


@pytest.fixture(scope="module")
def ds(spark):
    counts = spark.createDataFrame([("a", "g1", 1.0), ("a", "g2", 3.0), ("b", "g1", 2.0), ("b", "g3", 0.0)], "cell_id string, gene_id string, value double")
    cells = spark.createDataFrame([("a", "x"), ("b", "y")], "cell_id string, kind string")
    genes = spark.createDataFrame([("g1", "n"), ("g2", "n"), ("g3", "m")], "gene_id string, gene_short_name string")
    return new_dataset(counts, cells, genes)


def test_zeros_are_not_stored(ds):
    assert ds.counts.count() == 3


def test_integrity_errors(spark, ds):
    with pytest.raises(ValueError, match="cells must contain"):
        new_dataset(ds.counts, ds.cells.where("cell_id = 'a'"), ds.genes)
    with pytest.raises(ValueError, match="genes must contain"):
        new_dataset(ds.counts, ds.cells, ds.genes.where("gene_id = 'g1'"))
    with pytest.raises(ValueError, match="unique"):
        new_dataset(ds.counts.union(ds.counts), ds.cells, ds.genes)
    with pytest.warns(UserWarning, match="gene_short_name"):
        new_dataset(ds.counts)


def test_size_factors_of_a_zero_cell_leave_the_dataset(spark, ds):
    more = ds.with_(cells=ds.cells.union(spark.createDataFrame([("c", "x")], ds.cells.schema)))
    with pytest.warns(UserWarning, match="zero reads"):
        assert nz.estimate_size_factors(more) is more


def test_size_factors_have_geometric_mean_one(ds):
    out = nz.estimate_size_factors(ds).cells.agg(F.exp(F.avg(F.ln("size_factor")))).first()[0]
    assert out == pytest.approx(1)


def test_pseudocount_error(ds):
    with pytest.raises(ValueError, match="Pseudocount"):
        nz.normalized(ds.counts, nz.size_factors(ds.counts, ds.cells), pseudocount=2)


def test_missing_parts_say_what_to_run(ds):
    with pytest.raises(ValueError, match="No clusters calculated"):
        ds.part("clusters", "UMAP")
    assert ds.put("coords", "PCA", ds.cells).identity().count() == 1
    assert ds.cleared().lineage == ()


def test_aggregate_needs_groups_and_drops_single_gene_groups(spark, ds):
    with pytest.raises(ValueError):
        agg.aggregate(ds.counts)
    groups = spark.createDataFrame([("g1", "p"), ("g2", "p"), ("g3", "q")], "gene_id string, grp string")
    assert {r.row for r in agg.aggregate(ds.counts, groups).collect()} == {"p"}


def test_gene_lookup_takes_the_first_match(spark, ds):
    names = spark.createDataFrame([("n",), ("g3",), ("zz",)], "name string")
    assert {(r.name, r.gene_id) for r in gene_ids(ds.genes, names).collect()} == {("n", "g1"), ("g3", "g3")}


def test_combine(spark, ds):
    assert combine({"one": ds}) is ds
    with pytest.raises(ValueError):
        combine({})
    both = combine({"p": ds, "q": ds})
    assert both.counts.count() == 6 and both.cells.count() == 4
    assert {r.cell_id for r in both.cells.collect()} == {"a_p", "b_p", "a_q", "b_q"}


def test_specificity_bounds(spark):
    x = spark.createDataFrame([("g", "a", 5.0), ("g", "b", 0.0), ("h", "a", 0.0), ("h", "b", 0.0)], "gene_id string, grp string, value double")
    got = {(r.gene_id, r.grp): r.specificity for r in specificity(x).collect()}
    assert got[("g", "a")] == pytest.approx(1) and got[("g", "b")] == pytest.approx(0, abs=1e-6) and got[("h", "a")] == 0


def test_marker_lines_clean_names(spark):
    x = spark.createDataFrame([("t:1", "a(b)", 0.9), ("t:1", "c", 0.5)], "grp string, gene_short_name string, marker_score double")
    assert marker_lines(x).first().line == "> t.1\nexpressed: a.b., c"


def test_empty_tables(spark, ds):
    none = ds.counts.where("value < 0")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        empty = CellDataset(none, ds.cells.where("false"), ds.genes)
    assert nz.size_factors(empty.counts, empty.cells).count() == 0
    assert nz.detect_genes(empty).genes.agg(F.sum("num_cells_expressed")).first()[0] == 0
    assert agg.percent_positive(none, ds.cells.select("cell_id", F.col("kind").alias("grp"))).count() == 0


def test_combine_keeps_types_and_places(spark):
    counts = spark.createDataFrame([(1, 10, 2.0), (2, 11, 1.0)], "cell_id long, gene_id long, value double")
    place = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 3.0])], "cell_id long, vec array<double>")
    genes = lambda names: spark.createDataFrame([(10, names[0], 5), (11, names[1], 6)], "gene_id long, gene_short_name string, length int")
    one = new_dataset(counts, genes=genes(["a", "b"])).with_(coords={"PCA": place, "UMAP": place})
    two = new_dataset(counts, genes=genes(["a", "z"])).with_(coords={"PCA": place})
    both = combine({"x": one, "y": two}, keep_reduced_dims=True)
    assert dict(both.genes.dtypes)["length"] == "int"
    assert {(r.gene_id, r.gene_short_name, r.length) for r in both.genes.collect()} == {(10, "a", 5), (11, "conf", 6)}
    assert set(both.coords) == {"PCA"} and both.coords["PCA"].count() == 4 and not combine({"x": one, "y": two}).coords
    assert both.coords["PCA"].join(both.cells, "cell_id", "left_anti").isEmpty()
