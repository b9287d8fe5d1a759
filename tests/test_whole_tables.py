"""Queries that have to cover every row of their tables, on tables where a subset would show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcell.operators import aggregate as agg
from sparkcell.operators import glm
from sparkcell.plans import views as v
from sparkcell.plans.catalog import QUERIES
from tests.compare import SF, agrees

LARGER = "/root/testdata/sf0.01"


def test_p_adjust_covers_all_events(spark):
    query, sql = QUERIES["q24_p_adjust"]
    assert query(spark, SF).count() == v.table(spark, SF, "events").count()
    assert "% 5" not in sql
    agrees(spark, query, sql)


def test_gaussian_fits_cover_all_genes(spark):
    query, sql = QUERIES["q29_gaussian_fits"]
    assert v.x1(spark, LARGER).counts.select("gene_id").distinct().count() > 200 and "< 200" not in sql
    agrees(spark, query, sql, LARGER)


def test_binomial_fits_cover_all_genes_and_cells(spark):
    ds = v.x2(spark, LARGER)
    cells = ds.cells.join(v.factors(ds), "cell_id").orderBy("cell_id").toPandas()
    assert (cells.cell_id >= 400).any()
    x = np.column_stack([np.ones(len(cells)), cells.covariate / 10000])
    rows = ds.counts.select("gene_id", "cell_id", F.floor(F.col("value") / 20).cast("double").alias("y")).toPandas()
    got = {(r.gene_id, r.term): r.estimate for r in QUERIES["q33e_binomial"][0](spark, LARGER).collect()}
    assert {g for g, _ in got} == set(rows.gene_id) and len(set(rows.gene_id)) > 3
    for gene in sorted(set(rows.gene_id))[::6]:
        y = rows[rows.gene_id == gene].set_index("cell_id").y.reindex(cells.cell_id).fillna(0).to_numpy()
        want = glm.fit((y > 0).astype(float), x, np.log(cells.size_factor.to_numpy()), "binomial").beta
        assert [got[gene, "(Intercept)"], got[gene, "covariate"]] == pytest.approx(want, abs=1e-6)


def test_tsne_lays_out_all_points(spark):
    assert {r.cell_id for r in QUERIES["q40g_tsne"][0](spark, SF).collect()} == {r.cell_id for r in v.r1(spark, SF).select("cell_id").collect()}


def test_matrix_files_hold_all_cells(spark):
    query, sql = QUERIES["q49_matrix_files"]
    assert v.x1(spark, LARGER).cells.where("cell_id >= 40").count() and "< 40" not in sql
    agrees(spark, query, sql, LARGER)


def test_graph_tests_cover_all_dimensions(spark):
    query, sql = QUERIES["q25a_moran_geary"]
    agrees(spark, query, sql)
    want = set(range(len(v.r1(spark, SF).first().vec)))
    assert {r.gene_id for r in QUERIES["q25b_graph_test"][0](spark, SF).collect()} == want and "range(64)" in sql


def test_bootstrap_bounds_on_half_a_unit(spark):
    """On this table one bound is 0.6771875, between 209/310 and 11/16."""
    query, sql = QUERIES["q52_bootstrap_positive"]
    got = query(spark, LARGER).where("gene_id = 'Brand#12' and segment = 'FURNITURE'").first()
    assert got.low == 0.677188
    agrees(spark, query, sql, LARGER)


def test_bootstrap_weights_are_not_broadcast(spark):
    """All cells' weights for all resamples would go through the driver."""
    ds = v.x2(spark, SF)
    plan = agg.bootstrap_positive(ds.counts, v.groups(ds, "segment"), 50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell_id" in plan and "BroadcastHashJoin [cell_id" not in plan
