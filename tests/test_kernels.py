import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkcell.operators import cluster as cl
from sparkcell.operators import glm
from sparkcell.operators import graph as gr
from sparkcell.operators import models as md
from sparkcell.operators import neighbors as nb
from sparkcell.operators import reduce as rd
from sparkcell.operators import spatial as sp
from sparkcell.plans import views as v
from tests.compare import SF


def points(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, vec array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_knn_is_brute_force(spark, metric):
    x = np.random.default_rng(1).normal(size=(60, 5))
    got = nb.knn(points(spark, x), points(spark, x), 4, nb.KnnConfig(metric=metric, block=17)).collect()
    d = nb.distances(x, x, metric)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (0 if i == j else d[i, j] + 1e-15, j))[:4]
        assert [r.neighbor for r in sorted((r for r in got if r.cell_id == i), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("metric", nb.METRICS)
def test_nearest_measures_every_pair_that_counts(metric):
    """Far from the origin, with copies (ties), against all distances; own rows first or left out."""
    r = np.random.default_rng(11)
    x = np.round(r.normal(size=(3000, 6)), 1 if metric == "hamming" else 9) + (1000.0 if metric in ("euclidean", "l2", "manhattan") else 0.0)
    x[500:900] = x[100:500]
    x[900:950] = x[900]
    s, own = x[400:], np.arange(3000) - 400
    for exclude in (False, True):
        i, j, d = nb.nearest(x, s, np.maximum(own, -1), 7, metric, exclude)
        for q in [0, 150, 399, 420, 555, 905, 949, 2999]:
            want = nb.distances(x[q : q + 1], s, metric)[0]
            if own[q] >= 0:
                want[own[q]] = np.inf if exclude else 0.0 if metric != "ip" else want[own[q]]
            got = i == q
            assert d[got] == pytest.approx(np.sort(want)[:7], abs=1e-9)
            if metric not in ("cosine", "ip"):
                assert j[got].tolist() == sorted(range(len(s)), key=lambda c: (want[c], c != own[q], c))[:7]


def test_knn_of_many_blocks(spark):
    """Tiles of 32 subjects and 16 queries; a row without a distance is nobody's neighbour."""
    x = np.random.default_rng(12).normal(size=(300, 3))
    x[7] = np.nan
    got = nb.knn(points(spark, x), points(spark, x), 5, nb.KnnConfig(block=2), exclude_self=True)
    d = nb.distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) if i != 7 for j in np.argsort(np.nan_to_num(d[i], nan=np.inf))[:5]}
    assert {(r.cell_id, r.neighbor) for r in got.collect()} == want


def test_search_runs_once(spark):
    """What uses a neighbour table several times writes it once, or uses it once."""
    x = points(spark, np.random.default_rng(13).normal(size=(40, 3)))
    found = nb.knn(x, x, 4, exclude_self=True)
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("meet(")
    assert searches(found) == 1 and searches(nb.jaccard_edges(found)) == 0 and searches(nb.jaccard_edges(found, False)) == 1
    nodes = x.where("cell_id < 3").select(F.col("cell_id").alias("node"), "vec")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert searches(sp.feasible(found, nb.nearest_vertex(x, nodes), edges)) == 1
    assert searches(cl.label_propagation(nb.jaccard_edges(found, False), x, 1)) == 0


def test_knn_edges(spark):
    x = points(spark, [[0, 0], [0, 0], [1, 1]])
    rows = {(r.cell_id, r.rank): r.neighbor for r in nb.knn(x, x, 9).collect()}
    assert rows[0, 1] == 0 and rows[1, 1] == 1 and len(rows) == 9
    assert nb.knn(x, x.where("false"), 2).count() == 0
    with pytest.raises(ValueError):
        nb.KnnConfig(metric="other")
    with pytest.raises(ValueError, match="unknown nn_control"):
        nb.KnnConfig.of({"n_trees": 3})


def test_pca_is_a_dense_svd(spark):
    r = np.random.default_rng(2)
    x = r.poisson(1.0, (40, 7)).astype(float)
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(7) if x[i, j]], "cell_id long, gene_id long, value double")
    cells = spark.range(40).select(F.col("id").alias("cell_id"))
    m = rd.fit(values, cells, 4)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    s = np.linalg.svd(z, compute_uv=False)
    assert m.sdev == pytest.approx(s[:4] / np.sqrt(39))
    assert np.allclose(m.loadings.T @ m.loadings, np.eye(4), atol=1e-9)
    got = np.array([r.vec for r in m.project(values, cells).orderBy("cell_id").collect()])
    assert np.allclose(got, z @ m.loadings, atol=1e-9)


def test_glm_families_recover_their_parameters():
    r = np.random.default_rng(3)
    n = 4000
    x = np.column_stack([np.ones(n), r.normal(size=n)])
    mu = np.exp(x @ [0.7, 0.4])
    zero = np.zeros(n)
    assert glm.fit(r.poisson(mu).astype(float), x, zero, "poisson").beta == pytest.approx([0.7, 0.4], abs=0.05)
    m = glm.fit(r.negative_binomial(2.0, 2 / (2 + mu)).astype(float), x, zero, "negbinomial")
    assert m.beta == pytest.approx([0.7, 0.4], abs=0.08) and m.theta == pytest.approx(2, rel=0.2)
    y = np.where(r.random(n) < 0.3, 0, r.poisson(mu)).astype(float)
    m = glm.fit(y, x, zero, "zipoisson")
    assert m.beta == pytest.approx([0.7, 0.4], abs=0.08) and 1 / (1 + np.exp(-m.zero[0][0])) == pytest.approx(0.3, abs=0.06)
    y = (r.random(n) < 1 / (1 + np.exp(-(x @ [0.2, 1.0])))).astype(float)
    assert glm.fit(y, x, zero, "binomial").beta == pytest.approx([0.2, 1.0], abs=0.15)
    g = r.integers(0, 8, n)
    y = r.poisson(np.exp(x @ [0.7, 0.4] + r.normal(0, 0.5, 8)[g])).astype(float)
    assert glm.fit(y, x, zero, "mixed-negbinomial", g).beta[1] == pytest.approx(0.4, abs=0.08)


def test_formula():
    f = md.Formula("~ a * b + log(c) - 1")
    assert f.terms == [("a",), ("b",), ("a", "b"), ("log(c)",)] and not f.intercept and f.variables == ["a", "b", "c"]
    names, x = md.Formula("~ a + k").design(pd.DataFrame({"a": [1.0, 2.0], "k": ["u", "v"]}))
    assert names == ["(Intercept)", "a", "kv"] and x.tolist() == [[1, 1, 0], [1, 2, 1]]


def test_formula_errors(spark):
    cells = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "cell_id long, a double")
    with pytest.raises(ValueError, match="a NaN: 1"):
        md.Formula("~ a").check(cells)
    with pytest.raises(ValueError, match="not in the cells"):
        md.Formula("~ zz").check(cells)


@pytest.mark.parametrize("family,formula", [("gaussian", "~ a + k"), ("poisson", "~ k"), ("quasipoisson", "~ k"), ("poisson", "~ 1")])
def test_fits_from_sums_are_those_of_whole_columns(spark, monkeypatch, family, formula):
    """No task gets a design: fits are from sums over stored entries, and what glm.fit finds."""
    r = np.random.default_rng(15)
    cells = pd.DataFrame({"cell_id": np.arange(80), "size_factor": r.uniform(0.5, 2, 80), "a": r.normal(size=80), "k": r.choice(["u", "v", "w"], 80)})
    y = r.poisson(1.2, (3, 80)).astype(float)
    y[2, cells.k == "v"] = 0
    counts = spark.createDataFrame([(int(g), int(c), float(y[g, c])) for g, c in zip(*np.nonzero(y))], "gene_id long, cell_id long, value double")
    _, x = md.Formula(formula).design(cells)
    fits = md.fit_models(counts, spark.createDataFrame(cells), formula, family)
    assert "mapInPandas" in (plan := fits._jdf.queryExecution().optimizedPlan().toString()) or "MapInPandas" in plan
    for row in fits.collect():
        want = glm.fit(y[row.gene_id], x, np.log(cells.size_factor.to_numpy()), family)
        for t, beta, err in zip(row.terms, want.beta, np.sqrt(np.diag(want.cov))):
            if family != "gaussian" and beta < -20:  # a group without counts
                assert t.estimate < -20 and t.std_err > 1e4
            else:
                assert (t.estimate, t.std_err) == (pytest.approx(beta, rel=1e-6, abs=1e-8), pytest.approx(err, rel=1e-6))
        for name in ("deviance", "null_deviance", "dispersion", "log_lik", "df", "n"):
            got = getattr(row, {"df": "df_residual"}.get(name, name))
            assert (np.nan if got is None else got) == pytest.approx(getattr(want, name), rel=1e-9, nan_ok=True)


def test_size_search_agrees_with_golden_sections():
    r = np.random.default_rng(16)
    for theta in (0.3, 2.0, 60.0):
        mu = np.exp(r.normal(0, 0.5, 2000))
        y, w = r.negative_binomial(theta, theta / (theta + mu)).astype(float), r.uniform(0.2, 1, 2000)
        value = lambda t: float((w * glm.nb_terms(y, mu, np.exp(t))).sum())
        got = np.log(glm.best_theta(y, mu, w))
        assert all(value(got) >= value(got + step) - 1e-9 for step in (-1e-3, 1e-3, -0.1, 0.1))
        assert glm.nb_terms(y, mu, 1.7) == pytest.approx(glm.lgamma(y + 1.7) - glm.lgamma(1.7) - glm.lgamma(y + 1) + 1.7 * np.log(1.7 / (1.7 + mu)) + y * np.log(mu / (1.7 + mu)))
    calls = []
    glm.highest(lambda t: calls.append(t) or -((t - 1.0) ** 2), -7.0, 14.0)
    assert len(calls) < 25 and calls[-1] == pytest.approx(1.0, abs=1e-6)


def ring(parts, inside):
    e = {}
    for p in range(parts):
        for a, b in itertools.combinations(range(inside), 2):
            e[p * inside + a, p * inside + b] = 1.0
        e[tuple(sorted((p * inside, (p + 1) % parts * inside + 1)))] = 1.0
    return cl.Graph(parts * inside, e)


@pytest.mark.parametrize("method,quality,resolution", [("leiden", "modularity", 1.0), ("louvain", "modularity", 1.0), ("leiden", "CPM", 0.3), ("leiden", "RB", 1.0)])
def test_communities_find_cliques(method, quality, resolution):
    g = ring(6, 6)
    label = cl.communities(g, method, quality, resolution)
    assert len(set(label)) == 6 and all(len({label[p * 6 + k] for k in range(6)}) == 1 for p in range(6))
    assert label == cl.communities(g, method, quality, resolution)
    assert cl.modularity(g, label) > 0.6


def test_graph_on_the_driver_is_arrays(spark):
    """A pair of cells takes some 60 bytes, not a dictionary's hundreds, and communities keep their order."""
    import tracemalloc

    r = np.random.default_rng(17)
    a, b = r.integers(0, 5000, 60_000), r.integers(0, 5000, 60_000)
    pairs = {(int(min(p)), int(max(p))): 1.0 for p in zip(a, b) if p[0] != p[1]}
    arrays = (*np.array(list(pairs)).T, np.ones(len(pairs)))
    tracemalloc.start()
    g = cl.Graph(5000, arrays)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * len(pairs)
    label = [k % 7 for k in range(5000)]
    small, where = cl._shrunk(g, label)
    assert small.n == 7 and where == label and small.total == pytest.approx(g.total)
    assert cl.modularity(small, list(range(7))) == pytest.approx(cl.modularity(g, label))


def test_partitions_take_linked_clusters_only(spark):
    """Thousands of small clusters: pairs that have links are tested, against all pairs."""
    n = 3000
    e = spark.range(n).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"), F.lit(1.0).alias("weight"))
    e = e.unionByName(spark.createDataFrame([(4 * k, 4 * k + 2, 1.0) for k in range(10)] * 40, e.schema))
    c = spark.range(2 * n).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 2).cast("int").alias("cluster"))
    got = {r.cluster: r.partition for r in cl.partitions(e, c).collect()}
    assert len(got) == n and got[0] == got[1] != got[2] == got[3] and len(set(got.values())) == n - 10
    assert nb.cluster_links(e, c, linked=True).count() == 20


def test_components_of_label_propagation(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "src long, dst long, weight double")
    cells = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 9)], "cell_id long")
    got = {r.cell_id: r.cluster for r in cl.label_propagation(e, cells, 6).collect()}
    assert got[9] == 9 and not {got[1], got[2], got[3]} & {got[7], got[8]}


def test_tree_kernels():
    x = np.random.default_rng(4).normal(size=(12, 2))
    tree = gr.minimum_tree(x)
    assert len(tree) == 11 and len(gr.dijkstra(tree, [0])) == 12
    y = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (2, 5, 1.0)]
    assert (2, 5, 1.0) not in gr.prune(y, 2) and len(gr.prune(y, 2)) == 4
    assert gr.prune(y, 2, {5}) == sorted(y)


def test_driver_and_joined_pseudotime_agree(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(k), r.random()) for k in range(1, 30)]
    e = spark.createDataFrame([(f"Y_{a}", f"Y_{b}", w) for a, b, w in rows], "src string, dst string, weight double")
    a = {x.node: x.pseudotime for x in gr.pseudotime_driver(spark, e, ["Y_0"]).collect()}
    nodes = spark.createDataFrame([(f"Y_{k}",) for k in range(30)], "node string")
    b = {x.node: x.pseudotime for x in gr.pseudotime(e, nodes, nodes.where("node = 'Y_0'")).collect()}
    assert a == pytest.approx(b)


def test_principal_graph_is_a_tree(spark):
    t = np.linspace(0, 3, 80)
    x = points(spark, np.column_stack([t, np.sin(t)]) + np.random.default_rng(6).normal(0, 0.02, (80, 2)))
    nodes, edges = gr.learn_graph(x, n_center=10, close_loop=False, minimal_branch_len=2)
    n, e = nodes.count(), edges.count()
    assert e == n - 1
    got = gr.order_cells(x, nodes, edges, root_nodes=[1]).orderBy("cell_id").collect()
    time = [r.pseudotime for r in got]
    assert abs(np.corrcoef(time, t)[0, 1]) > 0.9
    with pytest.raises(ValueError, match="either root_nodes or root_cells"):
        gr.order_cells(x, nodes, edges)


def test_umap_keeps_groups_apart(spark):
    r = np.random.default_rng(7)
    x = np.vstack([r.normal(0, 0.1, (30, 4)) + [3, 0, 0, 0], r.normal(0, 0.1, (30, 4)) + [0, 3, 0, 0]])
    y = np.array([r.vec for r in rd.umap(points(spark, x), 8, epochs=80).orderBy("cell_id").collect()])
    d = nb.distances(y, y, "euclidean")
    np.fill_diagonal(d, np.inf)
    assert ((d.argmin(1) < 30) == (np.arange(60) < 30)).mean() > 0.95


def test_tsne_beyond_the_exact_limit(spark):
    """The interpolated gradient is the exact one, and groups of points lie apart, by either way."""
    r = np.random.default_rng(14)
    y = r.normal(0, 9, (700, 2))
    d = y[:, None] - y[None]
    w = 1 / (1 + (d * d).sum(2))
    near, p = np.array([r.choice(np.delete(np.arange(700), i), 20, False) for i in range(700)]), r.random((700, 20)).astype(np.float32)
    dense = np.zeros((700, 700))
    np.put_along_axis(dense, near, p, 1)
    with ThreadPoolExecutor(2) as pool:
        away, total = rd.repulsion(y, pool)
        pull = rd.attraction(y, near, p, pool, 100)
    assert total == pytest.approx(w.sum() - 700, rel=3e-3)
    assert np.abs(away - (d * (w * w)[:, :, None]).sum(1)).max() < 0.01 * np.abs(away).max()
    assert np.allclose(pull, (d * (w * (dense + dense.T) / 2)[:, :, None]).sum(1))
    x = np.vstack([r.normal(0, 0.1, (100, 4)) + 2 * np.eye(4)[c] for c in range(3)])
    for exact in (1000, 100):
        y = np.array([v.vec for v in rd.tsne(points(spark, x), rounds=250, perplexity=20, exact=exact).orderBy("cell_id").collect()])
        d = nb.distances(y, y, "euclidean")
        np.fill_diagonal(d, np.inf)
        assert len(y) == 300 and (d.argmin(1) // 100 == np.arange(300) // 100).mean() > 0.98
        mid = y.reshape(3, 100, 2).mean(1)
        assert min(np.linalg.norm(mid[a] - mid[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 2 * y.reshape(3, 100, 2).std(1).max()


def test_index_recall_and_round_trip(spark, tmp_path):
    x = v.r1(spark, SF.replace("0.001", "0.1"))
    query = x.where("cell_id % 100 = 0")
    for metric in ("euclidean", "cosine"):
        index = nb.KnnIndex.build(x, nb.KnnConfig(method="ivf", metric=metric))
        exact = nb.knn(x, query, 10, nb.KnnConfig(metric=metric)).cache()
        assert nb.recall(index.search(query, 10), exact) >= 0.9
        every = index.search(query, 10, probes=10_000)
        assert nb.recall(every, exact) == 1.0 and every.count() == exact.count()
    index.save(str(tmp_path / "i"))
    again = nb.KnnIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.search(query, 5).collect())) == sorted(map(tuple, index.search(query, 5).collect()))
    with pytest.raises(ValueError):
        nb.KnnConfig(method="ivf", metric="hamming")


def test_pca_of_many_genes(spark, monkeypatch):
    """The block iteration against a dense decomposition, and the Gram matrix's way."""
    r = np.random.default_rng(3)
    n, g = 60, 20_000
    base = r.normal(size=(n, 4)) @ r.normal(size=(4, g)) * np.array([3.0])
    dense = np.where(r.random((n, g)) < 0.05, np.round(np.abs(base) * 4 + 1), 0.0)
    cell, gene = np.nonzero(dense)
    values = spark.createDataFrame(pd.DataFrame({"cell_id": cell, "gene_id": gene, "value": dense[cell, gene]}))
    cells = spark.createDataFrame([(k,) for k in range(n)], "cell_id long")
    live = dense.std(0) > 0
    z = (dense[:, live] - dense[:, live].mean(0)) / dense[:, live].std(0, ddof=1)
    u, sv, vt = np.linalg.svd(z, full_matrices=False)
    model = rd.fit(values, cells, 5, "PCA")
    assert len(model.genes) == live.sum() > rd.MAX_GRAM
    assert model.sdev == pytest.approx(sv[:5] / np.sqrt(n - 1), rel=1e-4)
    scores = np.array([x.vec for x in model.project(values, cells).orderBy("cell_id").collect()])
    assert np.abs(np.abs(scores[:, 0]) - np.abs(u[:, 0] * sv[0])).max() < 0.02 * sv[0]
    few = values.where("gene_id < 300")
    want = rd.fit(few, cells, 3, "PCA")
    monkeypatch.setattr(rd, "MAX_GRAM", 100)
    got = rd.fit(few, cells, 3, "PCA")
    assert got.sdev == pytest.approx(want.sdev, rel=1e-6) and np.abs(got.loadings - want.loadings).max() < 1e-2


@pytest.mark.parametrize("control", [{"ncentre": 3}, {"prune_graph": 1}, {"eps": 0}, {"ncenter": 1}, {"orthogonal_proj_tip": True}])
def test_graph_control_is_checked(spark, control):
    x = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(9)], "cell_id long, vec array<double>")
    with pytest.raises(ValueError, match="learn_graph_control"):
        gr.learn_graph(x, control=control)


def test_tips_are_joined_only_where_cells_link(spark):
    """A ring is closed; the two ends of an open arc of the same width are not."""
    a = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    for width, closed in ((1.0, True), (0.8, False)):
        rows = [(k, [float(np.cos(t * width)), float(np.sin(t * width))]) for k, t in enumerate(a)]
        x = spark.createDataFrame(rows, "cell_id long, vec array<double>")
        nodes, edges = gr.learn_graph(x, control={"ncenter": 12, "minimal_branch_len": 2, "nn.k": 8, "euclidean_distance_ratio": 3.0})
        assert (edges.count() >= nodes.count()) == closed


def test_relaxation_that_does_not_settle_raises(spark):
    nodes = spark.createDataFrame([(k,) for k in range(9)], "node int")
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(8)], "src int, dst int, weight double")
    assert gr.pseudotime(edges, nodes, nodes.where("node = 0")).where("node = 8").first().pseudotime == 8.0
    with pytest.raises(RuntimeError):
        gr.pseudotime(edges, nodes, nodes.where("node = 0"), rounds=3)
