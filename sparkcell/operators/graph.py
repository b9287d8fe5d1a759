"""Principal graphs: projection of cells, cell trees, pseudotime, paths, and learning the graph."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_sf_udf, p_adjust
from ..functions.scratch import kept
from .neighbors import cluster_links, dot, knn, nearest_vertex, squared, with_vertex

#: A principal graph has fewer nodes than this, so it fits the driver and a broadcast.
MAX_NODES = 10_000


def project(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, node, src, dst, t, proj, distance): each cell's nearest node, and its nearest place
    on the edges at that node, the share t of the way from src to dst. Places equally near (to nine
    decimals) go to the smaller edge."""
    closest = with_vertex(points.select("cell_id", "vec"), nodes).drop("d")
    ends = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src"), F.col("vec").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("vec").alias("b")), "dst")
    at = ends.withColumn("node", F.explode(F.array("src", "dst")))
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    run = closest.join(F.broadcast(at), "node")
    t = F.try_divide(dot(minus(F.col("vec"), F.col("a")), minus(F.col("b"), F.col("a"))), squared(F.col("a"), F.col("b")))
    run = run.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0)))))
    run = run.withColumn("proj", F.zip_with("a", "b", lambda x, y: x + F.col("t") * (y - x)))
    run = run.withColumn("distance", F.sqrt(squared(F.col("vec"), F.col("proj"))))
    best = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.round("distance", 9), "src", "dst"))
    return run.withColumn("__r", best).where("__r = 1").select("cell_id", "node", "src", "dst", "t", "proj", "distance", F.col("a").alias("start"))


def cell_tree(projected: DataFrame, weight: str = "reference") -> DataFrame:
    """(src, dst, weight): cells along each edge linked in order, the first to the edge's source.

    Weights are |sum of coordinate differences| ("reference") or Euclidean, plus the least positive
    one, so none is zero.
    """
    w = Window.partitionBy("src", "dst").orderBy("t", "cell_id")
    e = projected.select("src", "dst", F.col("cell_id").cast("string").alias("cell"), "proj", F.coalesce(F.lag(F.col("cell_id").cast("string")).over(w), F.concat(F.lit("Y_"), F.col("src").cast("string"))).alias("prev"), F.coalesce(F.lag("proj").over(w), F.col("start")).alias("before"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    size = F.abs(total("proj") - total("before")) if weight == "reference" else F.sqrt(squared(F.col("proj"), F.col("before")))
    e = e.select(F.col("prev").alias("src"), F.col("cell").alias("dst"), size.alias("w"))
    least = F.broadcast(e.agg(F.coalesce(F.min(F.when(F.col("w") > 0, F.col("w"))), F.lit(0.0)).alias("least")))
    return e.crossJoin(least).select("src", "dst", (F.col("w") + F.col("least")).alias("weight"))


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The principal edges as part of a cell tree, with their lengths."""
    e = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src"), F.col("vec").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("vec").alias("b")), "dst")
    return e.select(F.concat(F.lit("Y_"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("Y_"), F.col("dst").cast("string")).alias("dst"), F.sqrt(squared(F.col("a"), F.col("b"))).alias("weight"))


def dijkstra(edges: Iterable[tuple], roots: Iterable) -> dict:
    """Distance from the nearest root, for nodes that can be reached."""
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    out, heap = {}, [(0.0, str(r), r) for r in roots]
    heapq.heapify(heap)
    while heap:
        d, _, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = d
        for m, w in near[n]:
            if m not in out:
                heapq.heappush(heap, (d + w, str(m), m))
    return out


def pseudotime(edges: DataFrame, nodes: DataFrame, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, pseudotime) by rounds of relaxation as joins; Infinity where no root is reached.

    For trees over many cells: nothing is collected, and each round is cut by a checkpoint. edges
    is (src, dst, weight), nodes and roots have node.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    infinity = F.lit(float("inf"))
    d = nodes.select("node").join(roots.select("node", F.lit(0.0).alias("d")), "node", "left").select("node", F.coalesce("d", infinity).alias("d")).checkpoint()
    for _ in range(rounds):
        step = both.join(d.where(F.col("d") < infinity), F.col("src") == F.col("node")).groupBy("dst").agg(F.min(F.col("d") + F.col("weight")).alias("n"))
        new = d.join(step, F.col("node") == F.col("dst"), "left").select("node", F.least("d", F.coalesce("n", infinity)).alias("d"), (F.coalesce("n", infinity) < F.col("d")).alias("less")).checkpoint()
        d = new.select("node", "d")
        if new.where("less").isEmpty():
            break
    else:
        raise RuntimeError(f"distances still shrink after {rounds} rounds")
    return d.withColumnRenamed("d", "pseudotime")


def pseudotime_driver(spark: SparkSession, tree: DataFrame, roots: list[str], limit: int = 1_000_000) -> DataFrame:
    """(node, pseudotime) by Dijkstra's algorithm on the driver, for trees of up to `limit` edges;
    larger ones go by rounds of joins."""
    nodes = tree.select(F.col("src").alias("node")).unionByName(tree.select(F.col("dst").alias("node"))).distinct()
    if tree.count() > limit:
        return pseudotime(tree, nodes, spark.createDataFrame([(r,) for r in roots], nodes.schema))
    edges = [tuple(r) for r in tree.select("src", "dst", "weight").collect()]
    found = dijkstra(edges, roots)
    every = {n for a, b, _ in edges for n in (a, b)}
    return spark.createDataFrame([(n, float(found.get(n, np.inf))) for n in sorted(every)], "node string, pseudotime double")


def _graph(edges: DataFrame) -> list[tuple]:
    rows = edges.select("src", "dst", "weight").limit(MAX_NODES * 20).collect()
    if len(rows) >= MAX_NODES * 20:
        raise ValueError("principal graph is too large")
    return [tuple(r) for r in rows]


def path_nodes(spark: SparkSession, edges: DataFrame, start, ends: list) -> DataFrame:
    """(node): those on a shortest path from start to any of ends; an error where there is none."""
    graph = _graph(edges)
    near = dijkstra(graph, [start])
    out = set()
    for end in ends:
        if end not in near:
            raise ValueError("Starting and ending nodes are not connected")
        node = end
        out.add(node)
        while node != start:
            node = min((a if b == node else b for a, b, w in graph if node in (a, b) and abs(near[a if b == node else b] + w - near[node]) < 1e-9), key=lambda n: (near[n], str(n)))
            out.add(node)
    return spark.createDataFrame([(n,) for n in sorted(out)], f"node {edges.schema['src'].dataType.simpleString()}")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, kind): leaf (1), branch (more than 2) or inner."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    n = nodes.select("node").join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left").fillna(0, ["degree"])
    return n.withColumn("kind", F.when(F.col("degree") == 1, "leaf").when(F.col("degree") > 2, "branch").otherwise("inner"))


def minimum_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """A minimum spanning tree of points, by Prim's algorithm on squared distances."""
    n = len(x)
    if n < 2:
        return []
    best, parent, inside = ((x - x[0]) ** 2).sum(1), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    out = []
    for _ in range(n - 1):
        k = int(np.where(inside, np.inf, best).argmin())
        out.append((int(parent[k]), k, float(best[k])))
        inside[k] = True
        d = ((x - x[k]) ** 2).sum(1)
        closer = ~inside & (d < best)
        best[closer], parent[closer] = d[closer], k
    return out


def n_centers(cells: int, clusters: int) -> int:
    return int(min(round(15 * clusters * np.log10(max(cells, 2))), cells - 1))


def kmeans(points: DataFrame, k: int, rounds: int = 100) -> tuple[DataFrame, np.ndarray]:
    """((cell_id, vec, center), centres): Lloyd's rounds, until centres rest, from the k cells with the
    least hashes of their ids. Centres are broadcast, sums are aggregates; points are written once."""
    points = kept(points.select("cell_id", "vec"))
    centers = np.array([r.vec for r in points.orderBy(F.md5(F.col("cell_id").cast("string").cast("binary")), "cell_id").select("vec").limit(k).collect()])
    d = centers.shape[1]
    for _ in range(rounds):
        nodes = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "node int, vec array<double>")
        placed = with_vertex(points.select("cell_id", "vec"), nodes).select("cell_id", "vec", F.col("node").alias("center"))
        means = placed.groupBy("center").agg(*(F.avg(F.get("vec", F.lit(j))).alias(f"m{j}") for j in range(d))).collect()
        new = centers.copy()
        for r in means:
            new[r.center] = [r[f"m{j}"] for j in range(d)]
        done = np.abs(new - centers).max() < 1e-9
        centers = new
        if done:
            break
    return placed, centers


def medoids(placed: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(center, cell_id, density): the densest cell of each k-means cluster, ties kept; density is
    exp(-mean neighbour distance)."""
    rho = neighbors.groupBy("cell_id").agg(F.exp(-F.avg("distance")).alias("density"))
    w = Window.partitionBy("center").orderBy(F.desc("density"))
    return placed.join(rho, "cell_id").withColumn("r", F.rank().over(w)).where("r = 1").select("center", "cell_id", "density")


def elastic_tree(points: DataFrame, centers: np.ndarray, sigma: float = 0.01, gamma: float = 0.5, rounds: int = 10, eps: float = 1e-5) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Centres and tree of a principal tree: in turns a spanning tree of the centres, soft shares of
    each cell (an aggregate: column sums and weighted sums of cells), and centres that solve for
    fit and tree length. Stops when the objective changes by less than eps of itself."""
    k, d = centers.shape
    before, tree = np.inf, []
    for _ in range(rounds):
        tree = minimum_tree(centers)
        nodes = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centers))
        dist = F.transform(nodes, lambda c: squared(F.col("vec"), c))
        x = points.select("vec", dist.alias("q")).withColumn("low", F.array_min("q"))
        x = x.withColumn("e", F.transform("q", lambda v: F.exp(-(v - F.col("low")) / sigma)))
        x = x.withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
        aggs = [F.sum(F.get("e", F.lit(i)) / F.col("t")).alias(f"p{i}") for i in range(k)] + [F.sum(F.get("e", F.lit(i)) / F.col("t") * F.get("vec", F.lit(j))).alias(f"x{i}_{j}") for i in range(k) for j in range(d)] + [F.sum(F.ln("t") - F.col("low") / sigma).alias("obj")]
        row = x.agg(*aggs).first()
        weight = np.array([row[f"p{i}"] for i in range(k)])
        sums = np.array([[row[f"x{i}_{j}"] for j in range(d)] for i in range(k)])
        lap = np.zeros((k, k))
        for a, b, _ in tree:
            lap[a, b] = lap[b, a] = -1
        np.fill_diagonal(lap, -lap.sum(1))
        objective = sum(w for _, _, w in tree) + gamma * -sigma * row["obj"]
        centers = np.linalg.solve(2 * lap + 2 * gamma * np.diag(weight) + 1e-12 * np.eye(k), 2 * gamma * sums)
        if abs(before - objective) <= eps * abs(objective):
            break
        before = objective
    return centers, minimum_tree(centers)


def close_loops(centers: np.ndarray, tree: list[tuple[int, int, float]], linked: set[tuple[int, int]] | None = None, euclid_ratio: float = 1.0, geodesic_ratio: float = 1 / 3) -> list[tuple[int, int]]:
    """Pairs of tips to join: linked (by a test of their cells' neighbours), near against the
    longest tree edge, and far apart along the tree against its diameter."""
    degree, near = defaultdict(int), defaultdict(list)
    for a, b, w in tree:
        degree[a] += 1
        degree[b] += 1
        near[a].append(b)
        near[b].append(a)
    tips = [k for k in sorted(degree) if degree[k] == 1]
    hops = {t: dijkstra(((a, b, 1.0) for a, b, _ in tree), [t]) for t in tips}
    diameter = max((max(h.values()) for h in hops.values()), default=0)
    longest = max((w for _, _, w in tree), default=0.0) ** 0.5
    out = []
    for i, a in enumerate(tips):
        for b in tips[i + 1 :]:
            if linked is not None and (a, b) not in linked and (b, a) not in linked:
                continue
            if np.linalg.norm(centers[a] - centers[b]) < euclid_ratio * longest and hops[a].get(b, 0) >= geodesic_ratio * diameter:
                out.append((a, b))
    return out


def prune(tree: list[tuple[int, int, float]], minimal: int = 10, keep: set[int] = frozenset()) -> list[tuple[int, int, float]]:
    """The tree without side branches of fewer than `minimal` nodes; nodes in `keep` stay."""
    edges = {frozenset((a, b)): w for a, b, w in tree}
    while True:
        near = defaultdict(set)
        for e in edges:
            a, b = tuple(e)
            near[a].add(b)
            near[b].add(a)
        gone = None
        for tip in sorted(n for n in near if len(near[n]) == 1):
            path, node, last = [tip], tip, None
            while len(near[node]) <= 2:
                onward = [m for m in near[node] if m != last]
                if not onward:
                    break
                last, node = node, onward[0]
                path.append(node)
            if len(near[node]) > 2 and len(path) - 1 < minimal and not keep & set(path[:-1]) and (gone is None or len(path) < len(gone)):
                gone = path
        if gone is None:
            return [(*sorted(e), w) for e, w in sorted(edges.items(), key=lambda x: sorted(x[0]))]
        for a, b in zip(gone, gone[1:]):
            edges.pop(frozenset((a, b)))


#: Names of the control parameters, with the values they have unless given.
CONTROL = {
    "euclidean_distance_ratio": 1.0, "geodesic_distance_ratio": 1 / 3, "minimal_branch_len": 10, "orthogonal_proj_tip": False, "prune_graph": True, "scale": False,
    "ncenter": None, "maxiter": 10, "eps": 1e-5, "L1.gamma": 0.5, "L1.sigma": 0.01, "nn.k": 25,
}


def checked_control(control: dict | None, **given) -> dict:
    """CONTROL with what is given; unknown names and values out of range are errors."""
    unknown = sorted(set(control or {}) - set(CONTROL))
    if unknown:
        raise ValueError(f"Unknown variable in learn_graph_control: {', '.join(unknown)}")
    out = {**CONTROL, **{k: v for k, v in given.items() if v is not None}, **(control or {})}
    for name in ("orthogonal_proj_tip", "prune_graph", "scale"):
        if not isinstance(out[name], bool):
            raise ValueError(f"learn_graph_control {name} must be TRUE or FALSE")
    for name in ("euclidean_distance_ratio", "geodesic_distance_ratio", "maxiter", "eps", "L1.gamma", "L1.sigma", "nn.k"):
        if not out[name] > 0:
            raise ValueError(f"learn_graph_control {name} must be positive")
    if out["orthogonal_proj_tip"]:
        raise ValueError("learn_graph_control orthogonal_proj_tip is not supported: cells beyond a tip are projected to it")
    if out["ncenter"] is not None and not 2 <= out["ncenter"] <= MAX_NODES:
        raise ValueError(f"learn_graph_control ncenter must lie between 2 and {MAX_NODES}")
    return out


def linked_nodes(points: DataFrame, near: DataFrame, centers: np.ndarray, threshold: float = 0.05) -> set[tuple[int, int]]:
    """Pairs of nodes whose cells are neighbours more often than their numbers suggest: the normal
    test of links between clusters, with Holm's adjustment."""
    nodes = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "node int, vec array<double>")
    groups = nearest_vertex(points, nodes).select("cell_id", F.col("node").alias("cluster"))
    t = cluster_links(near.select(F.col("cell_id").alias("src"), F.col("neighbor").alias("dst")), groups).where("links > 0")
    t = p_adjust(t.withColumn("p", normal_sf_udf(F.coalesce("z", F.lit(0.0)))), "p", "q")
    return {(r.c1, r.c2) for r in t.where(F.col("q") < threshold).select("c1", "c2").collect()}  # pairs of at most MAX_NODES nodes that are linked


def learn_graph(points: DataFrame, clusters: DataFrame | None = None, use_partition: bool = True, close_loop: bool = True, minimal_branch_len: int | None = None, n_center: int | None = None, sigma: float | None = None, gamma: float | None = None, control: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the principal graph: a tree for each partition from the medoids of k-means,
    linked tips joined and short branches dropped. points has cell_id and vec; clusters has cell_id,
    cluster and partition; control has parameters by their names in CONTROL."""
    spark, c = points.sparkSession, checked_control(control, **{"minimal_branch_len": minimal_branch_len, "ncenter": n_center, "L1.sigma": sigma, "L1.gamma": gamma})
    parts = [None] if clusters is None or not use_partition else [r[0] for r in clusters.select("partition").distinct().orderBy("partition").collect()]
    nodes, edges = [], []
    for part in parts:
        own = points.select("cell_id", "vec") if part is None else points.select("cell_id", "vec").join(clusters.where(F.col("partition") == part), "cell_id", "left_semi")
        n = own.count()
        if n < 3:
            continue
        found = 1 if clusters is None else (clusters if part is None else clusters.where(F.col("partition") == part)).select("cluster").distinct().count()
        k = max(2, min(c["ncenter"] or n_centers(n, found), n - 1, MAX_NODES))
        mean, sd = 0.0, 1.0
        if c["scale"]:
            spread = own.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).orderBy("j").collect()  # a row a dimension
            own = own.select("cell_id", F.array(*((F.get("vec", F.lit(r.j)) - r.m) / (r.s or 1.0) for r in spread)).alias("vec"))
            mean, sd = np.array([r.m for r in spread]), np.array([r.s or 1.0 for r in spread])
        placed, _ = kmeans(own, k)
        near = kept(knn(own, own, min(c["nn.k"], n - 1), exclude_self=True))
        first = medoids(placed, near).groupBy("center").agg(F.min("cell_id").alias("cell_id"))
        centers = np.array([r.vec for r in own.join(first, "cell_id").orderBy("center").select("vec").collect()])  # k rows
        centers, tree = elastic_tree(own, np.unique(centers, axis=0), c["L1.sigma"], c["L1.gamma"], c["maxiter"], c["eps"])
        loops = close_loops(centers, tree, linked_nodes(own, near, centers), c["euclidean_distance_ratio"], c["geodesic_distance_ratio"]) if close_loop else []
        tree = prune(tree, c["minimal_branch_len"], {n for pair in loops for n in pair}) if c["prune_graph"] else [*tree]
        tree += [(a, b, float(((centers[a] - centers[b]) ** 2).sum())) for a, b in loops]
        base = len(nodes)
        number = {v: base + i + 1 for i, v in enumerate(sorted({v for a, b, _ in tree for v in (a, b)}))}
        nodes += [(number[v], (centers[v] * sd + mean).tolist(), 1 if part is None else int(part)) for v in sorted(number)]
        edges += [(number[a], number[b], float(w) ** 0.5) for a, b, w in tree]
    return spark.createDataFrame(nodes, "node int, vec array<double>, partition int"), spark.createDataFrame(edges, "src int, dst int, weight double")


def order_cells(points: DataFrame, nodes: DataFrame, edges: DataFrame, root_nodes: list | None = None, root_cells: list | None = None, weight: str = "reference") -> DataFrame:
    """(cell_id, pseudotime): least distance along the cell tree to the nearest root."""
    if (root_nodes is None) == (root_cells is None):
        raise ValueError("Please provide either root_nodes or root_cells, not both")
    if nodes.count() >= MAX_NODES:
        raise ValueError(f"principal graph is too large; order_cells doesn't support more than {MAX_NODES} nodes")
    placed = kept(project(points, nodes, edges))
    if root_cells is not None:
        root_nodes = [r[0] for r in placed.where(F.col("cell_id").isin(list(root_cells))).select("node").distinct().orderBy("node").collect()]
    known = {r[0] for r in nodes.select("node").collect()}
    if not root_nodes or not set(root_nodes) <= known:
        raise ValueError("All provided root nodes must be present in the principal graph")
    tree = cell_tree(placed, weight).unionByName(named_edges(nodes, edges))
    found = pseudotime_driver(points.sparkSession, tree, [f"Y_{r}" for r in root_nodes])
    return points.select("cell_id").join(found, F.col("cell_id").cast("string") == F.col("node"), "left").select("cell_id", "pseudotime")
