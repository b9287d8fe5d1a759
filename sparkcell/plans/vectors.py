"""Queries over vectors, neighbour graphs and labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import normal_sf_udf, p_adjust, r6
from ..operators import graph as gr
from ..operators import neighbors as nb
from ..operators import plotdata as pd_
from ..operators import spatial as sp
from ..operators import transfer as tr
from . import views as v
from .tables import normal_tail, r

V = "v as (select vec_id as id, embedding::double[] as e, label from embeddings)"


def knn_sql(k: int, distance: str, subject: str = "true", query: str = "true", own: bool = True) -> str:
    return f"select q.id, s.id as nb, {distance} as d, row_number() over (partition by q.id order by case when q.id = s.id then -1 else {distance} end, s.id) as r from v q join v s on {query} and {subject}{'' if own else ' and q.id <> s.id'} qualify r <= {k}"


EUCLID, COSINE = "list_distance(q.e, s.e)", "1 - list_cosine_similarity(q.e, s.e)"


def q18(metric):
    def q(s, d):
        x = v.r1(s, d)
        return nb.knn(x, x, 6, nb.KnnConfig(metric=metric)).select("cell_id", "neighbor", r6("distance").alias("distance"), "rank")

    return q


def s18(distance):
    return f"with {V}, k as ({knn_sql(6, distance)}) select id as cell_id, nb as neighbor, {r('case when id = nb then 0 else d end')} as distance, r::int as rank from k"


def q18d(s, d):
    """By inverted lists, saved and loaded; queries are the rows whose id 100 divides."""
    x, path = v.r1(s, d), v.scratch(s)
    nb.KnnIndex.build(x).save(path)
    return nb.KnnIndex.load(s, path).search(x.where("cell_id % 100 = 0"), 6).select("cell_id", "neighbor", r6("distance").alias("distance"), "rank")


MANHATTAN = "list_sum(list_transform(list_zip(q.e, s.e), lambda z: abs(z[1] - z[2])))"


def q19(weight):
    def q(s, d):
        x = v.r1(s, d)
        e = nb.jaccard_edges(nb.knn(x, x, 10, exclude_self=True), weight)
        return e.select("src", "dst", r6("weight").alias("weight"))

    return q


KNN10 = f"{V}, k as ({knn_sql(10, EUCLID, own=False)}), l as (select id, list(nb) as s from k group by 1)"
S19A = f"with {KNN10}, j as (select k.id as src, nb as dst, len(list_intersect(a.s, b.s)) as u from k join l a on a.id = k.id join l b on b.id = nb), w as (select src, dst, case when u > 0 then u / (20 - u) else 1 end as w from j) select src, dst, {r('w / (select max(w) from w)')} as weight from w"
S19B = f"with {KNN10} select id as src, nb as dst, 1.0::double as weight from k"


def centroids(x):
    """(node, vec): mean vector of each label."""
    at = x.select("label", F.posexplode("vec").alias("p", "z")).groupBy("label", "p").agg(F.avg("z").alias("z"))
    return at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "z"))), lambda a: a["z"]).alias("vec")).select(F.col("label").alias("node"), "vec")


CENTROIDS = f"{V}, ce as (select label as node, list(z order by p) as c from (select label, p, avg(e[p]) as z from v, range(1, 65) t(p) group by 1, 2) group by 1)"


def q20(s, d):
    x = v.r1(s, d)
    return nb.nearest_vertex(x, centroids(x)).select("cell_id", "node", r6("distance").alias("distance"))


NEAREST = "nn as (select id, node, list_distance(e, c) as d from v, ce qualify row_number() over (partition by id order by list_distance(e, c), node) = 1)"
S20 = f"with {CENTROIDS}, {NEAREST} select id as cell_id, node, {r('d')} as distance from nn"


def chain(x):
    nodes = centroids(x)
    edges = nodes.where("node < 9").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return nodes, edges


def q21(s, d):
    x = v.r1(s, d)
    return gr.project(x, *chain(x)).select("cell_id", F.col("node").alias("closest"), F.col("src").alias("edge_src"), F.col("dst").alias("edge_dst"), r6("t").alias("t"), r6("distance").alias("distance"))


PROJECT = f"""{CENTROIDS}, {NEAREST}, ed as (select a.node as src, b.node as dst, a.c as a, b.c as b from ce a join ce b on b.node = a.node + 1),
pr as (select nn.id, nn.node, v.e, src, dst, a, b, greatest(0, least(1, list_dot_product(list_transform(list_zip(v.e, a), lambda z: z[1] - z[2]), list_transform(list_zip(b, a), lambda z: z[1] - z[2])) / pow(list_distance(a, b), 2))) as t from nn join v on v.id = nn.id join ed on ed.src = nn.node or ed.dst = nn.node),
pd as (select *, list_distance(e, list_transform(list_zip(a, b), lambda z: z[1] + t * (z[2] - z[1]))) as d from pr),
pb as (select * from pd qualify row_number() over (partition by id order by round(d, 9), src) = 1)"""
S21 = f"with {PROJECT} select id as cell_id, node as closest, src as edge_src, dst as edge_dst, {r('t')} as t, {r('d')} as distance from pb"


def links(s, d):
    x = v.r1(s, d)
    return nb.cluster_links(nb.jaccard_edges(nb.knn(x, x, 10, exclude_self=True)), x.select("cell_id", F.col("label").alias("cluster")))


def q22(s, d):
    return links(s, d).select("c1", "c2", "links", r6("theta").alias("theta"), F.round(F.col("variance") * 1e6, 4).alias("variance_e6"), r6("z").alias("z"))


S22 = f"""with {KNN10}, n as (select c1, c2, count(*) as links from (select a.label as c1, b.label as c2 from k join v a on a.id = k.id join v b on b.id = nb union all select b.label, a.label from k join v a on a.id = k.id join v b on b.id = nb) where c1 <> c2 group by 1, 2),
p as (select c1, sum(links) as e from n group by 1), t as (select sum(e) as t from p), g as (select a.label as c1, b.label as c2 from (select distinct label from v) a, (select distinct label from v) b),
z as (select g.c1, g.c2, coalesce(links, 0)::bigint as links, coalesce(x.e, 0) / t * coalesce(y.e, 0) / t as theta, t from g cross join t left join p x on x.c1 = g.c1 left join p y on y.c1 = g.c2 left join n on n.c1 = g.c1 and n.c2 = g.c2)
select c1, c2, links, {r('theta')} as theta, round(theta * (1 - theta) / t * 1e6, 4) as variance_e6, {r('(links / t - theta) / sqrt(theta * (1 - theta) / t)')} as z from z"""


def q23(s, d):
    t = links(s, d).withColumn("p", normal_sf_udf(F.coalesce("z", F.lit(0.0))))
    return p_adjust(t, "p", "q").select("c1", "c2", r6("p").alias("p"), r6("q").alias("q"))


HOLM = "least(1, max((m - i + 1) * p) over (order by i rows unbounded preceding))"
S23 = S22[: S22.rindex("select c1, c2, links")].rstrip() + f""", s as (select c1, c2, coalesce((links / t - theta) / nullif(sqrt(theta * (1 - theta) / t), 0), 0) as z from z), a as (select c1, c2, {normal_tail('z')} as p from s),
i as (select *, count(*) over () as m, row_number() over (order by p) as i from a) select c1, c2, {r('p')} as p, {r(HOLM)} as q from i"""


def spatial_inputs(s, d):
    x = v.r1(s, d)
    w = v.kept(sp.weights(nb.knn(x, x, 8, exclude_self=True)))
    values = x.select("cell_id", F.posexplode("vec").alias("gene_id", "value")).where("value > 0")
    return values, x.select("cell_id"), w


def moran_geary(values, cells, w):
    return sp.graph_statistics(values, cells, w).select("gene_id", *(r6(c).alias(c) for c in ("morans_i", "e_i", "z_i", "gearys_c", "z_c")))


def q25(s, d):
    return moran_geary(*spatial_inputs(s, d))


S25 = f"""with {V}, k as ({knn_sql(8, EUCLID, own=False)}), w as (select id as i, nb as j, 0.125::double as w from k), n as (select count(*)::double as n from v),
y as (select id, g, greatest(e[g + 1], 0) as y from v, range(64) t(g)), mu as (select g, avg(y) as m from y group by 1), z as (select id, y.g, y - m as z from y join mu using (g)),
st as (select g, sum(z * z) as ss, avg(pow(z, 4)) / pow(avg(z * z), 2) as k from z group by 1), cr as (select a.g, sum(w * a.z * b.z) as wz, sum(w * pow(a.z - b.z, 2)) as wd from w join z a on a.id = i join z b on b.id = j and b.g = a.g group by 1),
c as (select n, (select sum(w) from w) as s0, (select sum(pow(coalesce(a.w, 0) + coalesce(b.w, 0), 2)) / 2 from w a full join w b on a.i = b.j and a.j = b.i) as s1, (select sum(pow(o, 2)) from (select id, coalesce((select sum(w) from w where i = v.id), 0) + coalesce((select sum(w) from w where j = v.id), 0) as o from v)) as s2 from n),
q as (select g, n / s0 * wz / ss as i, -1 / (n - 1) as e, (n * (s1 * (n * n - 3 * n + 3) - n * s2 + 3 * s0 * s0) - k * (s1 * (n * n - n) - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / pow(n - 1, 2) as vi,
(n - 1) / (2 * s0) * wd / ss as gc, ((n - 1) * s1 * (n * n - 3 * n + 3 - k * (n - 1)) - 0.25::double * (n - 1) * s2 * (n * n + 3 * n - 6 - k * (n * n - n + 2)) + s0 * s0 * (n * n - 3 - k * pow(n - 1, 2))) / (n * (n - 2) * (n - 3) * s0 * s0) as vc from st join cr using (g) cross join c)
select g::int as gene_id, {r('i')} as morans_i, {r('e')} as e_i, {r('(i - e) / sqrt(vi)')} as z_i, {r('gc')} as gearys_c, {r('(1 - gc) / sqrt(vc)')} as z_c from q"""


def q25b(s, d):
    values, cells, w = spatial_inputs(s, d)
    t = sp.graph_test(values, values.select("gene_id").distinct(), cells, w)
    return t.select("gene_id", "status", *(r6(c).alias(c) for c in ("statistic", "z", "p_value", "q_value")))


S25B = S25[: S25.rindex("select g::int")].rstrip() + f""", zz as (select g, i as stat, (i - e) / sqrt(vi) as z from q), a as (select g, stat, z, {normal_tail('z')} as p from zz),
i as (select *, count(*) over () as m, row_number() over (order by p) as i from a)
select g::int as gene_id, 'OK' as status, {r('stat')} as statistic, {r('z')} as z, {r('p')} as p_value, {r('least(1, min(m / i * p) over (order by i desc rows unbounded preceding))')} as q_value from i"""


def q25d(s, d):
    """Neighbour pairs that the principal graph allows: in one vertex, or in two that an edge joins."""
    x = v.r1(s, d)
    nodes, edges = chain(x)
    return sp.feasible(nb.knn(x, x, 8, exclude_self=True), nb.nearest_vertex(x, nodes), edges).select("cell_id", "neighbor")


S25D = f"with {CENTROIDS}, {NEAREST}, k as ({knn_sql(8, EUCLID, own=False)}) select k.id as cell_id, k.nb as neighbor from k join nn a on a.id = k.id join nn b on b.id = k.nb where abs(a.node - b.node) <= 1"


def q58(s, d):
    """Roots and leaves of a graph, with their places."""
    nodes, edges = chain(v.r1(s, d))
    return pd_.node_points(nodes, edges, [0]).select("node", "kind", r6("x1").alias("x1"), r6("x2").alias("x2"))


S58 = f"with {CENTROIDS} select node, case when node = 0 then 'root' else 'leaf' end as kind, {r('c[1]')} as x1, {r('c[2]')} as x2 from ce where node in (0, 9)"


def q18e(s, d):
    """Whether the index finds at least nine tenths of the true neighbours of its queries."""
    x = v.r1(s, d)
    query = x.where("cell_id % 100 = 0")
    exact = nb.knn(x, query, 10)
    found = nb.KnnIndex.build(x).search(query, 10)
    hits = exact.select("cell_id", "neighbor").join(found.select("cell_id", "neighbor", F.lit(1).alias("hit")), ["cell_id", "neighbor"], "left")
    return hits.agg(F.count_distinct("cell_id").alias("queries"), F.count(F.lit(1)).alias("neighbors"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


S18E = f"with {V} select count(*) as queries, 10 * count(*) as neighbors, true as recall_reached from v where id % 100 = 0"


def split(x):
    return x.where("cell_id % 4 <> 0"), x.where("cell_id % 4 = 0")


def q26(s, d):
    x = v.r1(s, d)
    ref, query = split(x)
    return tr.transfer(ref, query, ref.select("cell_id", F.when(F.col("label") != 7, F.col("label").cast("string")).alias("label")))


VOTE = """c as (select id, label, count(*) as k from votes group by 1, 2), o as (select *, sum(k) over (partition by id) as n, row_number() over (partition by id order by k desc, label nulls last) as i from c),
b as (select id, max(label) filter (i = 1) as top, max(k / n) filter (i = 1) as share, max(k) filter (i = 1) as k1, max(k) filter (i = 2) as k2 from o where i <= 2 group by 1),
m as (select id, case when share > 0.5 or coalesce(k1 / k2 >= 1.5, false) then top end as label from b)"""
SPLIT = knn_sql(10, EUCLID, "s.id % 4 <> 0", "q.id % 4 = 0")
S26 = f"with {V}, k as ({SPLIT}), votes as (select k.id, case when v.label <> 7 then v.label::varchar end as label from k join v on v.id = nb), {VOTE} select id as cell_id, label from m"


def q27(s, d):
    x = v.r1(s, d)
    ref, query = split(x)
    out = tr.transfer(ref, query, ref.select("cell_id", F.when(F.col("label") > 0, F.col("label") * 1.5).alias("label")))
    return out.select("cell_id", r6("label").alias("label"))


S27 = f"with {V}, k as ({SPLIT}) select k.id as cell_id, {r('avg(case when v.label > 0 then v.label * 1.5::double end)')} as label from k join v on v.id = nb group by 1"


def q28(s, d):
    x = v.r1(s, d)
    return tr.fill_missing(x, x.select("cell_id", F.when(F.col("cell_id") % 5 != 0, F.col("label").cast("string")).alias("label")))


S28 = f"with {V}, k as ({knn_sql(11, EUCLID, 's.id % 5 <> 0', 'q.id % 5 = 0')}), votes as (select k.id, v.label::varchar as label from k join v on v.id = nb where r between 2 and 10), {VOTE} select id as cell_id, label::varchar as label from v where id % 5 <> 0 union all select v.id, m.label from v left join m on m.id = v.id where v.id % 5 = 0"


def q39(s, d):
    x = v.r1(s, d).withColumn("batch", F.col("cell_id") % 2)
    return nb.mutual_pairs(x, "batch", 0, 1, 5)


S39 = f"with {V}, a as ({knn_sql(5, EUCLID, 's.id % 2 = 1', 'q.id % 2 = 0')}), b as ({knn_sql(5, EUCLID, 's.id % 2 = 0', 'q.id % 2 = 1')}) select a.id as a, a.nb as b from a join b on a.id = b.nb and a.nb = b.id"


def q43(s, d):
    x = v.r1(s, d)
    nodes, edges = chain(x)
    return gr.cell_tree(gr.project(x, nodes, edges)).select("src", "dst", r6("weight").alias("weight"))


S43 = f"""with {PROJECT}, o as (select id::varchar as cell, 'Y_' || src as source, src, dst, list_transform(list_zip(a, b), lambda z: z[1] + t * (z[2] - z[1])) as p, a, row_number() over (partition by src, dst order by t, id) as i from pb),
l as (select cell, coalesce(lag(cell) over w, source) as prev, p, coalesce(lag(p) over w, a) as pp from o window w as (partition by src, dst order by i)),
g as (select prev as src, cell as dst, abs(list_sum(p) - list_sum(pp)) as w from l), mn as (select min(w) as mn from g where w > 0)
select src, dst, {r('w + mn')} as weight from g, mn"""


def q44(s, d):
    x = v.r1(s, d)
    nodes, edges = chain(x)
    tree = gr.cell_tree(gr.project(x, nodes, edges)).unionByName(gr.named_edges(nodes, edges))
    return gr.pseudotime_driver(s, tree, ["Y_0", "Y_5"]).where("not startswith(node, 'Y_')").select(F.col("node").alias("cell_id"), r6("pseudotime").alias("pseudotime"))


S44 = S43[: S43.index("g as (select prev")].rstrip().rstrip(",").replace("l as (select cell, ", "l as (select cell, src, dst, i, ") + f""", g as (select cell, src, dst, i, abs(list_sum(p) - list_sum(pp)) as w from l), mn as (select min(w) as mn from g where w > 0),
y as (select src, sum(list_distance(a, b)) over (order by src) - list_distance(a, b) as far from ed), dy as (select src, least(far, abs(far - (select far from y where src = 5))) as d from y)
select cell as cell_id, {r('d + sum(w + mn) over (partition by g.src, dst order by i)')} as pseudotime from g join dy using (src), mn"""


def q45(s, d):
    x = v.r1(s, d)
    nodes, edges = chain(x)
    keep = gr.path_nodes(s, edges, 2, [6, 4])
    return nb.nearest_vertex(x, nodes).join(F.broadcast(keep), "node", "left_semi").select("cell_id", "node")


S45 = f"with recursive {CENTROIDS}, {NEAREST}, p(n) as (select 2 union all select n + 1 from p where n < 6) select id as cell_id, node from nn where node in (select n from p)"


def q44b(s, d):
    x = v.r1(s, d)
    return gr.degrees(*chain(x)).select("node", "degree", "kind")


S44B = f"with {V}, n as (select distinct label as node from v) select node, (select count(*) from n m where abs(m.node - n.node) = 1)::bigint as degree, case (select count(*) from n m where abs(m.node - n.node) = 1) when 1 then 'leaf' when 2 then 'inner' else 'branch' end as kind from n"


def q55(s, d):
    seg = pd_.graph_segments(*chain(v.r1(s, d)))
    return seg.select("src", "dst", *(r6(c).alias(c) for c in ("src_x1", "src_x2", "dst_x1", "dst_x2")))


S55 = f"with {CENTROIDS} select a.node as src, b.node as dst, {r('a.c[1]')} as src_x1, {r('a.c[2]')} as src_x2, {r('b.c[1]')} as dst_x1, {r('b.c[2]')} as dst_x2 from ce a join ce b on b.node = a.node + 1"


QUERIES = {
    "q55_graph_segments": (q55, S55),
    "q18a_knn_euclidean": (q18("euclidean"), s18(EUCLID)), "q18b_knn_cosine": (q18("cosine"), s18(COSINE)), "q18c_knn_manhattan": (q18("manhattan"), s18(MANHATTAN)),
    "q18d_knn_index": (q18d, None), "q18e_index_recall": (q18e, S18E), "q25d_feasible_pairs": (q25d, S25D), "q58_graph_points": (q58, S58), "q19a_jaccard_edges": (q19(True), S19A), "q19b_unweighted_edges": (q19(False), S19B), "q20_nearest_vertex": (q20, S20), "q21_segment_projection": (q21, S21),
    "q22_cluster_links": (q22, S22), "q23_partition_tests": (q23, S23), "q25a_moran_geary": (q25, S25), "q25b_graph_test": (q25b, S25B),
    "q26_label_transfer": (q26, S26), "q27_value_transfer": (q27, S27), "q28_fill_labels": (q28, S28), "q39_mutual_pairs": (q39, S39),
    "q43_cell_tree": (q43, S43), "q44a_pseudotime": (q44, S44), "q44b_degrees": (q44b, S44B), "q45_path_subset": (q45, S45),
}
