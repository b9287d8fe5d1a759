"""Queries over count tables and their SQL: sources to markers and plot tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import combine, gene_ids
from ..functions.scalar import p_adjust, r6
from ..operators import aggregate as agg
from ..operators import markers as mk
from ..operators import normalize as nz
from . import views as v

X1 = """x as (select l_suppkey as cell_id, l_partkey as gene_id, sum(l_quantity) as value from lineitem group by 1, 2),
cells as (select s_suppkey as cell_id, r_name as batch, n_name as cell_type, s_acctbal as covariate from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey in (select cell_id from x)),
genes as (select p_partkey as gene_id, p_name as gene_short_name, p_brand as module, p_type as supermodule from part),
tot as (select cell_id, sum(round_even(value, 0)) as total from x group by 1),
sf as (select cell_id, total / (select exp(avg(ln(total))) from tot) as size_factor from tot)"""
X2 = """x as (select o_custkey as cell_id, p_brand as gene_id, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
cells as (select c_custkey as cell_id, c_mktsegment as segment, c_acctbal as covariate from customer where c_custkey in (select cell_id from x)),
tot as (select cell_id, sum(round_even(value, 0)) as total from x group by 1),
sf as (select cell_id, total / (select exp(avg(ln(total))) from tot) as size_factor from tot)"""


def r(e: str) -> str:
    return f"round({e}, 6) + 0.0::double"


def normal_tail(z: str) -> str:
    """Upper tail of the standard normal, by the error function's series of positive terms."""
    terms = f"list_sum(list_transform(range(0, 160), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(greatest(abs({z}), 1e-30::double) / sqrt(2)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    half = f"case when abs({z}) > 8 then 0.5::double else 0.5 * 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * {terms} end"
    return f"(0.5 - sign({z}) * ({half}))"


def q01(s: SparkSession, d: str) -> DataFrame:
    ds = v.x1(s, d)
    a, b = v.factors(ds), v.factors(ds, nz.METHODS[1]).withColumnRenamed("size_factor", "b")
    return a.join(b, "cell_id").select("cell_id", r6("size_factor").alias("by_total"), r6("b").alias("by_log_total"))


S01 = f"with {X1} select cell_id, {r('size_factor')} as by_total, {r('ln(total) / (select exp(avg(ln(ln(total)))) from tot)')} as by_log_total from tot join sf using (cell_id)"


def q02a(s, d):
    return nz.detect_genes(v.x1(s, d), 20).genes.select("gene_id", "num_cells_expressed")


def q02b(s, d):
    return nz.detect_genes(v.x1(s, d), -1).cells.select("cell_id", "num_genes_expressed")


S02A = f"with {X1} select g.gene_id, count(x.value) filter (x.value > 20)::bigint as num_cells_expressed from genes g left join x using (gene_id) group by 1"
S02B = f"with {X1} select cell_id, (select count(*) from genes)::bigint as num_genes_expressed from cells"


def q03(s, d):
    ds = v.x1(s, d)
    f = v.factors(ds)
    out = nz.normalized(ds.counts, f, "log").withColumnRenamed("value", "a")
    return out.join(nz.normalized(ds.counts, f, "size_only").withColumnRenamed("value", "b"), ["cell_id", "gene_id"]).join(nz.normalized(ds.counts, f, "binary").withColumnRenamed("value", "c"), ["cell_id", "gene_id"]).select("cell_id", "gene_id", r6("a").alias("log10_value"), r6("b").alias("size_only"), F.col("c").alias("binary_value"))


S03 = f"with {X1} select x.cell_id, gene_id, {r('log10(value / size_factor + 1)')} as log10_value, {r('value / size_factor')} as size_only, case when value > 0 then 1.0::double else 0.0::double end as binary_value from x join sf using (cell_id)"


def q04(s, d):
    ds = v.x1(s, d)
    return agg.aggregate(nz.normalized(ds.counts, v.factors(ds), "size_only"), cell_groups=v.groups(ds, "batch")).select(F.col("row").alias("gene_id"), F.col("col").alias("batch"), r6("value").alias("value"))


DENSE = """n as (select batch, count(*) as n from cells group by 1),
sums as (select gene_id, batch, sum(value / size_factor) as s, count(*) filter (value > 0) as k from x join sf using (cell_id) join cells using (cell_id) group by 1, 2),
dense as (select g.gene_id, n.batch, coalesce(s, 0) / n.n as value, coalesce(k, 0) / n.n as fraction from (select distinct gene_id from x) g cross join n left join sums on sums.gene_id = g.gene_id and sums.batch = n.batch)"""
S04 = f"with {X1}, {DENSE} select gene_id, batch, {r('value')} as value from dense"


def q05a(s, d):
    ds = v.x1(s, d)
    x = nz.normalized(ds.counts, v.factors(ds), "log")
    g = ds.genes.select("gene_id", F.col("module").alias("grp"))
    a = agg.aggregate(x, g, gene_fun="sum").withColumnRenamed("value", "a")
    b = agg.aggregate(x, g, gene_fun="mean").withColumnRenamed("value", "b")
    return a.join(b, ["row", "col"]).select(F.col("row").alias("module"), F.col("col").alias("cell_id"), r6("a").alias("sum_value"), r6("b").alias("mean_value"))


MODULES = "m as (select module, count(*) as n from genes group by 1 having count(*) > 1), mx as (select module, cell_id, sum(log10(value / size_factor + 1)) as s from x join sf using (cell_id) join genes using (gene_id) group by 1, 2)"
S05A = f"with {X1}, {MODULES} select module, cell_id, {r('s')} as sum_value, {r('s / n')} as mean_value from mx join m using (module)"


def q05b(s, d):
    ds = v.x1(s, d)
    x = nz.normalized(ds.counts, v.factors(ds), "log")
    out = agg.scaled(agg.aggregate(x, ds.genes.select("gene_id", F.col("module").alias("grp")), v.groups(ds, "batch")))
    return out.select(F.col("row").alias("module"), F.col("col").alias("batch"), r6("value").alias("z"))


S05B = f"""with {X1}, {MODULES}, n as (select batch, count(*) as n from cells group by 1),
g as (select module, batch, sum(s) / any_value(n.n) as value from mx join m using (module) join cells using (cell_id) join n using (batch) group by 1, 2),
f as (select a.module, n.batch, coalesce(value, 0) as value from (select distinct module from g) a cross join n left join g on g.module = a.module and g.batch = n.batch)
select module, batch, {r("greatest(-3, least(3, coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 0)))")} as z from f window w as (partition by module)"""


def q06(s, d):
    ds = v.x1(s, d)
    means = agg.aggregate(nz.normalized(ds.counts, v.factors(ds), "size_only"), cell_groups=v.groups(ds, "batch")).select(F.col("row").alias("gene_id"), F.col("col").alias("grp"), "value")
    return mk.specificity(means).select("gene_id", F.col("grp").alias("batch"), r6("specificity").alias("specificity"))


def h(x: str) -> str:
    return f"(case when {x} > 0 then -({x}) * log2({x}) else 0 end)"


SPEC = f"""p as (select *, coalesce(value / nullif(sum(value) over (partition by gene_id), 0), 0) as p from dense),
js as (select *, sum({h('p / 2')}) over w - {h('p / 2')} + {h('(p + 1) / 2')} - sum({h('p')}) over w / 2 as js, sum(p) over w as t from p window w as (partition by gene_id)),
spec as (select gene_id, batch, fraction, value, case when t > 0 then 1 - sqrt(greatest(0, least(1, js))) else 0 end as specificity from js)"""
S06 = f"with {X1}, {DENSE}, {SPEC} select gene_id, batch, {r('specificity')} as specificity from spec"


def q07(s, d):
    ds = v.x1(s, d)
    top = mk.top_n(mk.marker_scores(ds.counts, v.factors(ds), v.groups(ds, "batch")).withColumn("marker_score", F.round("marker_score", 9)), 10)
    named = top.join(F.broadcast(ds.genes.select("gene_id", "gene_short_name")), "gene_id")
    return named.select("gene_id", "gene_short_name", F.col("grp").alias("cell_group"), *(r6(c).alias(c) for c in ("marker_score", "mean_expression", "fraction_expressing", "specificity")))


TOP = f"{X1}, {DENSE}, {SPEC}, top as (select *, round(fraction * specificity, 9) as marker_score from spec qualify rank() over (partition by batch order by round(fraction * specificity, 9) desc) <= 10)"
S07 = f"with {TOP} select gene_id, gene_short_name, batch as cell_group, {r('marker_score')} as marker_score, {r('value')} as mean_expression, {r('fraction')} as fraction_expressing, {r('specificity')} as specificity from top join genes using (gene_id)"


def q08(s, d):
    ds = v.x1(s, d)
    scores = mk.marker_scores(ds.counts, v.factors(ds), v.groups(ds, "batch")).withColumn("marker_score", F.round("marker_score", 9))
    named = scores.join(ds.genes, "gene_id").groupBy("grp", "gene_short_name").agg(F.max("marker_score").alias("marker_score"))
    return mk.marker_lines(named, 5).select(F.col("grp").alias("cell_group"), "line")


S08 = f"""with {X1}, {DENSE}, {SPEC}, nm as (select batch, gene_short_name, max(round(fraction * specificity, 9)) as score from spec join genes using (gene_id) group by 1, 2),
t as (select *, row_number() over (partition by batch order by score desc, gene_short_name) as r from nm)
select batch as cell_group, '> ' || regexp_replace(batch, '[():>,#]', '.', 'g') || chr(10) || 'expressed: ' || string_agg(regexp_replace(gene_short_name, '[():>,#]', '.', 'g'), ', ' order by r) as line from t where r <= 5 group by batch"""


def q09(s, d):
    x = v.x3(s, d)
    cells = x.select("cell_id").distinct()
    a = nz.umi_cutoff(x, cells, 66, strict=True).withColumn("over", F.lit(True))
    return nz.umi_cutoff(x, cells, 66, strict=False).join(a.select("cell_id", "over"), "cell_id", "left").select("cell_id", "n_umi", F.coalesce("over", F.lit(False)).alias("over_cutoff"))


S09 = "with t as (select user_id as cell_id, count(*)::double as n_umi from events group by 1) select cell_id, n_umi, n_umi > 66 as over_cutoff from t where n_umi >= 66"


def q10(s, d):
    ds = v.x1(s, d)
    names = ds.genes.select(F.col("gene_short_name").alias("name")).distinct().unionByName(s.createDataFrame([("7",), ("12",), ("none",)], "name string"))
    return gene_ids(ds.genes, names)


S10 = f"with {X1} select gene_short_name as name, min(gene_id) as gene_id from genes group by 1 union all select gene_id::varchar, gene_id from genes where gene_id in (7, 12)"


def q11(s, d):
    ds = v.x1(s, d)
    west, east = ds.subset(cells=F.col("batch").isin("ASIA", "AFRICA")), ds.subset(genes=F.col("supermodule") != "PROMO", cells=~F.col("batch").isin("ASIA", "AFRICA"))
    east = east.with_(genes=east.genes.withColumn("supermodule", F.when(F.col("module") == "Brand#1", "OTHER").otherwise(F.col("supermodule"))))
    both = combine({"w": west, "e": east}, keep_all_genes=True)
    x = both.counts.groupBy("gene_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_cells"), F.max("cell_id").alias("last_cell"))
    return both.genes.select("gene_id", "supermodule").join(x, "gene_id", "left").select("gene_id", "supermodule", r6("total").alias("total"), "n_cells", "last_cell")


S11 = f"""with {X1}, side as (select x.*, batch in ('ASIA', 'AFRICA') as w from x join cells using (cell_id)),
e as (select cell_id || '_' || (case when w then 'w' else 'e' end) as cell_id, gene_id, value from side join genes using (gene_id) where w or supermodule <> 'PROMO'),
t as (select gene_id, sum(value) as total, count(*) as n_cells, max(cell_id) as last_cell from e group by 1)
select g.gene_id, case when module = 'Brand#1' and supermodule <> 'PROMO' then 'conf' else supermodule end as supermodule, {r('total')} as total, n_cells, last_cell from genes g left join t using (gene_id)"""


def q11b(s, d):
    ds = v.x1(s, d)
    west, east = ds.subset(cells=F.col("batch") == "ASIA"), ds.subset(genes=F.col("supermodule") == "PROMO", cells=F.col("batch") == "EUROPE")
    both = combine({"a": west, "b": east}, keep_all_genes=False)
    return both.counts.join(both.cells, "cell_id").groupBy("gene_id", "sample").agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n_cells"))


S11B = f"with {X1} select gene_id, case batch when 'ASIA' then 'a' else 'b' end as sample, {r('sum(value)')} as total, count(*) as n_cells from x join cells using (cell_id) join genes using (gene_id) where batch in ('ASIA', 'EUROPE') and supermodule = 'PROMO' group by 1, 2"


def q12a(s, d):
    ds = v.x1(s, d)
    x = nz.normalized(ds.counts, v.factors(ds), "size_only")
    return nz.tfidf(x, v.n_cells(ds)).select("cell_id", "gene_id", r6("value").alias("value"))


S12A = f"""with {X1}, nx as (select x.cell_id, gene_id, value / size_factor as value from x join sf using (cell_id)), c as (select cell_id, sum(value) as t from nx group by 1), g as (select gene_id, count(*) as df from nx group by 1)
select cell_id, gene_id, {r("ln(1 + value / t * 1e5) * ln(1 + (select count(*) from cells) / df)")} as value from nx join c using (cell_id) join g using (gene_id)"""


def q12b(s, d):
    x = v.x4(s, d)
    n = v.table(s, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return nz.tfidf(x, n).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_tokens"), r6(F.max("value")).alias("top"), F.round(F.sum("value"), 4).alias("total"))


S12B = f"""with w as (select doc_id as cell_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda z: z <> '')) as gene_id from documents), x as (select cell_id, gene_id, count(*) as value from w group by 1, 2),
c as (select cell_id, sum(value) as t from x group by 1), g as (select gene_id, count(*) as df from x group by 1), y as (select cell_id, ln(1 + value / t * 1e5) * ln(1 + (select count(*) from documents) / df) as value from x join c using (cell_id) join g using (gene_id))
select cell_id, count(*) as n_tokens, {r('max(value)')} as top, round(sum(value), 4) as total from y group by 1"""


def q13(s, d):
    ds = v.x1(s, d)
    x, zero = nz.log2_normalized(ds.counts, v.factors(ds), "log", 0.5)
    return nz.gene_moments(x, v.n_cells(ds), zero).select("gene_id", r6("mean").alias("mean"), r6("variance").alias("variance"))


S13 = f"""with {X1}, e as (select g.gene_id, log2(coalesce(value / size_factor, 0) + 0.5) as v from (select distinct gene_id from x) g cross join cells left join x on x.gene_id = g.gene_id and x.cell_id = cells.cell_id left join sf on sf.cell_id = cells.cell_id)
select gene_id, {r('avg(v)')} as mean, {r('var_samp(v)')} as variance from e group by 1"""


def q14(s, d):
    ds = v.x2(s, d)
    return agg.percent_positive(ds.counts, v.groups(ds, "segment"), 10).select("gene_id", F.col("grp").alias("segment"), "n_positive", r6("fraction").alias("fraction"))


S14 = f"""with {X2}, n as (select segment, count(*) as n from cells group by 1), k as (select gene_id, segment, count(*) as k from x join cells using (cell_id) where value > 10 group by 1, 2)
select g.gene_id, n.segment, coalesce(k, 0)::bigint as n_positive, {r('coalesce(k, 0) / n')} as fraction from (select distinct gene_id from x) g cross join n left join k on k.gene_id = g.gene_id and k.segment = n.segment"""


def q15(s, d):
    ds = v.x2(s, d)
    out = agg.genes_by_group(ds.counts, v.factors(ds), v.groups(ds, "segment"))
    return out.select("gene_id", F.col("grp").alias("segment"), r6("mean_ln").alias("mean_ln"), r6("percentage").alias("percentage"), "is_max")


BYGROUP = f"""{X2}, n as (select segment, count(*) as n from cells group by 1), k as (select gene_id, segment, sum(ln(value / size_factor + 1)) as s, count(*) filter (value > 0) as k from x join cells using (cell_id) join sf using (cell_id) group by 1, 2),
b as (select g.gene_id, n.segment, coalesce(s, 0) / n as mean_ln, coalesce(k, 0) / n as percentage from (select distinct gene_id from x) g cross join n left join k on k.gene_id = g.gene_id and k.segment = n.segment)"""
S15 = f"with {BYGROUP} select gene_id, segment, {r('mean_ln')} as mean_ln, {r('percentage')} as percentage, mean_ln = max(mean_ln) over (partition by gene_id) as is_max from b"


def q15b(s, d):
    ds = v.x2(s, d)
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = agg.genes_by_group(ds.counts, v.factors(ds), v.groups(ds, "segment")).groupBy("gene_id").pivot("grp", segments).agg(F.first("mean_ln"))
    return out.select("gene_id", *(r6(c).alias(c.lower()) for c in segments))


S15B = f"with {BYGROUP} select gene_id" + "".join(f", {r(f'''max(mean_ln) filter (segment = '{c}')''')} as {c.lower()}" for c in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " from b group by 1"


def q16(s, d):
    x = v.r1(s, d)
    points = x.select("cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    groups = x.select("cell_id", (F.col("label") % 3).alias("grp"), F.col("label").alias("part"))
    return agg.label_positions(points, groups, "part", 2).select("grp", "part", r6("x").alias("x"), r6("y").alias("y"), r6("share").alias("share"))


S16 = f"""with p as (select label % 3 as grp, label as part, embedding[1]::double as x, embedding[2]::double as y from embeddings), m as (select grp, median(x) as x, median(y) as y from p group by 1),
k as (select grp, part, count(*) as k from p group by 1, 2), h as (select *, k / sum(k) over (partition by grp) as share from k qualify rank() over (partition by grp order by k desc) <= 2)
select grp, part, {r('x')} as x, {r('y')} as y, {r('share')} as share from m join h using (grp)"""


def q17(s, d):
    ds = v.x2(s, d)
    return agg.marker_values(nz.normalized(ds.counts, v.factors(ds), "log"), ds.cells, 0.1).select("cell_id", "gene_id", r6("value").alias("value"))


S17 = f"""with {X2}, e as (select x.cell_id, gene_id, log10(value / size_factor + 1) as v from x join sf using (cell_id)), m as (select *, case when count(*) over (partition by gene_id) < (select count(*) from cells) then least(0, min(v) over (partition by gene_id)) else min(v) over (partition by gene_id) end as lo, max(v) over (partition by gene_id) as hi from e),
z as (select cell_id, gene_id, case when hi > lo then 100 * (v - lo) / (hi - lo) else 0 end as v from m) select cell_id, gene_id, case when v >= 0.1::double then {r('v')} end as value from z"""


def event_p(s, d):
    return v.table(s, d, "events").select("event_id", F.col("event_type").alias("grp"), F.when(F.col("event_id") % 17 != 0, F.round(F.pmod(F.col("event_id") * 7919, F.lit(10007)) / 10007.0 * F.pmod(F.col("event_id") * 104729, F.lit(10009)) / 10009.0, 12)).alias("p"))


def adjusted(x):
    for m in ("holm", "bh", "bonferroni"):
        x = p_adjust(x, "p", m, ("grp",), m)
    return x.select("event_id", *(r6(c).alias(c) for c in ("holm", "bh", "bonferroni")))


def q24(s, d):
    return adjusted(event_p(s, d))


S24 = f"""with e as (select event_id, event_type as grp, case when event_id % 17 <> 0 then round((event_id * 7919 % 10007) / 10007.0::double * (event_id * 104729 % 10009) / 10009.0::double, 12) end as p from events),
i as (select *, count(p) over (partition by grp) as m, row_number() over (partition by grp order by p nulls last) as i from e)
select event_id, case when p is not null then {r('least(1, max((m - i + 1) * p) over (partition by grp order by i rows unbounded preceding))')} end as holm,
case when p is not null then {r('least(1, min(m / i * p) over (partition by grp order by i desc rows unbounded preceding))')} end as bh, case when p is not null then {r('least(1, m * p)')} end as bonferroni from i"""


def q46(s, d):
    ds = v.x2(s, d)
    groups = ds.cells.select("cell_id", F.when(F.col("segment") == "BUILDING", F.lit("NA")).when(F.col("segment") == "MACHINERY", F.lit(None)).otherwise(F.col("segment")).alias("grp"))
    x = agg.aggregate(nz.normalized(ds.counts, v.factors(ds), "binary"), cell_groups=groups, cell_fun="count")
    return x.select(F.col("row").alias("gene_id"), F.col("col").alias("segment"), F.col("value").alias("n_cells"))


S46 = f"""with {X2}, k as (select gene_id, segment, count(*) as k from x join cells using (cell_id) where value > 0 group by 1, 2)
select g.gene_id, n.segment, coalesce(k, 0)::double as n_cells from (select distinct gene_id from x) g cross join (select distinct segment from cells where segment not in ('BUILDING', 'MACHINERY')) n left join k on k.gene_id = g.gene_id and k.segment = n.segment"""


def q47(s, d):
    return agg.sampled(v.groups(v.x2(s, d), "segment"), 20, seed=3).select("cell_id", F.col("grp").alias("segment"))


S47 = f"with {X2} select cell_id, segment from cells qualify row_number() over (partition by segment order by md5(cell_id::varchar || ':3'), cell_id) <= 20"


def q51(s, d):
    ds = v.x2(s, d)
    return agg.violin_values(ds.counts, v.factors(ds), ds.cells, ds.genes, 0.5, 0.3).select("cell_id", "gene_id", r6("value").alias("value"))


S51 = f"with {X2} select c.cell_id, g.gene_id, {r('greatest(coalesce(value, 0) / size_factor + 1, 0.5)')} as value from cells c cross join (select distinct p_brand as gene_id from part) g left join x on x.cell_id = c.cell_id and x.gene_id = g.gene_id join sf on sf.cell_id = c.cell_id"


def q52(s, d):
    ds = v.x2(s, d)
    # Bounds between shares such as 209/310 and 11/16 may lie on half a unit of the sixth place, which
    # arithmetic on doubles misses by 1e-16: round that off first.
    return agg.bootstrap_positive(ds.counts, v.groups(ds, "segment"), 50, min_expr=10).select("gene_id", F.col("grp").alias("segment"), *(r6(F.round(c, 12)).alias(c) for c in ("mean", "low", "high")))


POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
S52 = f"""with {X2}, u as (select cell_id, segment, b, ('0x' || substr(md5(cell_id::varchar || ':' || b::varchar), 1, 8))::bigint / 4294967296.0::double as u from cells, range(1, 51) t(b)),
w as (select cell_id, segment, b, {' + '.join(f'(u >= {x!r}::double)::int' for x in POISSON)} as w from u), n as (select segment, b, sum(w) as n from w where w > 0 group by 1, 2),
h as (select gene_id, segment, b, sum(w) as k from x join w using (cell_id) where value > 10 group by 1, 2, 3),
f as (select g.gene_id, n.segment, coalesce(k, 0) / n.n as f from (select distinct gene_id from x) g cross join n left join h on h.gene_id = g.gene_id and h.segment = n.segment and h.b = n.b)
select gene_id, segment, {r('avg(f)')} as mean, {r('quantile_cont(f, 0.025)')} as low, {r('quantile_cont(f, 0.975)')} as high from f group by 1, 2"""


QUERIES = {
    "q01_size_factors": (q01, S01), "q02a_detect_genes": (q02a, S02A), "q02b_detect_cells_implicit": (q02b, S02B), "q03_normalized_counts": (q03, S03),
    "q04_cell_group_mean": (q04, S04), "q05a_gene_group_aggregate": (q05a, S05A), "q05b_scaled_group_aggregate": (q05b, S05B), "q06_specificity": (q06, S06),
    "q07_top_markers": (q07, S07), "q08_marker_lines": (q08, S08), "q09_umi_cutoff": (q09, S09), "q10_gene_lookup": (q10, S10),
    "q11a_combine_union": (q11, S11), "q11b_combine_intersection": (q11b, S11B), "q12a_tfidf": (q12a, S12A), "q12b_tfidf_documents": (q12b, S12B),
    "q13_log2_moments": (q13, S13), "q14_percent_positive": (q14, S14), "q15a_genes_by_group": (q15, S15), "q15b_genes_by_group_pivot": (q15b, S15B),
    "q16_label_positions": (q16, S16), "q17_marker_values": (q17, S17), "q24_p_adjust": (q24, S24), "q46_excluded_groups": (q46, S46),
    "q47_group_sample": (q47, S47), "q51_violin_values": (q51, S51), "q52_bootstrap_positive": (q52, S52),
}
