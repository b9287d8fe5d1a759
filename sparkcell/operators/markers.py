"""Markers of cell groups: specificity, scores, the membership test and marker files."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import chi2_sf, entropy_term
from .aggregate import sampled


def specificity(means: DataFrame) -> DataFrame:
    """(gene_id, grp, specificity): 1 - Jensen-Shannon distance between a gene's share of each group
    and the distribution that is all in that group; means is (gene_id, grp, value), dense.

    With p the shares and h(x) = -x log2 x, the divergence for group j is
    sum(h(p_i / 2)) - h(p_j / 2) + h((p_j + 1) / 2) - sum(h(p_i)) / 2, so one pass over a gene's
    groups gives all of its rows.
    """
    return _with_specificity(means).select("gene_id", "grp", "specificity")


def _with_specificity(means: DataFrame) -> DataFrame:
    w = Window.partitionBy("gene_id")
    h = entropy_term
    p = means.withColumn("p", F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(w)), F.lit(0.0)))
    p = p.withColumn("a", F.sum(h(F.col("p") / 2)).over(w)).withColumn("b", F.sum(h(F.col("p"))).over(w)).withColumn("t", F.sum("p").over(w))
    js = F.col("a") - h(F.col("p") / 2) + h((F.col("p") + 1) / 2) - F.col("b") / 2
    return p.withColumn("specificity", F.when(F.col("t") > 0, 1 - F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), js)))).otherwise(0.0))


def marker_scores(counts: DataFrame, factors: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene_id, grp, fraction_expressing, mean_expression, specificity, marker_score), dense.

    One aggregate gives fraction and mean; groups is (cell_id, grp).
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    x = counts.join(factors.select("cell_id", "size_factor"), "cell_id").join(groups, "cell_id")
    sums = x.groupBy("gene_id", "grp").agg(F.count_if(F.col("value") > 0).alias("k"), F.sum(F.try_divide("value", "size_factor")).alias("s"))
    every = sums.select("gene_id").distinct().join(sizes)
    dense = every.join(sums, ["gene_id", "grp"], "left").select("gene_id", "grp", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("fraction_expressing"), (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))
    p = _with_specificity(dense)
    return p.select("gene_id", "grp", "fraction_expressing", F.col("value").alias("mean_expression"), "specificity", (F.col("fraction_expressing") * F.col("specificity")).alias("marker_score"))


def top_n(scores: DataFrame, n: int, by: str = "marker_score") -> DataFrame:
    """The n best genes of each group, ties kept."""
    w = Window.partitionBy("grp").orderBy(F.desc(by))
    return scores.withColumn("__r", F.rank().over(w)).where(F.col("__r") <= n).drop("__r")


def logistic_test(x: np.ndarray, member: np.ndarray, n_all: int, rounds: int = 25, times: np.ndarray | None = None) -> tuple[float, float]:
    """(pseudo R squared, p) of member ~ ln(x + 0.1) against the intercept alone; (0, 1) on failure.
    times says for how many cells each row stands."""
    times = np.ones(len(x)) if times is None else times
    design = np.column_stack([np.ones(len(x)), np.log(x + 0.1)])

    def fit(d: np.ndarray) -> tuple[float, bool]:
        beta, before = np.zeros(d.shape[1]), np.inf
        for _ in range(rounds):
            mu = 1 / (1 + np.exp(-np.clip(d @ beta, -500, 500)))
            w = np.maximum(mu * (1 - mu), 1e-12)
            beta = np.linalg.solve((d * (times * w)[:, None]).T @ d, d.T @ (times * (w * (d @ beta) + member - mu)))
            mu = np.clip(1 / (1 + np.exp(-np.clip(d @ beta, -500, 500))), 1e-15, 1 - 1e-15)
            ll = float((times * (member * np.log(mu) + (1 - member) * np.log(1 - mu))).sum())
            if abs(ll - before) < 1e-8 * (abs(ll) + 0.1):
                return ll, True
            before = ll
        return before, False

    try:
        full, fine = fit(design)
        null, fine0 = fit(design[:, :1])
    except np.linalg.LinAlgError:
        return 0.0, 1.0
    if not (fine and fine0 and np.isfinite(full) and np.isfinite(null)):
        return 0.0, 1.0
    lr = max(0.0, 2 * (full - null))
    top = 1 - np.exp(2 * null / n_all)
    return (float((1 - np.exp(-lr / n_all)) / top) if top > 0 else 0.0), chi2_sf(lr, 1)


def marker_test(candidates: DataFrame, counts: DataFrame, factors: DataFrame, groups: DataFrame, reference_cells: int | None = None) -> DataFrame:
    """candidates with pseudo_R2, marker_test_p_value and its Bonferroni q over all genes and groups.

    Only candidate (gene, grp) rows are tested. A task gets one gene's stored entries with their
    groups; cells without an entry are alike but for being in the group or not, so they are two rows
    with weights. With reference_cells, each group is tested against itself
    and so many sampled cells.
    """
    panel = groups if reference_cells is None else groups.join(sampled(groups.withColumn("grp", F.lit(1)), reference_cells).select("cell_id"), "cell_id", "left_semi")
    sizes = {r.grp: r.n for r in groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a group
    rest = {r.grp: r.n for r in panel.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = sum(sizes.values())
    panel_ids = panel.select("cell_id", F.lit(True).alias("in_panel"))
    x = counts.join(candidates.select("gene_id").distinct(), "gene_id", "left_semi").join(factors.select("cell_id", "size_factor"), "cell_id")
    x = x.join(groups, "cell_id").join(panel_ids, "cell_id", "left").select("gene_id", F.col("grp").alias("g"), F.try_divide("value", "size_factor").alias("x"), F.coalesce("in_panel", F.lit(False)).alias("in_panel"))

    def test(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grp in wanted["grp"]:
            used = rows[(rows["g"] == grp) | rows["in_panel"]]
            own = int((used["g"] == grp).sum())
            zeros = [sizes[grp] - own, sum(n for g, n in rest.items() if g != grp) - (len(used) - own)]  # cells of the group and others
            member = np.concatenate([(used["g"] == grp).to_numpy(float), [1.0, 0.0]])
            r2, p = logistic_test(np.concatenate([used["x"].to_numpy(), [0.0, 0.0]]), member, n_all, times=np.concatenate([np.ones(len(used)), zeros]))
            out.append((key[0], grp, r2, p))
        return pd.DataFrame(out, columns=["gene_id", "grp", "pseudo_R2", "marker_test_p_value"])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    done = x.groupBy("gene_id").cogroup(candidates.select(F.col("gene_id").alias("gene"), "grp").groupBy("gene")).applyInPandas(test, f"gene_id {kinds['gene_id']}, grp {kinds['grp']}, pseudo_R2 double, marker_test_p_value double")
    n_tests = counts.select("gene_id").distinct().agg((F.count(F.lit(1)) * len(sizes)).alias("__n"))
    return candidates.join(done, ["gene_id", "grp"]).crossJoin(F.broadcast(n_tests)).withColumn("marker_test_q_value", F.least(F.lit(1.0), F.col("marker_test_p_value") * F.col("__n"))).drop("__n")


#: Characters that marker files can't hold.
ILLEGAL = r"[():>,#]"


def marker_lines(markers: DataFrame, n: int = 10, remove_duplicates: bool = False) -> DataFrame:
    """(grp, line): "> group", "expressed: g1, g2" of the n best genes of each group.

    markers has grp, gene_short_name and marker_score; ties at n are kept, then ordered by name and
    cut at n; with remove_duplicates, genes that mark several groups go first.
    """
    top = top_n(markers, n)
    if remove_duplicates:
        top = top.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("gene_short_name"))).where("__k = 1")
    w = Window.partitionBy("grp").orderBy(F.desc("marker_score"), "gene_short_name")
    top = top.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    clean = lambda c: F.regexp_replace(c, ILLEGAL, ".")
    listed = top.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "gene_short_name"))), lambda x: clean(x["gene_short_name"])), ", ").alias("g"))
    return listed.select("grp", F.concat(F.lit("> "), clean(F.col("grp").cast("string")), F.lit("\nexpressed: "), "g").alias("line"))


def write_marker_file(lines: DataFrame, path: str) -> None:
    lines.orderBy("grp").select(F.concat("line", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
