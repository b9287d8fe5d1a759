"""Group aggregates over genes and cells, and the tables that plots are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import min_max_100
from ..functions.scratch import kept

FUNS = ("sum", "mean", "count")


def aggregate(values: DataFrame, gene_groups: DataFrame | None = None, cell_groups: DataFrame | None = None, gene_fun: str = "sum", cell_fun: str = "mean", drop_singletons: bool = True, exclude_na: bool = True) -> DataFrame:
    """(row, col, value): rows are genes or gene groups, columns cells or cell groups.

    values are normalised entries (cell_id, gene_id, value); gene_groups is (gene_id, grp),
    cell_groups (cell_id, grp). Means divide by the group's size in its table, so implicit zeros
    count; a gene group of one gene is dropped unless drop_singletons is False; groups named "NA"
    and null go with exclude_na. With groups on the columns every row has a value for every group.
    """
    if gene_groups is None and cell_groups is None:
        raise ValueError("one of either gene_groups or cell_groups must not be NULL")
    if gene_fun not in FUNS[:2] or cell_fun not in FUNS:
        raise ValueError(f"aggregates are {FUNS}")
    live = lambda g: g.where(F.col("grp").isNotNull() & (F.col("grp").cast("string") != "NA")) if exclude_na else g
    x = values.select(F.col("gene_id").alias("row"), F.col("cell_id").alias("col"), "value")
    if gene_groups is not None:
        g = live(gene_groups.select(F.col("gene_id").alias("row"), "grp").distinct())
        sizes = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        if drop_singletons:
            sizes = sizes.where("n > 1")
        x = x.join(g, "row").groupBy("grp", "col").agg(F.sum("value").alias("value")).join(sizes, "grp")
        x = x.select(F.col("grp").alias("row"), "col", (F.col("value") / F.col("n") if gene_fun == "mean" else F.col("value")).alias("value"))
    if cell_groups is not None:
        c = live(cell_groups.select(F.col("cell_id").alias("col"), "grp").distinct())
        sizes = c.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        total = F.sum((F.col("value") != 0).cast("double")) if cell_fun == "count" else F.sum("value")
        x = x.join(c, "col").groupBy("row", "grp").agg(total.alias("value"))
        every = x.select("row").distinct().join(sizes)
        x = every.join(x, ["row", "grp"], "left").select("row", F.col("grp").alias("col"), (F.coalesce("value", F.lit(0.0)) / (F.col("n") if cell_fun == "mean" else F.lit(1))).alias("value"))
    return x


def scaled(x: DataFrame, low: float = -3, high: float = 3) -> DataFrame:
    """Each row's values as z scores (sample deviation) within [low, high]; 0 where there is none."""
    w = Window.partitionBy("row")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    return x.withColumn("value", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.when(z.isNull() | F.isnan(z), 0.0).otherwise(z))))


def genes_by_group(counts: DataFrame, factors: DataFrame, groups: DataFrame, pseudocount: float = 1.0, lower: float = 0.0) -> DataFrame:
    """(gene_id, grp, mean_ln, percentage, is_max): mean of ln(x + pseudocount) and share of cells
    above `lower` over all cells of each group; entries that aren't stored add ln(pseudocount)."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    x = counts.join(factors.select("cell_id", "size_factor"), "cell_id").select("cell_id", "gene_id", F.try_divide("value", "size_factor").alias("value"))
    zero = F.ln(F.lit(float(pseudocount)))
    sums = x.join(groups, "cell_id").groupBy("gene_id", "grp").agg(F.sum(F.ln(F.col("value") + pseudocount) - zero).alias("s"), F.count_if(F.col("value") > lower).alias("k"))
    every = sums.select("gene_id").distinct().join(sizes)
    out = every.join(sums, ["gene_id", "grp"], "left").select("gene_id", "grp", (F.coalesce("s", F.lit(0.0)) / F.col("n") + zero).alias("mean_ln"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("percentage"))
    return out.withColumn("is_max", F.col("mean_ln") == F.max("mean_ln").over(Window.partitionBy("gene_id")))


def percent_positive(counts: DataFrame, groups: DataFrame, min_expr: float = 0) -> DataFrame:
    """(gene_id, grp, n_positive, fraction) over all cells of each group."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    hits = counts.where(F.col("value") > min_expr).join(groups, "cell_id").groupBy("gene_id", "grp").agg(F.count(F.lit(1)).alias("k"))
    every = counts.select("gene_id").distinct().join(sizes)
    return every.join(hits, ["gene_id", "grp"], "left").select("gene_id", "grp", F.coalesce("k", F.lit(0).cast("long")).alias("n_positive"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("fraction"))


def bootstrap_positive(counts: DataFrame, groups: DataFrame, samples: int = 100, alpha: float = 0.95, min_expr: float = 0) -> DataFrame:
    """(gene_id, grp, mean, low, high) of the fraction over Poisson resamples of each group's cells.

    Cell c has weight Poisson(1) in resample b, from a hash of (c, b), so it is repeatable and each
    gene sees the same resample. Bounds are the (1 - alpha) / 2 tails. A cell's weights are one array,
    which is written once and opened only where it is summed, so cells meet their entries but once.
    """
    steps, cumulative, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        cumulative += term
        steps.append(cumulative)
        term /= k + 1

    def weight(b: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("cell_id").cast("string"), b.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: u >= s)).cast("tinyint")

    drawn = kept(groups.select("cell_id", "grp", F.transform(F.sequence(F.lit(1), F.lit(samples)), weight).alias("ws")))
    sizes = drawn.select("grp", F.posexplode("ws").alias("b", "w")).where("w > 0").groupBy("grp", "b").agg(F.sum("w").alias("n"))
    hits = counts.where(F.col("value") > min_expr).select("cell_id", "gene_id").join(drawn.hint("merge"), "cell_id")
    hits = hits.select("gene_id", "grp", F.posexplode("ws").alias("b", "w")).where("w > 0").groupBy("gene_id", "grp", "b").agg(F.sum("w").alias("k"))
    every = counts.select("gene_id").distinct().join(sizes)
    share = every.join(hits, ["gene_id", "grp", "b"], "left").withColumn("f", F.coalesce("k", F.lit(0)) / F.col("n"))
    tail = (1 - alpha) / 2
    return share.groupBy("gene_id", "grp").agg(F.avg("f").alias("mean"), F.percentile("f", F.lit(tail)).alias("low"), F.percentile("f", F.lit(1 - tail)).alias("high"))


def label_positions(points: DataFrame, groups: DataFrame, per: str = "grp", top: int = 1) -> DataFrame:
    """(grp, per, x, y, share): median place of each group and the shares of `per` in it that are
    among the `top` largest, ties kept."""
    joined = points.join(groups, "cell_id")
    w = Window.partitionBy("grp")
    size = joined.groupBy("grp", per).agg(F.count(F.lit(1)).alias("k")) if per != "grp" else joined.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    size = size.withColumn("share", F.col("k") / F.sum("k").over(w)).withColumn("r", F.rank().over(w.orderBy(F.desc("share")))).where(F.col("r") <= top)
    places = joined.groupBy("grp").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return places.join(size, "grp").select(*dict.fromkeys(["grp", per, "x", "y", "share"]))


def marker_values(values: DataFrame, cells: DataFrame, min_expr: float = 0.1, scale: bool = True) -> DataFrame:
    """Values for colouring: 0 to 100 for each gene over all cells with `scale`, and null below
    min_expr. A cell without a stored value has 0, which is null here, and has no row."""
    every = values.crossJoin(F.broadcast(cells.agg(F.count(F.lit(1)).alias("n_cells"))))
    v = min_max_100(F.col("value"), "gene_id", n=F.col("n_cells")) if scale else F.col("value")
    return every.select("cell_id", "gene_id", v.alias("value")).withColumn("value", F.when(F.col("value") >= min_expr, F.col("value")))


def violin_values(counts: DataFrame, factors: DataFrame, cells: DataFrame, genes: DataFrame, min_expr: float = 0, pseudocount: float = 0) -> DataFrame:
    """Long values of the chosen genes over all cells, floored at min_expr. A positive pseudocount
    always adds 1."""
    every = cells.select("cell_id").join(genes.select("gene_id"))
    x = counts.join(genes.select("gene_id"), "gene_id", "left_semi")
    x = every.join(x, ["cell_id", "gene_id"], "left").join(factors.select("cell_id", "size_factor"), "cell_id")
    value: Column = F.try_divide(F.coalesce("value", F.lit(0.0)), F.col("size_factor")) + (1.0 if pseudocount > 0 else 0.0)
    return x.select("cell_id", "gene_id", F.greatest(value, F.lit(float(min_expr))).alias("value"))


def sampled(groups: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n cells of each group, by a hash of id and seed: the same ones each time."""
    w = Window.partitionBy("grp").orderBy(F.md5(F.concat_ws(":", F.col("cell_id").cast("string"), F.lit(str(seed))).cast("binary")), "cell_id")
    return groups.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
