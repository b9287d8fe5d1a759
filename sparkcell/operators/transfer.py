"""Labels from a reference to a query by nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import KnnConfig, knn


def mode_label(votes: DataFrame, top_frac: float = 0.5, top_next: float = 1.5) -> DataFrame:
    """(cell_id, label): the commonest label if its share is above top_frac, or if it occurs at
    least top_next times as often as the second; else null. Null is a label among others; ties go
    to the smaller label."""
    n = votes.groupBy("cell_id", "label").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("cell_id")
    n = n.withColumn("all", F.sum("k").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("k"), F.col("label").asc_nulls_last())))
    best = n.where("r <= 2").groupBy("cell_id").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("k") / F.col("all"))).alias("share"), F.max(F.when(F.col("r") == 1, F.col("k"))).alias("k1"), F.max(F.when(F.col("r") == 2, F.col("k"))).alias("k2"))
    sure = (F.col("share") > top_frac) | F.coalesce(F.col("k1") / F.col("k2") >= top_next, F.lit(False))
    return best.select("cell_id", F.when(sure, F.col("top")).alias("label"))


def transfer(reference: DataFrame, query: DataFrame, labels: DataFrame, k: int = 10, top_frac: float = 0.5, top_next: float = 1.5, config: KnnConfig = KnnConfig()) -> DataFrame:
    """(cell_id, label) of each query cell; labels is (cell_id, label) of the reference. Double
    labels are averaged, without nulls; others are voted on."""
    votes = knn(reference, query, k, config).join(labels.select(F.col("cell_id").alias("neighbor"), "label"), "neighbor")
    if dict(labels.dtypes)["label"] == "double":
        return votes.groupBy("cell_id").agg(F.avg("label").alias("label"))
    return mode_label(votes, top_frac, top_next)


def fill_missing(points: DataFrame, labels: DataFrame, k: int = 10, top_frac: float = 0.5, top_next: float = 1.5, neighbors: str = "after_first", config: KnnConfig = KnnConfig()) -> DataFrame:
    """(cell_id, label): null labels filled from the labelled cells. k + 1 neighbours are found and
    the 2nd to kth vote ("after_first"), or all of the first k ("all")."""
    blank, known = labels.where("label is null"), labels.where("label is not null")
    found = knn(points.join(known, "cell_id", "left_semi"), points.join(blank, "cell_id", "left_semi"), k + 1, config)
    found = found.where(F.col("rank").between(2 if neighbors == "after_first" else 1, k))
    votes = found.join(known.select(F.col("cell_id").alias("neighbor"), "label"), "neighbor")
    return known.select("cell_id", "label").unionByName(blank.select("cell_id").join(mode_label(votes, top_frac, top_next), "cell_id", "left"))
