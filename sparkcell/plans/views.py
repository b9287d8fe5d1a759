"""The driver's tables as count data. X1 is supplier by part, X2 customer by brand, X3 user by event
type, X4 document by token, R1 vectors. Ids keep their source types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import CellDataset
from ..functions.scratch import kept, scratch  # noqa: F401
from ..operators.normalize import size_factors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x1(spark: SparkSession, sf_dir: str) -> CellDataset:
    t = lambda n: table(spark, sf_dir, n)
    counts = t("lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    counts = kept(counts)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = t("supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("batch"), F.col("n_name").alias("cell_type"), F.col("s_acctbal").alias("covariate"))
    genes = t("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_short_name"), F.col("p_brand").alias("module"), F.col("p_type").alias("supermodule"))
    cells = cells.join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    return CellDataset(counts, cells, genes)


def x2(spark: SparkSession, sf_dir: str) -> CellDataset:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    counts = kept(counts)
    cells = t("customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("covariate"))
    cells = cells.join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    genes = t("part").select(F.col("p_brand").alias("gene_id"), F.col("p_brand").alias("gene_short_name")).distinct()
    return CellDataset(counts, cells, genes)


def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts. A task counts one document's tokens from its own row before the shuffle."""
    tokens = F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), tokens.alias("gene_id")).groupBy("cell_id", "gene_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("label"))


def factors(ds: CellDataset, method: str = "mean-geometric-mean-total") -> DataFrame:
    return size_factors(ds.counts, ds.cells, method)


def groups(ds: CellDataset, column: str) -> DataFrame:
    return ds.cells.select("cell_id", F.col(column).alias("grp"))


def n_cells(ds: CellDataset) -> DataFrame:
    return ds.cells.agg(F.count(F.lit(1)).alias("n"))
