"""Readers of count matrices: MatrixMarket files, Cell Ranger folders, triplet text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import CellDataset, new_dataset
from ..functions.scratch import kept
from ..operators.normalize import umi_cutoff


def files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; empty if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []


def is_matrix_market(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0].value.startswith("%%MatrixMarket")


#: monotonically_increasing_id has the partition above these bits, and the row's place in it in them.
PLACE = (1 << 33) - 1


def numbered(lines: DataFrame) -> DataFrame:
    """(i, value): lines of one file with their numbers from 1. A line's place is its partition and
    place there; the partitions' sizes, one row each, give the offsets."""
    return _offset(lines.where("trim(value) <> ''").select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "i").select("i", "value")


def _offset(at: DataFrame, name: str) -> DataFrame:
    """Rows with partition p and monotonic id m get their number from 1 over all partitions."""
    sizes = at.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row a partition
    return at.join(F.broadcast(before), "p").withColumn(name, (F.col("m").bitwiseAND(F.lit(PLACE)) + F.col("before") + 1).cast("long")).drop("p", "m", "before")


def ranked(table: DataFrame, key: str, name: str) -> DataFrame:
    """The table with the place of each row by key, from 1: sorted by ranges and written once."""
    return _offset(kept(table.orderBy(key).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))), name)


def write_lines(lines: DataFrame, path: str, head: str = "") -> None:
    """One text file of sorted lines: tasks write parts, whose bytes are then put one after the other."""
    spark = lines.sparkSession
    lines.write.mode("overwrite").text(f"{path}-parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}-parts")
    fs = whole.getFileSystem(conf)
    fs.delete(whole, True)
    out = fs.create(whole, True)
    try:
        out.write(bytearray(head.encode()))
        for name in files(spark, f"{path}-parts"):
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(parts, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path))


def read_annotations(spark: SparkSession, path: str, header: bool = False, columns: list[str] | None = None, sep: str = "\t", quote: str = "\"'") -> DataFrame:
    """(i, id, metadata...): rows of an annotation file. With a header that has one field less than
    the rows, or as many, the first column is the id; names may be given instead."""
    unquote = lambda x: F.regexp_replace(F.trim(x), f"^[{re.escape(quote)}](.*)[{re.escape(quote)}]$", "$1") if quote else F.trim(x)
    rows = read_lines(spark, path).select("i", F.transform(F.split("value", re.escape(sep), -1), unquote).alias("f"))
    names: list[str] | None = None
    if header:
        names = rows.where("i = 1").first()["f"]
        rows = rows.where("i > 1").withColumn("i", F.col("i") - 1)
    width = rows.agg(F.max(F.size("f")).alias("n")).first()["n"] or 1
    if names is not None and len(names) == width:
        names = names[1:]
    if names is not None and len(names) != width - 1:
        raise ValueError(f"annotation header has {len(names)} names for {width} columns")
    names = names or [f"V{k + 2}" for k in range(width - 1)]
    if columns is not None:
        if len(columns) != width - 1:
            raise ValueError(f"{len(columns)} metadata names for {width - 1} columns")
        names = columns
    return rows.select("i", F.get("f", F.lit(0)).alias("id"), *(F.get("f", F.lit(k + 1)).alias(n) for k, n in enumerate(names)))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((row, column, value), rows, columns) of a MatrixMarket coordinate file. Only comment lines and
    the size line, the first others, are told apart; the rest is split as it is read."""
    if not is_matrix_market(spark, path):
        raise ValueError(f"{path} is not a MatrixMarket file")
    lines = spark.read.text(path).where("not startswith(value, '%') and trim(value) <> ''")
    n_rows, n_columns = (int(x) for x in lines.first().value.split()[:2])
    f = F.split(F.trim("value"), r"\s+")
    entries = lines.select("value", F.monotonically_increasing_id().alias("m"))
    first = entries.agg(F.min("m").alias("first"))
    entries = entries.crossJoin(F.broadcast(first)).where("m <> first")
    return entries.select(F.get(f, F.lit(0)).cast("long").alias("row"), F.get(f, F.lit(1)).cast("long").alias("column"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("value")), n_rows, n_columns


def make_unique(table: DataFrame, column: str = "id", order: str = "i") -> DataFrame:
    """Repeated names get .1, .2 and so on, in order."""
    w = Window.partitionBy(column).orderBy(order)
    return table.withColumn("__k", F.row_number().over(w)).withColumn(column, F.when(F.col("__k") > 1, F.concat(column, F.lit("."), (F.col("__k") - 1).cast("string"))).otherwise(F.col(column))).drop("__k")


def _assembled(entries: DataFrame, genes: DataFrame, cells: DataFrame, cutoff: float, strict: bool) -> CellDataset:
    counts = entries.join(genes.select(F.col("i").alias("row"), F.col("id").alias("gene_id")), "row").join(cells.select(F.col("i").alias("column"), F.col("id").alias("cell_id")), "column").select("cell_id", "gene_id", "value")
    named = cells.withColumnRenamed("id", "cell_id").drop("i")
    kept = umi_cutoff(counts, named, cutoff, strict)
    return new_dataset(counts.join(kept.select("cell_id"), "cell_id", "left_semi"), named.join(kept, "cell_id"), genes.withColumnRenamed("id", "gene_id").drop("i"), check=False)


def _checked(table: DataFrame, n: int, what: str) -> DataFrame:
    if table.count() != n:
        raise ValueError(f"the matrix and the {what} annotations differ in size")
    if not table.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate {what} names")
    return table


def load_mm(spark: SparkSession, matrix: str, features: str, cells: str, header: bool = False, feature_columns: list[str] | None = None, cell_columns: list[str] | None = None, cutoff: float = 100, quote: str = "\"'", sep: str = "\t") -> CellDataset:
    """A dataset from a MatrixMarket file and two annotation files; cells with at least `cutoff`."""
    entries, n_rows, n_columns = read_matrix(spark, matrix)
    g = _checked(read_annotations(spark, features, header, feature_columns, sep, quote), n_rows, "feature")
    c = _checked(read_annotations(spark, cells, header, cell_columns, sep, quote), n_columns, "cell")
    return _assembled(entries, g, c, cutoff, strict=False)


def load_mtx(spark: SparkSession, matrix: str, genes: str, cells: str, cutoff: float = 100) -> CellDataset:
    """A dataset from gene-cell-count text, or from a MatrixMarket file; cells with at least `cutoff`."""
    if is_matrix_market(spark, matrix):
        return load_mm(spark, matrix, genes, cells, cutoff=cutoff)
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(matrix).where("trim(value) <> ''")
    entries = lines.select(F.get(f, F.lit(0)).cast("long").alias("row"), F.get(f, F.lit(1)).cast("long").alias("column"), F.get(f, F.lit(2)).cast("double").alias("value"))
    g = read_annotations(spark, genes, columns=None).withColumnRenamed("V2", "gene_short_name")
    return _assembled(entries, g, read_annotations(spark, cells), cutoff, strict=False)


def genome_folder(spark: SparkSession, path: str, genome: str | None = None) -> str:
    """The one genome folder below path, or the named one."""
    found = [f for f in files(spark, path) if files(spark, f"{path}/{f}")]
    if genome is not None:
        if genome not in found:
            raise ValueError(f"Could not find specified genome {genome!r}; the folder has {', '.join(found)}")
        return f"{path}/{genome}"
    if len(found) != 1:
        raise ValueError(f"Multiple genomes found; please specify one of {', '.join(found)}" if found else "no genome folder found")
    return f"{path}/{found[0]}"


def load_cellranger(spark: SparkSession, path: str, genome: str | None = None, barcode_filtered: bool = True, cutoff: float = 100) -> CellDataset:
    """A dataset from a Cell Ranger output folder, version 2 or 3; cells with more than `cutoff`.

    Version 3 keeps Gene Expression features, of the genome if one is given. Ids that repeat are made
    unique."""
    kind = "filtered" if barcode_filtered else "raw"
    v3 = f"{path}/outs/{kind}_feature_bc_matrix"
    if files(spark, f"{path}/outs/filtered_feature_bc_matrix") or files(spark, v3):
        matrix, g = f"{v3}/matrix.mtx.gz", read_annotations(spark, f"{v3}/features.tsv.gz", columns=None)
        c = read_annotations(spark, f"{v3}/barcodes.tsv.gz")
        g = g.withColumnsRenamed({"V2": "gene_short_name", "V3": "type", "V4": "genome"})
        g = g.where("type = 'Gene Expression'")
        if genome is not None and "genome" in g.columns:
            g = g.where(F.col("genome").rlike(genome))
    else:
        folder = genome_folder(spark, f"{path}/outs/{kind}_gene_bc_matrices", genome)
        matrix, g = f"{folder}/matrix.mtx", read_annotations(spark, f"{folder}/genes.tsv").withColumnRenamed("V2", "gene_short_name")
        c = read_annotations(spark, f"{folder}/barcodes.tsv")
    entries, _, _ = read_matrix(spark, matrix)
    c = make_unique(c).withColumn("barcode", F.col("id"))
    return _assembled(entries, make_unique(g), c, cutoff, strict=True)


def write_matrix(ds: CellDataset, path: str) -> None:
    """matrix, features and barcodes as text below path, in order of id, one file each. Places are given
    and lines sorted by ranges of ids, so no task has more than its share."""
    g = ranked(ds.genes.select("gene_id", "gene_short_name"), "gene_id", "row")
    c = ranked(ds.cells.select("cell_id"), "cell_id", "column")
    x = kept(ds.counts.join(g.select("gene_id", "row"), "gene_id").join(c, "cell_id").select("column", "row", "value"))
    head = f"%%MatrixMarket matrix coordinate real general\n{g.count()} {c.count()} {x.count()}\n"
    write_lines(x.orderBy("column", "row").select(F.concat_ws(" ", F.col("row").cast("string"), F.col("column").cast("string"), F.col("value").cast("string")).alias("value")), f"{path}/matrix.mtx", head)
    write_lines(g.orderBy("row").select(F.concat_ws("\t", F.col("gene_id").cast("string"), "gene_short_name").alias("value")), f"{path}/genes.tsv")
    write_lines(c.orderBy("column").select(F.col("cell_id").cast("string").alias("value")), f"{path}/barcodes.tsv")
