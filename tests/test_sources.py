import pytest
from pyspark.sql import functions as F

from sparkcell.dataset import CellDataset
from sparkcell.sources import matrix as mx
from sparkcell.sources import store


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 2 3\n1 1 60\n2 1 50\n3 2 5\n")
    (tmp_path / "g.txt").write_text("g1\tn1\ng2\tn2\ng3\tn3\n")
    (tmp_path / "c.txt").write_text("c1\nc2\n")
    return tmp_path


def test_matrix_market(spark, folder):
    ds = mx.load_mm(spark, f"{folder}/m.mtx", f"{folder}/g.txt", f"{folder}/c.txt", feature_columns=["gene_short_name"])
    assert {(r.cell_id, r.gene_id, r.value) for r in ds.counts.collect()} == {("c1", "g1", 60.0), ("c1", "g2", 50.0)}
    assert [(r.cell_id, r.n_umi) for r in ds.cells.collect()] == [("c1", 110.0)]


def test_headers(spark, folder):
    (folder / "h.txt").write_text("short\tkind\ng1\t'a'\tx\ng2\tb\ty\n")
    rows = mx.read_annotations(spark, f"{folder}/h.txt", header=True).orderBy("i").collect()
    assert [(r.id, r.short, r.kind) for r in rows] == [("g1", "a", "x"), ("g2", "b", "y")]
    with pytest.raises(ValueError, match="metadata names"):
        mx.read_annotations(spark, f"{folder}/g.txt", columns=["a", "b"])


def test_size_and_duplicate_errors(spark, folder):
    (folder / "d.txt").write_text("g1\tn\ng1\tn\ng3\tn\n")
    with pytest.raises(ValueError, match="duplicate"):
        mx.load_mm(spark, f"{folder}/m.mtx", f"{folder}/d.txt", f"{folder}/c.txt")
    with pytest.raises(ValueError, match="differ in size"):
        mx.load_mm(spark, f"{folder}/m.mtx", f"{folder}/c.txt", f"{folder}/c.txt")


def test_triplets_are_inclusive_and_cellranger_strict(spark, tmp_path):
    out = tmp_path / "run" / "outs" / "filtered_gene_bc_matrices" / "hg"
    out.mkdir(parents=True)
    (out / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 100\n1 2 100\n2 2 1\n")
    (out / "genes.tsv").write_text("g1\tn1\ng2\tn2\n")
    (out / "barcodes.tsv").write_text("b1\nb1\n")
    ds = mx.load_cellranger(spark, f"{tmp_path}/run")
    assert [r.cell_id for r in ds.cells.collect()] == ["b1.1"]
    (tmp_path / "t.txt").write_text("1 1 100\n2 2 3\n")
    (tmp_path / "b.txt").write_text("b1\nb2\n")
    ds = mx.load_mtx(spark, f"{tmp_path}/t.txt", f"{out}/genes.tsv", f"{tmp_path}/b.txt")
    assert [r.cell_id for r in ds.cells.collect()] == ["b1"]


def test_store(spark, tmp_path):
    counts = spark.createDataFrame([("a", "g", 1.0)], "cell_id string, gene_id string, value double")
    ds = CellDataset(counts, counts.select("cell_id"), counts.select("gene_id")).put("coords", "PCA", counts.select("cell_id"))
    assert store.save(ds, f"{tmp_path}/s").count() == 4
    again = store.load(spark, f"{tmp_path}/s")
    assert again.counts.collect() == counts.collect() and again.lineage == ds.lineage
    counts.union(counts).write.mode("overwrite").parquet(f"{tmp_path}/s/counts")
    with pytest.raises(ValueError, match="checksum"):
        store.load(spark, f"{tmp_path}/s")


def test_digest_of_many_rows(spark):
    """Hashes of 20 million rows add up to more than a long holds."""
    n, total = store._digest(spark.range(20_000_000)).split(":")
    assert n == "20000000" and int(total) > 2**63


def test_matrix_is_one_file_that_many_tasks_wrote(spark, tmp_path):
    """Files hold all lines in order, and no task sorts or numbers a whole table."""
    counts = spark.range(3000).select((F.col("id") % 50).alias("cell_id"), (F.col("id") % 61).alias("gene_id"), F.lit(2.0).alias("value"))
    genes = spark.range(61).select(F.col("id").alias("gene_id"), F.concat(F.lit("g"), "id").alias("gene_short_name"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mx.write_matrix(CellDataset(counts, spark.range(50).select(F.col("id").alias("cell_id")), genes), str(tmp_path))
        table = mx.ranked(genes.repartition(7), "gene_id", "row")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r.gene_id, r.row) for r in table.collect()} == {(k, k + 1) for k in range(61)}
    lines = (tmp_path / "matrix.mtx").read_text().splitlines()
    assert lines[:2] == ["%%MatrixMarket matrix coordinate real general", "61 50 3000"]
    want = sorted((k % 50 + 1, k % 61 + 1) for k in range(3000))
    assert [tuple(map(int, x.split()[:2][::-1])) for x in lines[2:]] == want
    assert (tmp_path / "barcodes.tsv").read_text() == "".join(f"{k}\n" for k in range(50))
    assert (tmp_path / "genes.tsv").read_text() == "".join(f"{k}\tg{k}\n" for k in range(61))
