"""The pipeline against a plain version of its stages."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkcell.llm import decontam, packing, pii, quality, tokens
from tests.compare import SF
from tests.llm.test_operators import near_brute


@pytest.fixture(scope="module")
def pieces(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_against_plain_stages(spark, pieces):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    kept = {r.doc_id for r in quality.op2_quality(spark, SF).where("kept").collect()}
    docs = {k: t for k, t in docs.items() if k in kept}
    groups = near_brute(list(docs.items()), 5, 80)
    docs = {k: t for k, t in docs.items() if groups[k] == k}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {k: t for k, t in docs.items() if not any(i in t for i in items)}
    weights = pii.trained()
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.vocabulary())
    ids = {k: library.encode(pii.masked(t, weights), add_special_tokens=False).ids + [packing.END] for k, t in docs.items()}
    assert {p.doc_id for p in pieces} == set(ids)
    got = {k: [] for k in ids}
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.start == len(got[p.doc_id])
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        got[p.doc_id] += part
    assert got == ids


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(60), SF).columns == docs.columns, name
    assert decontam.CONTAINED == 0.8 and decontam.SHINGLE == 5


def run_on(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_awkward_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(*r, "x", k) for k, r in enumerate(docs)]
    good = max(docs, key=lambda r: len(r.text))
    rows += [(None, good.text, "en", "s", 5, "y", 1), (900, None, "en", "s", None, "y", 2), (901, "", None, None, 0, None, None), (902, good.text, "en", "s", 1, "z", 3), (902, good.text, "en", "s", 1, "z", 3)]
    names = [f.name for f in spark.read.parquet(f"{SF}/documents.parquet").schema]
    schema = ", ".join([*(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names), "__gone string", "kept long"])
    pieces = run_on(spark, tmp_path, rows, schema)
    ids = {p.doc_id for p in pieces}
    assert ids and not ids & {900, 901, 902} and ids <= {None, *(r.doc_id for r in docs)}
    assert sum(p.doc_tokens for p in pieces if p.start == 0) == sum(p.length for p in pieces)


def test_empty_table(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    assert run_on(spark, tmp_path, [], schema) == []
