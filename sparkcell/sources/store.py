"""Saving and loading datasets and models: Parquet members and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import CellDataset
from ..operators.neighbors import KnnIndex
from ..operators.reduce import Reduction

VERSION = "1"


def _digest(df: DataFrame) -> str:
    """Count and order-free hash of a member's rows. Sums are decimal: a long overflows at 17 million rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)).cast("decimal(13,0)")).alias("h")).first()
    return f"{row.n}:{row.h or 0}"


def _members(ds: CellDataset) -> dict[str, DataFrame]:
    out = {"counts": ds.counts, "cells": ds.cells, "genes": ds.genes}
    for kind in ("coords", "clusters", "pseudotime"):
        out |= {f"{kind}/{k}": v for k, v in getattr(ds, kind).items()}
    for k, (nodes, edges) in ds.graphs.items():
        out |= {f"graphs/{k}/nodes": nodes, f"graphs/{k}/edges": edges}
    return out


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def save(ds: CellDataset, path: str, comment: str = "") -> DataFrame:
    """Write every member as Parquet, then the manifest, whose presence says that all is there.
    Returns the report: (member, format, digest)."""
    spark, made = ds.counts.sparkSession, {}
    for name, df in _members(ds).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        made[name] = _digest(spark.read.parquet(f"{path}/{name}"))
    for name, index in ds.indexes.items():
        index.save(f"{path}/indexes/{name}")
    _put(spark, f"{path}/manifest", json.dumps({"kind": "dataset", "version": VERSION, "comment": comment, "members": made, "lineage": ds.lineage, "indexes": sorted(ds.indexes)}))
    return report(spark, path)


def report(spark: SparkSession, path: str) -> DataFrame:
    manifest = _get(spark, f"{path}/manifest")
    return spark.createDataFrame([(k, "parquet", v) for k, v in manifest["members"].items()], "member string, format string, digest string")


def load(spark: SparkSession, path: str, check: bool = True) -> CellDataset:
    manifest = _get(spark, f"{path}/manifest")
    if manifest["kind"] != "dataset":
        raise ValueError(f"{path} does not hold a dataset")
    read = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["members"]}
    if check:
        for name, df in read.items():
            if _digest(df) != manifest["members"][name]:
                raise ValueError(f"checksum of {name} differs")
    pick = lambda kind: {k.split("/")[1]: v for k, v in read.items() if k.startswith(f"{kind}/")}
    graphs = {k.split("/")[1]: (read[k], read[k.replace("nodes", "edges")]) for k in read if k.startswith("graphs/") and k.endswith("/nodes")}
    return CellDataset(read["counts"], read["cells"], read["genes"], pick("coords"), pick("clusters"), graphs, pick("pseudotime"), {}, tuple(map(tuple, manifest["lineage"])), {k: KnnIndex.load(spark, f"{path}/indexes/{k}") for k in manifest.get("indexes", [])})


def save_model(spark: SparkSession, model: Reduction, path: str, comment: str = "") -> None:
    model.table(spark).write.mode("overwrite").parquet(f"{path}/loadings")
    digest = _digest(spark.read.parquet(f"{path}/loadings"))
    _put(spark, f"{path}/manifest", json.dumps({"kind": "model", "version": VERSION, "comment": comment, "method": model.method, "zero": model.zero, "sdev": model.sdev.tolist(), "members": {"loadings": digest}}))


def load_model(spark: SparkSession, path: str) -> Reduction:
    import numpy as np

    manifest = _get(spark, f"{path}/manifest")
    if manifest["kind"] != "model":
        raise ValueError(f"{path} does not hold models")
    df = spark.read.parquet(f"{path}/loadings")
    if _digest(df) != manifest["members"]["loadings"]:
        raise ValueError("checksum of loadings differs")
    rows = df.orderBy("gene_id").collect()
    return Reduction(manifest["method"], [r.gene_id for r in rows], np.array([r.vec for r in rows]), np.array(manifest["sdev"]), np.array([r.center for r in rows]), np.array([r.scale for r in rows]), manifest["zero"])
