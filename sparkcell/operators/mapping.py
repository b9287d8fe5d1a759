"""The extension point for functions of one gene, and small numeric helpers on collected tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_genes(counts: DataFrame, fn: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, cells: pd.DataFrame | None = None) -> DataFrame:
    """fn(gene_id, entries) of each gene, in parallel; entries are its stored (cell_id, value), with
    the columns of `cells` (a small table, sent to each task) joined to them if it is given."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return fn(key[0], rows if cells is None else rows.merge(cells, on="cell_id", how="left"))

    return counts.select("gene_id", "cell_id", "value").groupBy("gene_id").applyInPandas(run, schema)


def probabilities(x: np.ndarray) -> np.ndarray:
    """x over its sum, zeros where there is none."""
    total = x.sum()
    return x / total if total else np.zeros_like(x, dtype=float)


def entropy(p: np.ndarray) -> float:
    """Shannon entropy in bits; infinite for negative or empty vectors."""
    if (p < 0).any() or p.sum() <= 0:
        return float("inf")
    p = p[p > 0] / p.sum()
    return float(-(p * np.log2(p)).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence; 1 where it is infinite, 0 where negative."""
    d = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    return 1.0 if not np.isfinite(d) else float(np.sqrt(max(d, 0.0)))


def ward_order(x: np.ndarray) -> list[int]:
    """Order of rows by Ward clustering of 1 - correlation; for tables of groups, not cells."""
    n = len(x)
    if n < 3:
        return list(range(n))
    with np.errstate(invalid="ignore"):
        d = np.nan_to_num(1 - np.corrcoef(x), nan=1.0) ** 2
    parts, size = {k: [k] for k in range(n)}, {k: 1 for k in range(n)}
    dist = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    while len(parts) > 1:
        a, b = min(dist, key=lambda k: (dist[k], k))
        pair = dist.pop((a, b))
        for c in [k for k in parts if k not in (a, b)]:
            ac, bc = dist.pop((min(a, c), max(a, c))), dist.pop((min(b, c), max(b, c)))
            t = size[a] + size[b] + size[c]
            dist[min(a, c), max(a, c)] = ((size[a] + size[c]) * ac + (size[b] + size[c]) * bc - size[c] * pair) / t
        parts[a] += parts.pop(b)
        size[a] += size.pop(b)
    return next(iter(parts.values()))
