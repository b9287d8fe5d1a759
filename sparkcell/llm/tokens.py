"""Token counts by a compiled tokenizer (see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import transducer
from .common import prepare, table

#: Tokens of a training sequence.
MAX_TOKENS = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; ids may be
    null; other columns are not read; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = machine.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary())
