"""Concatenate and cut: pack documents into sequences of a fixed number of tokens.

Pass one tokenizes each document once and writes its ids with their place in the task's own stream
and the task's total. The totals, one number a task, are summed on the driver in task order: this
gives each task its global offset. Pass two reads the ids back, adds the offset and cuts at each
multiple of the window; a document that crosses one leaves a piece in each window. Nothing is
shuffled, and only the last window of the whole table is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import transducer
from .common import prepare, stored, table
from .tokens import MAX_TOKENS, vocabulary

#: The id that ends each document.
END = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str, text_col: str, path: str, window: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """One row per piece: the id, start (the document's ids before it), length, ids_crc32 (of the
    ids as unsigned little-endian 32-bit numbers), doc_tokens (with the end id), sequence_id, offset.

    A null text is an empty one: just its end id. Repeated rows are packed each. An empty table
    gives no pieces. Other columns are not read.
    """
    prepare(df.sparkSession)
    field = df.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, task, at = transducer(path).vocabulary, TaskContext.get().partitionId(), 0
        last = np.array([end], "<u2").tobytes()
        for batch in batches:
            ids = [x + last for x in vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])]
            sizes = [len(x) // 2 for x in ids]
            starts = at + np.concatenate([[0], np.cumsum(sizes)])
            at = int(starts[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([task] * len(ids), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["id", "task", "at", "n", "ids"])

    tokens = stored(df.select(id_col, text_col).mapInArrow(tokenize, f"id {field}, task long, at long, n long, ids binary"), "pack-tokens")
    offset, offsets = 0, {}
    for task, n in tokens.groupBy("task").agg(F.sum("n")).orderBy("task").collect():  # one row a task
        offsets[task] = offset
        offset += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, task, at, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                begin, wide, start = offsets[task] + at, np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    seq, place = divmod(begin + start, window)
                    length = min(n - start, window - place)
                    rows.append((key, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, seq, place))
                    start += length
            columns = list(zip(*rows)) or [()] * 7
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.select("id", "task", "at", "n", "ids").mapInArrow(cut, f"`{id_col}` {field}, {PIECES}")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary())
