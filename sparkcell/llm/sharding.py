"""Extendible hashing: cut a table into shards by the bits of a hash.

The directory starts as one bucket. Only a bucket over its byte limit splits, on the next bit,
until each fits. Bits come from md5(key columns), 128 of them, most significant first. Rows of
one key that no bit can part (a hot key) go on with the bits of md5(key, tie columns, size), another
128, and rows equal in these and in size are dealt out by count, as they can't be told apart.

All of it is DataFrame operations. One round settles STEP bits: row bytes are summed for each
cell of STEP bits (map-side first), the cells' ancestors are summed, and the shallowest ancestor
within the limit is the shard. Cells that are still too large go to the next round, alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: Bits that a round settles; its cells are at most 2 ** STEP under each open prefix.
STEP = 12
BITS = 256
#: Production limit of a shard.
LIMIT = 16 * 1024 * 1024


def _oi(digit: str) -> str:
    return f"{int(digit, 16):04b}".replace("0", "o").replace("1", "i")


def bits(*columns: Column) -> Column:
    """128 bits of the md5 of the columns' strings, as a string of 0 and 1. Null differs from ''."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns))
    digest = F.md5(text.cast("binary"))
    for digit in "0123456789abcdef":  # o and i are no hex digits, so no replaced bit is replaced again
        digest = F.replace(digest, F.lit(digit), F.lit(_oi(digit)))
    return F.translate(digest, "oi", "01")


def shard(df: DataFrame, size: Column, key: Sequence[str], tie: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """The columns key and tie of each row, with n_bytes, shard_id, shard_bytes and oversized.

    shard_id is the bucket's bit prefix ("" is the whole table), with ".k" for the k-th part of
    rows equal in key and tie. A row larger than the limit is a shard of its own with oversized
    true. Null sizes count as 0 bytes; null keys are keys; an empty table gives an empty result.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    names = list(dict.fromkeys([*key, *tie]))
    rows = df.select(*names, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("__b"))
    rows = rows.groupBy(*names, "__b").agg(F.count(F.lit(1)).alias("__n"))
    rows = stored(rows.withColumn("__h", F.concat(bits(*(F.col(c) for c in key)), bits(*(F.col(c) for c in [*names, "__b"])))), "shard-rows")
    sized = rows.select("__h", (F.col("__b") * F.col("__n")).alias("__s"))
    # A round's open prefixes are those of `depth` bits that still hold more than the limit.
    done, depth = [], 0
    open_cells = sized.sparkSession.createDataFrame([("",)], "__p string")
    while depth < BITS:
        step = min(STEP, BITS - depth)
        under = sized.withColumn("__p", F.substring("__h", 1, depth))
        if depth:
            under = under.join(open_cells, "__p", "left_semi")
        cells = under.groupBy(F.substring("__h", 1, depth + step).alias("__c")).agg(F.sum("__s").alias("__s"))
        levels = F.sequence(F.lit(depth), F.lit(depth + step))
        nodes = cells.select(F.explode(F.transform(levels, lambda d: F.substring(F.col("__c"), F.lit(1), d))).alias("__p"), "__s")
        nodes = stored(nodes.groupBy("__p").agg(F.sum("__s").alias("__s")), "shard-nodes")
        parent = nodes.select(F.col("__p").alias("__q"), F.col("__s").alias("__qs"))
        fits = nodes.where((F.col("__s") <= limit) & (F.length("__p") > depth if depth else F.lit(True)))
        fits = fits.join(parent, F.expr("length(__p) > 0 and __q = substring(__p, 1, length(__p) - 1)"), "left")
        done.append(fits.where(F.col("__qs").isNull() | (F.col("__qs") > limit)).select("__p", "__s"))
        open_cells = nodes.where((F.col("__s") > limit) & (F.length("__p") == depth + step)).select("__p")
        depth += step
        if open_cells.isEmpty():
            break
    else:
        done.append(sized.withColumnRenamed("__h", "__p").join(open_cells, "__p", "left_semi").groupBy("__p").agg(F.sum("__s").alias("__s")))
    directory = done[0]
    for more in done[1:]:
        directory = directory.unionByName(more)
    return _assigned(rows, stored(directory, "shard-directory"), names, limit)


def _assigned(rows: DataFrame, directory: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Each row's bucket. One equi-join for each depth that occurs; the depths are at most BITS + 1."""
    depths = [r[0] for r in directory.select(F.length("__p")).distinct().collect()]
    probes = F.array(*(F.substring("__h", 1, d) for d in sorted(depths))) if depths else F.array(F.lit(""))
    # Two buckets never nest, so exactly one probe of a row is in the directory.
    probed = rows.select("*", F.explode(probes).alias("__p"))
    found = probed.join(directory, "__p")
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("__b"), F.lit(1))), F.lit(1)).cast("long")
    cut = (F.col("__s") > limit) & (F.length("__p") == BITS)
    parts = F.when(cut, F.ceil(F.col("__n") / fit)).otherwise(F.lit(1)).cast("long")
    found = found.withColumn("__fit", fit).withColumn("__cut", cut).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    count = F.when(F.col("__cut"), F.least(F.col("__fit"), F.col("__n") - F.col("__k") * F.col("__fit"))).otherwise(F.col("__n"))
    found = found.withColumn("__m", count).withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return found.select(
        *names,
        F.col("__b").alias("n_bytes"),
        F.when(F.col("__cut"), F.concat_ws(".", "__p", F.col("__k").cast("string"))).otherwise(F.col("__p")).alias("shard_id"),
        F.when(F.col("__cut"), F.col("__m") * F.col("__b")).otherwise(F.col("__s")).alias("shard_bytes"),
        (F.col("__b") > limit).alias("oversized"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into shards of at most 16 MiB of UTF-8 text, by doc_id."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    return shard(docs, F.octet_length("text"), ["doc_id"]).select("doc_id", "n_bytes", "shard_id", "shard_bytes", "oversized")


def oracle(limit: int = LIMIT, depth: int = 40) -> str:
    """DuckDB SQL for op1: the shallowest prefix within the limit."""
    digits = "md5('v' || cast(doc_id as varchar))"
    for digit in "0123456789abcdef":
        digits = f"replace({digits}, '{digit}', '{_oi(digit)}')"
    return f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, translate({digits}, 'oi', '01') as h from documents),
p as (select substr(h, 1, k) as p, k, sum(n_bytes)::bigint as s from d, range({depth + 1}) r(k) group by 1, 2),
f as (select doc_id, n_bytes, h, min(k) as k from d, range({depth + 1}) r(k) where exists (select 1 from p where p.p = substr(h, 1, r.k) and p.k = r.k and p.s <= {limit}) group by 1, 2, 3)
select doc_id, n_bytes, substr(h, 1, f.k) as shard_id, p.s as shard_bytes, n_bytes > {limit} as oversized
from f join p on p.k = f.k and p.p = substr(h, 1, f.k)"""
