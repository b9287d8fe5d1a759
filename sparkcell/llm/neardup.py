"""Near-duplicates by MinHash bands, odd sketches and full sets.

1. Each text's set of word shingles gives MinHash samples for as many bands of WIDTH samples as let
   a pair at the threshold share none once in 1 / MISS times, and coarser keys of 2 and 4 bands
   together. PLACES further MinHash samples, one for each place of a one-permutation hash (the least
   hash of the shingles that fall there; a place without any has none), are folded into its odd
   sketch, a parity bitmap of BITS bits: each sample (place, value) flips one bit. Samples that two
   texts share cancel, so the bits in which two sketches differ count the samples they don't share;
   from that count and the numbers of samples comes the estimate of the sets' similarity.
2. Texts with equal sets are one class from here on; the least id stands for it.
3. In each bucket (texts with one key) every text is paired with the bucket's hub only, the member
   whose own buckets are fullest: bases of copies are hubs. So a bucket of n gives n - 1 pairs.
   Pairs whose estimate lies more than SLACK standard deviations below the threshold go, full sets
   confirm the rest, and components are taken.
4. What stars can miss: a bucket with members of several components. There, each member outside
   the hub's component is compared with the members of other components, sketch by sketch in
   blocks of BLOCK by BLOCK, whose sketches are compared as arrays. These comparisons grow with the
   square of a bucket's outsiders, all else in proportion. Pairs that pass are confirmed on full sets.
   Pairs inside a component are never made. Components are taken again. No bucket is capped.

Joins with a bucket's one row are salted by its size, SALT members at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import ModuleType, SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored, table
from .graph import components

WIDTH = 4
#: Chance that a pair at the threshold shares no band.
MISS = 4e-7
#: Words of a shingle, and links need 100 * intersection >= percent * union: of op3's contract, and
#: of other uses.
OP3_SHINGLE, OP3_PERCENT = 3, 85
SHINGLE, PERCENT = 5, 80
#: Places of the one-permutation hash whose samples a sketch folds, and its bits.
PLACES, BITS = 16384, 2048
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 5
SALT = 1024
BLOCK = 256
#: Members that one copy of a hub's text is sent along with.
CHUNK = 32
#: Pairs whose sketches are read at once.
READ = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 512, dtype=np.uint64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def bands(percent: int) -> int:
    """Bands of WIDTH samples, a multiple of 4, of which a pair at the threshold shares one."""
    return min(len(_A) // WIDTH, 4 * math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** WIDTH)) / 4)) if percent < 100 else 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash) of each word, in order. A-Z are read as a-z."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * _power("down", _BACK, len(data))[begin] + (end - begin).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]])
    return np.searchsorted(first, begin, "right") - 1, hashes


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of each distinct shingle, ordered by both."""
    doc, word = word_hashes(texts)
    counts = np.bincount(doc, minlength=len(texts))
    times = [np.uint64((2 * k + 3) * int(_BASE) & (1 << 64) - 1) for k in range(shingle)]
    whole = np.flatnonzero(doc[: max(0, len(doc) - shingle + 1)] == doc[shingle - 1 :]) if len(doc) >= shingle else np.zeros(0, np.int64)
    value = mixed(sum(word[whole + k] * times[k] for k in range(shingle))) if len(whole) else np.zeros(0, np.uint64)
    owner = doc[whole]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(few):
        short = np.array([mixed(np.array([sum(int(word[first[d] + k]) * int(times[k]) for k in range(counts[d])) + int(counts[d]) & (1 << 64) - 1], np.uint64))[0] for d in few], np.uint64)
        owner, value = np.concatenate([owner, few]), np.concatenate([value, short])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def signed(texts: list[str | None], shingle: int, percent: int) -> tuple[np.ndarray, ...]:
    """Of each text: set size, two hashes of the set, all keys, the number of samples that its
    sketch folds, and the sketch, as 64-bit words."""
    owner, value = shingle_sets(texts, shingle)
    m, n = bands(percent) * WIDTH, np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
    sums = np.zeros((2, len(texts)), np.uint64)
    samples = np.zeros((len(texts), m), np.uint64)
    if len(some):
        sums[0, some] = np.add.reduceat(mixed(value), first)
        sums[1, some] = np.add.reduceat(mixed(value ^ _BASE), first)
        for k in range(m):
            samples[some, k] = np.minimum.reduceat((value * _A[k] + _B[k]) >> np.uint64(24), first)

    def folded(rows: np.ndarray, tag: int) -> np.ndarray:
        out = np.full(rows.shape[:2], np.uint64(tag), np.uint64)
        for j in range(rows.shape[2]):
            out = mixed(out * _BASE + rows[:, :, j])
        return mixed(out + np.arange(rows.shape[1], dtype=np.uint64))

    keys = np.concatenate([folded(samples.reshape(len(texts), -1, WIDTH * w), w) for w in (1, 2, 4)], 1)
    # One permutation: a hash's high bits are its place, and the least hash of a place its sample.
    # Hashes are in order, so that is the first of each place.
    place = owner * PLACES + (value >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    doc, bit = owner[at], (mixed(value[at] * _BASE) % np.uint64(BITS)).astype(np.int64)
    parity = np.packbits((np.bincount(doc * BITS + bit, minlength=len(texts) * BITS) & 1).astype(np.uint8)).view(np.int64).reshape(len(texts), -1)
    return n, sums[0].view(np.int64), sums[1].view(np.int64), keys.view(np.int64), np.bincount(doc, minlength=len(texts)), parity


SKETCH = ("m", "sketch")


def _sign(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys, m, sketch = signed(batch.column(1).to_pylist(), shingle, percent)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), lists(keys), pa.array(m.astype(np.int64)), lists(sketch)], ["doc", "n", "s1", "s2", "keys", "m", "sketch"])

    return run


SIGNS = "doc long, n long, s1 long, s2 long, keys array<long>, m long, sketch array<long>"


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    out = F.lit(0)
    for k in range(BITS // 64):
        out = out + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return out


#: The functions of `allowed`, for arrays.
_ARRAYS = SimpleNamespace(least=np.minimum, greatest=np.maximum, pow=np.power, sqrt=np.sqrt, exp=np.exp, log=np.log, lit=lambda x: x)


def sized(n_x: Any, n_y: Any, percent: int, f: ModuleType | SimpleNamespace) -> Any:
    """Whether set sizes allow a link."""
    return f.least(n_x, n_y) * 100 >= f.greatest(n_x, n_y) * percent


def allowed(n_x: Any, n_y: Any, m_x: Any, m_y: Any, bits: Any, percent: int, f: ModuleType | SimpleNamespace) -> Any:
    """Whether the estimate from sketches that differ in `bits` allows a link: of columns with f the
    functions of Spark, of arrays with _ARRAYS.

    At the threshold t the union has (n_x + n_y) / (1 + t) shingles and fills `places` places (as
    expected, and as many more as the two sets fill above what is expected of them), of which a
    share of t have a common sample. z differing bits stand for
    -BITS / 2 * ln(1 - 2 z / BITS) samples that are not common, so (m_x + m_y - that) / 2 are.
    """
    t = percent / 100
    filled = lambda n: PLACES * (1 - f.pow(f.lit(1 - 1 / PLACES), n))
    union = (n_x + n_y) / (1 + t)
    places = filled(union) + (m_x - filled(n_x) + m_y - filled(n_y)) / 2
    lost = -BITS / 2 * f.log(1 - f.least(bits * (2.0 / BITS), f.lit(0.999)))
    # Variances at the threshold: the choice of `places` samples out of the union; whether what only
    # one of the sets has falls on a filled place, half of which shows in m_x and m_y; and, of the
    # samples that are not common, the BITS / 4 * (e ** ratio - 1 - ratio) with ratio = 4 / BITS times
    # their number that any odd sketch adds to `lost`.
    share = f.least(places / PLACES, f.lit(1.0))
    choice = places * (t * (1 - t)) * (1 - f.least(places / union, f.lit(1.0)))
    ratio = f.greatest(m_x + m_y - 2 * t * places, f.lit(1.0)) * (4.0 / BITS)
    sampling = choice + union * (1 - t) * share * (1 - share) * (t * t / 4)
    all_of = m_x + m_y
    common = lambda error: t * places - SLACK * f.sqrt(error)
    # Bits never count more than the samples that differ, which helps small sets; estimates large ones.
    return (bits <= all_of - 2 * common(sampling)) & ((all_of - lost) / 2 >= common(sampling + BITS / 16 * (f.exp(ratio) - 1 - ratio)) - 1)


def _near(x: str, y: str, percent: int) -> Column:
    """Whether set sizes and the sketches' estimate allow a link."""
    c = lambda k, side: F.col(f"{k}_{side}")
    return sized(c("n", x), c("n", y), percent, F) & allowed(c("n", x), c("n", y), c("m", x), c("m", y), differing(c("sketch", x), c("sketch", y)), percent, F)


def _across(percent: int):
    """Pairs (u, v) of each block: its outsiders, which come first, with the members after them that
    are in other components, as far as sizes and sketches allow a link. Rows are ordered by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, late, doc, comp, main, n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            rows = doc, comp, n, m, batch.column(9).flatten().to_numpy().reshape(batch.num_rows, -1)
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for a, b in zip(begin, [*begin[1:], batch.num_rows]):
                if (key[a], i[a], j[a]) != block:
                    block, held = (key[a], i[a], j[a]), []
                cut = a + np.count_nonzero(~late[a:b])
                if cut > a:
                    held.append([r[a:cut] for r in rows])
                if cut == b or not held:
                    continue
                if len(held) > 1:
                    held = [[np.concatenate(r) for r in zip(*held)]]
                doc_x, comp_x, n_x, m_x, sketch_x = held[0]
                doc_y, comp_y, n_y, m_y, sketch_y = (r[cut:b] for r in rows)
                # A pair of two outsiders would come twice.
                once = (comp_y == main[cut:b]) | (doc_x[:, None] < doc_y)
                x, y = np.nonzero(once & (comp_x[:, None] != comp_y) & sized(n_x[:, None], n_y, percent, _ARRAYS))
                for k in range(0, len(x), READ):
                    p, q = x[k : k + READ], y[k : k + READ]
                    bits = np.bitwise_count(sketch_x[p] ^ sketch_y[q]).sum(1, dtype=np.int64)
                    good = allowed(n_x[p], n_y[q], m_x[p], m_y[q], bits, percent, _ARRAYS)
                    if good.any():
                        yield pa.RecordBatch.from_arrays([pa.array(doc_x[p[good]]), pa.array(doc_y[q[good]])], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets pass. texts has doc and t. A text travels once for each
    CHUNK pairs in which it is the first, and once for each in which it is the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            owner, value = shingle_sets(batch.column(3).to_pylist(), shingle)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = []
            for k, (u, leads, doc) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                own = value[cut[k] : cut[k + 1]]
                if leads:
                    hub, hub_set = u, own
                    continue
                both = len(np.intersect1d(hub_set, own, assume_unique=True))
                if u == hub and 100 * both >= percent * (len(hub_set) + len(own) - both):
                    out.append((u, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["u", "v"])

    sizes = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__c"))
    jobs = pairs.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("__c")).alias("chunk"))
    jobs = jobs.select("u", "chunk", F.lit(False).alias("leads"), F.col("v").alias("doc")).unionByName(jobs.select("u", "chunk").distinct().select("u", "chunk", F.lit(True).alias("leads"), F.col("u").alias("doc")))
    # Pairs have no proven bound, so neither side is broadcast, whatever their size is now.
    jobs = jobs.join(texts.hint("merge"), "doc").repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.desc("leads"))
    return jobs.select("u", "leads", "doc", "t").mapInArrow(run, "u long, v long")


def _salted(rows: DataFrame, buckets: DataFrame, names: list[str]) -> DataFrame:
    """rows (key, c, doc, ...) with the columns `names` of buckets (key, c, ...), which has one row
    a key: a bucket of c members is dealt out in about c / SALT parts."""
    parts = F.ceil(F.col("c") / SALT).cast("long")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), parts))
    return left.join(buckets.select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"), *names), ["key", "salt"]).drop("salt")


def links(signs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes (rep, s1, s2, n) of equal sets, and edges (u, v) of their representatives whose
    components are those of all links. signs is a stored table of _sign's rows, one for each doc."""
    same = signs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), F.first("keys").alias("keys"), *(F.first(k).alias(k) for k in SKETCH))
    same = stored(same, "near-classes")
    marks = same.select(F.col("rep").alias("doc"), "n", *SKETCH)
    keys = same.select(F.col("rep").alias("doc"), F.posexplode("keys").alias("at", "key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(keys.join(full, "key"), "near-members")
    rank = members.groupBy("doc").agg(F.sum(F.when(F.col("at") < bands(percent), F.col("c")).otherwise(0)).alias("rank"))
    hubs = members.join(rank, "doc").groupBy("key").agg(F.max_by("doc", F.struct("rank", -F.col("doc"))).alias("hub"), F.max("c").alias("c"))
    stars = _salted(members, hubs, ["hub"]).where("doc <> hub").select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct()
    left, right = (marks.select(F.col("doc").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", *SKETCH))) for x in "uv")
    near = lambda pairs: pairs.join(left, "u").join(right, "v").where(_near("u", "v", percent)).select("u", "v")
    found = stored(confirmed(stored(near(stars), "near-pairs"), texts, shingle, percent), "near-links")
    first = components(found)
    # Buckets that still hold several components.
    placed = members.where(F.col("at") < bands(percent)).join(first, F.col("doc") == F.col("node"), "left")
    placed = placed.select("key", "at", "c", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed_up = placed.where("c > 2").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    main = hubs.join(first, F.col("hub") == F.col("node"), "left").select("key", "c", F.coalesce("component", "hub").alias("main"))
    placed = stored(_salted(placed, main.join(mixed_up, "key"), ["main"]).join(marks, "doc"), "near-mixed")
    counts = placed.groupBy("key").agg(F.sum((F.col("comp") != F.col("main")).cast("long")).alias("few"), F.max("c").alias("c"))
    parts = _salted(placed, counts, ["few"]).select("*", F.ceil(F.col("few") / BLOCK).alias("bf"), F.ceil(F.col("c") / BLOCK).alias("bc"))
    block = lambda x: F.pmod(F.xxhash64("doc"), F.greatest(F.col(x), F.lit(1)))
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(x), F.lit(1)).cast("long") - 1))
    cols = ["doc", "comp", "main", "n", *SKETCH]
    few = parts.where("comp <> main").select("key", block("bf").alias("i"), each("bc").alias("j"), F.lit(False).alias("late"), *cols)
    rest = parts.select("key", each("bf").alias("i"), block("bc").alias("j"), F.lit(True).alias("late"), *cols)
    blocks = few.unionByName(rest).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "late")
    over = blocks.mapInArrow(_across(percent), "u long, v long").distinct()
    over = over.join(stars, ["u", "v"], "left_anti").join(stars.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    over = stored(over, "near-pairs")
    edges = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    if not over.isEmpty():
        edges = edges.unionByName(stored(confirmed(over, texts, shingle, percent), "near-links"))
    return same.select("rep", "s1", "s2", "n"), edges


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame | None]:
    """(id, n, component, first) of each row, `first` telling whether the row's document is its
    component's least; and, where ids repeat, the rows (node, id, t) of such ids, else None.

    Rows whose id has several sets of shingles are nodes of their own, with numbers above all ids;
    by_id links those that share an id.
    """
    prepare(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    sign = lambda rows: rows.mapInArrow(_sign(shingle, percent), SIGNS)
    signs = stored(sign(texts), "near-signs")
    null = signs.where("doc is null").select(F.col("doc").alias("id"), "n", F.lit(None).cast("long").alias("component"), F.lit(True).alias("first"))
    signs, texts = signs.where("doc is not null"), texts.where("doc is not null")
    several = signs.groupBy("doc").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc")
    several, loose = stored(several, "near-shared-ids"), None
    if not several.isEmpty():
        top = signs.agg(F.max("doc")).first()[0] + 1
        loose = stored(texts.join(several, "doc", "left_semi").select((F.monotonically_increasing_id() + F.lit(top)).alias("node"), F.col("doc").alias("id"), "t"), "near-shared-texts")
        if loose.agg(F.max("node")).first()[0] < top:
            raise ValueError("ids leave no room for numbers above them")
        own = loose.select(F.col("node").alias("doc"), "t")
        signs = stored(signs.join(several, "doc", "left_anti").unionByName(sign(own)), "near-signs")
        texts = texts.join(several, "doc", "left_anti").unionByName(own)
    same, edges = links(signs, texts, shingle, percent)
    if loose is not None and by_id:
        # Of each class the representative is the node; classes in which one id occurs are linked.
        nodes = signs.where("n > 0").join(same, ["s1", "s2", "n"]).join(loose.select(F.col("node").alias("doc"), "id"), "doc").groupBy("id").agg(F.min("rep").alias("u"), F.collect_set("rep").alias("all"))
        edges = edges.unionByName(nodes.select("u", F.explode("all").alias("v")).where("u <> v"))
    found = components(edges)
    reps = same.join(found, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    out = signs.select("doc", "s1", "s2", "n").join(reps, ["s1", "s2", "n"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    if loose is None:
        return out.select(F.col("doc").alias("id"), "n", "component", (F.col("doc") == F.col("component")).alias("first")).unionByName(null), None
    out = out.join(loose.select(F.col("node").alias("doc"), F.col("id").alias("real")), "doc", "left").withColumn("real", F.coalesce("real", "doc"))
    if by_id:  # rows of an id without shingles follow its other rows
        linked = out.where("n > 0").groupBy("real").agg(F.min("component").alias("of"))
        out = out.join(linked, "real", "left").withColumn("component", F.coalesce("of", "component"))
    least = out.groupBy("component").agg(F.min("real").alias("least"))
    out = out.join(least, "component").select(F.col("real").alias("id"), "doc", "n", F.col("least").alias("component"), (F.col("real") == F.col("least")).alias("first"))
    return out.select("id", "n", "component", "first", "doc").unionByName(null.withColumn("doc", F.lit(None).cast("long"))), loose


def near_dedup(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: the id, n_shingles, component_id, kept.

    Words are split at white space, A-Z read as a-z. A text of fewer words than a shingle has one
    shingle, its whole sequence; null, empty and blank texts have none and are linked with nothing.
    Rows that share an id are one document, which is linked with whatever one of its texts is linked
    with. Rows with a null id have a null component_id, are linked with nothing and are kept. An
    empty table gives an empty result. Other columns are not read.
    """
    out, _ = _grouped(df, id_col, text_col, shingle, percent, by_id=True)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("first").alias("kept"))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of df whose document stays, one for each component. Where rows with different texts
    share an id, each row is judged by its own text, so none is lost that is held nowhere else."""
    out, loose = _grouped(df, id_col, text_col, shingle, percent, by_id=False)
    gone = out.where("not first")
    name = next(f"gone{k}" for k in range(len(df.columns) + 1) if f"gone{k}" not in map(str.lower, df.columns))
    one = gone if loose is None else gone.join(loose, gone["doc"] == loose["node"], "left_anti")
    left = df.join(one.select(F.col("id").alias(name)).distinct(), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
    if loose is not None:
        rows = gone.select("doc").join(loose, F.col("doc") == F.col("node")).select(F.col("id").alias(name), F.coalesce("t", F.lit("")).alias(f"{name}t")).distinct()
        left = left.join(rows, (F.col(f"`{id_col}`").cast("long") == F.col(name)) & (F.coalesce(F.col(f"`{text_col}`"), F.lit("")) == F.col(f"{name}t")), "left_anti")
    return left


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", OP3_SHINGLE, OP3_PERCENT)


ORACLE = f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {OP3_SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {OP3_SHINGLE - 2}), lambda k: array_to_string(w[k:k + {OP3_SHINGLE - 1}], ' ')) end) as s from d)),
n as materialized (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * i >= {OP3_PERCENT} * (x.n + y.n - i)),
b as materialized (select u, v from e union all select v, u from e),
r as (select doc_id as a, doc_id as z from d union select r.a, b.v from r join b on r.z = b.u),
m as (select a, min(z) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, m.component_id = d.doc_id as kept from d join m on m.a = d.doc_id left join n on n.doc_id = d.doc_id"""
