"""Repeated windows by a depth-limited radix sort of suffixes.

A byte goes if a string of WINDOW bytes over it also starts earlier. Suffixes are ordered only
through WINDOW bytes, digit by digit, and a group that a pass leaves with one member is dropped:

1. The first digit of a suffix is the least (by a hash) GRAM-byte string inside its window, its
   anchor: content decides it, so equal windows have equal anchors at equal distances. One row per
   anchor stands for all the suffixes that have it (some 30 bytes each), so this pass moves a
   fraction of the positions. Each task first drops its own repeats.
2. The second digit is the anchor's whole context, all bytes that any of its windows can reach. Of
   equal contexts only the first goes on; all windows of the others are repeats, whole. An anchor
   with one context is done.
3. Only for anchors with several contexts do these contexts travel, as bytes, to be told apart by
   the last digit, a whole window (128 bits of hash): equal groups are the repeated windows, and
   the least member of each stays. Up to CROWD contexts of an anchor are sorted in one task, batches
   of anchors at a time; a larger group is dealt out by window, a row for each.

What the passes find is laid over the documents as byte ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import prepare, stored, table

WINDOW = 100
GRAM = 32
#: A place is a row's number times 2 ** SHIFT plus the byte's place in the row. The number is 0, but
#: for rows that share an id.
SHIFT = 31
PARTS = 64
#: Windows that may have an anchor at their first to last place.
REACH = WINDOW - GRAM
#: Bytes that are worked on at once.
BLOCK = 1 << 20
#: Contexts of one anchor that one task may sort, and rows that it sorts together.
CROWD, TOGETHER = 65_536, 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _rolled(data: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of the `size` bytes from each place on, from hashes of powers of two."""
    out, have, done, total = None, data.astype(np.uint64) + np.uint64(1), 0, size
    width, power = 1, base
    while total:
        if total & 1:
            if out is None:
                out = have
            else:
                n = len(data) - done - width + 1
                out = out[:n] * power + have[done : done + n]
            done += width
        total >>= 1
        if total:
            have = have[: len(have) - width] * power + have[width:]
            width, power = 2 * width, _square(power)
    return out


def _square(x: np.uint64) -> np.uint64:
    return np.uint64(int(x) * int(x) & (1 << 64) - 1)


def _least(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """The least of the `size` values from each place on."""
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return x if width == size else pick(x[: len(x) - (size - width)], x[size - width :])


class Segment:
    """The windows that start at places [begin, end) of a document, with the bytes they reach."""

    def __init__(self, doc: int, base: int, raw: bytes, begin: int, end: int) -> None:
        self.doc, self.base, self.size, self.begin, self.end = doc, base, len(raw), begin, end
        self.low = max(0, begin - REACH)
        self.raw = raw[self.low : min(len(raw), end + WINDOW + REACH)]


def segments(rows: Iterable[tuple[int, int, bytes]], size: int = BLOCK) -> Iterator[list[Segment]]:
    """Blocks of segments of about `size` bytes; a longer document is cut into several."""
    held, n = [], 0
    for doc, base, raw in rows:
        for begin in range(0, len(raw) - WINDOW + 1, size):
            held.append(Segment(doc, base, raw, begin, min(begin + size, len(raw) - WINDOW + 1)))
            n += len(held[-1].raw)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _masked(block: list[Segment]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block; for each segment its first byte there; anchor hashes (of places whose
    gram lies in one segment, else the largest number); and the starts of its own windows."""
    data = np.frombuffer(b"".join(s.raw for s in block), np.uint8)
    sizes = np.array([len(s.raw) for s in block])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = np.full(len(data), _NONE)
    rolled = _mixed(_rolled(data, GRAM, _ODD))
    hashes[: len(rolled)] = rolled
    for at in first[1:]:
        hashes[max(0, at - GRAM + 1) : at] = _NONE
    own = np.zeros(len(data), bool)
    for s, at in zip(block, first):
        own[at + s.begin - s.low : at + s.end - s.low] = True
    return data, first, hashes, own


def _minima(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each place the least anchor hash of its window, where `own`, else 0."""
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) > REACH:
        least = _least(hashes, REACH + 1)
        out[: len(least)] = np.where(own[: len(least)], least, 0)
    return out


def anchors(block: list[Segment]) -> tuple[np.ndarray, ...]:
    """(doc, place, anchor, context) of each anchor: the least gram of a window, all of equals."""
    data, first, hashes, own = _masked(block)
    least = _minima(hashes, own)
    reach = _least(np.concatenate([np.zeros(REACH, np.uint64), least]), REACH + 1, np.maximum)
    at = np.flatnonzero((reach == hashes) & (hashes != _NONE))
    which = np.searchsorted(first, at, "right") - 1
    low = np.array([s.low for s in block])[which]
    place = at - first[which] + low
    size = np.array([s.size for s in block])[which]
    # A context runs REACH bytes to either side of the anchor, or to the document's ends.
    left, right = np.minimum(place, REACH), np.minimum(size - place - GRAM, REACH)
    begin, length = at - left, left + GRAM + right
    context = _spans(data, begin, length) + (left * 1000 + right).astype(np.uint64) * _SECOND
    doc, base = (np.array(x, np.int64)[which] for x in ([s.doc for s in block], [s.base for s in block]))
    return doc, place + base, hashes[at].view(np.int64), _mixed(context).view(np.int64), size


def _spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges. The lengths are at most WINDOW + REACH; each is the sum of
    hashes of powers of two, so every range costs a few steps."""
    out = np.zeros(len(begin), np.uint64)
    have, width, power, at = data.astype(np.uint64) + np.uint64(1), 1, _SECOND, begin.copy()
    top = int(length.max(initial=0))
    while width <= top:
        on = (length & width) > 0
        out[on] = out[on] * power + have[np.minimum(at[on], len(have) - 1)]
        at = at + np.where(on, width, 0)
        if 2 * width > top:
            break
        have = have[: len(have) - width] * power + have[width:]
        width, power = 2 * width, _square(power)
    return out


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs, in order."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass one in a task: anchors with their contexts, of equal ones the first only (till 0); what
    the others cover comes out as runs [place, till), under an anchor of their own."""
    rows = ((k, part << SHIFT, t.encode()) for b in batches for k, part, t in zip(*(c.to_pylist() for c in b.columns)) if t and k is not None)
    for block in segments(rows):
        doc, place, anchor, context, size = anchors(block)
        order = np.lexsort((place, doc, context, anchor))
        doc, place, anchor, context, size = (x[order] for x in (doc, place, anchor, context, size))
        same = np.zeros(len(doc), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]) & ((doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))
        runs = []
        for d in np.unique(doc[same]).tolist():
            on = same & (doc == d)
            base = place[on] >> SHIFT << SHIFT
            begin, end = np.maximum(place[on] - REACH, base), np.minimum(place[on] + WINDOW, size[on] + base)
            begin, end = _merged(begin[end - begin >= WINDOW], end[end - begin >= WINDOW])
            runs += [(d, x, y) for x, y in zip(begin.tolist(), end.tolist())]
        run = np.array(runs, np.int64).reshape(-1, 3)
        own = _mixed(_mixed(run[:, 0].astype(np.uint64)) + run[:, 1].astype(np.uint64)).view(np.int64)
        columns = [(anchor[~same], own), (context[~same], np.zeros(len(run), np.int64)), (doc[~same], run[:, 0]), (place[~same].astype(np.int64), run[:, 1]), (np.zeros((~same).sum(), np.int64), run[:, 2])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["anchor", "context", "doc", "place", "till"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, crowd, doc, place, low, bytes): the bytes from `low` on that an open anchor reaches."""
    for batch in batches:
        rows = []
        for doc, part, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            raw, base = (text or "").encode(), part << SHIFT
            for m in marks:
                place = m["place"] - base
                if place >> SHIFT == 0:
                    low = max(0, place - REACH)
                    rows.append((m["anchor"], m["crowd"], doc, m["place"], low + base, raw[low : place + WINDOW]))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [*[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "crowd", "doc", "place", "low", "bytes"])


_WIDE = REACH + WINDOW


def _window_keys(places: np.ndarray, lows: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and two hashes of each whole window in contexts that are set side by side, their
    anchors in one column."""
    data = np.zeros((len(raw), _WIDE), np.uint64)
    left, size = places - lows, np.array([len(x) for x in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(REACH - left, size)
    data[row, column] = flat.astype(np.uint64) + np.uint64(1)
    shift = np.arange(REACH + 1)  # a window begins so many bytes left of its anchor
    fine = (shift <= left[:, None]) & (WINDOW - shift <= (size - left)[:, None])
    keys = []
    for base in (_ODD, _SECOND):
        back = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_WIDE - 1, base)]))
        undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(REACH, back)]))
        sums = np.concatenate([np.zeros((len(raw), 1), np.uint64), np.cumsum(data * power, axis=1)], axis=1)
        begin = REACH - shift
        keys.append(_mixed((sums[:, begin + WINDOW] - sums[:, begin]) * undo[begin]))
    r, s = np.nonzero(fine)
    return r, places[r] - s, keys[0][r, s], keys[1][r, s]


def _repeats(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of what the last digit covers, for whole groups of rows (anchor, doc,
    place, low, bytes) that are in order by anchor, doc, place.

    Contexts stand side by side, a byte a cell, with their anchors in one column. One distance of
    window and anchor after the other, the windows' hashes roll on by a byte and are sorted; equal
    windows have their anchors at equal distances. So a row costs some WINDOW + REACH bytes.
    """
    anchor, doc, place, low = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    raw = [r[4] for r in rows]
    left, size = place - low, np.array([len(x) for x in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    data = np.zeros((_WIDE, len(rows)), np.uint8)
    data[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(REACH - left, size), np.repeat(np.arange(len(rows)), size)] = flat
    cell = lambda k: data[k].astype(np.uint64) + np.uint64(1)
    bases = (_ODD, _SECOND)
    tops = [np.uint64(pow(int(b), WINDOW - 1, 1 << 64)) for b in bases]
    rolled = [np.zeros(len(rows), np.uint64) for _ in bases]
    for k in range(REACH + WINDOW - 1, REACH - 1, -1):
        rolled = [h * b + cell(k) for h, b in zip(rolled, bases)]
    group, found_row, found_at = anchor.view(np.uint64) * _SECOND, [], []
    for shift in range(REACH + 1):
        if shift:
            rolled = [(h - cell(_WIDE - shift) * t) * b + cell(REACH - shift) for h, b, t in zip(rolled, bases, tops)]
        row = np.flatnonzero((shift <= left) & (WINDOW - shift <= size - left))
        k1, k2 = _mixed(_mixed(rolled[0][row]) + group[row]), rolled[1][row]
        order = np.lexsort((row, k2, k1))
        row, k1, k2 = row[order], k1[order], k2[order]
        again = np.zeros(len(row), bool)
        again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(row))))
        again &= (doc[row] != doc[row[first]]) | (place[row] != place[row[first]])
        found_row.append(row[again])
        found_at.append(place[row[again]] - shift)
    row, at = np.concatenate(found_row), np.concatenate(found_at)
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1 if len(row) else head
    return doc[row[head]], at[head], at[tail] + WINDOW


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass three for anchors of up to CROWD contexts; rows come in order by anchor, doc, place."""
    held: list[tuple] = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _repeats(rows)], ["doc", "begin", "end"])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= TOGETHER:
            cut = len(held) - 1
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield out(held[:cut])
                held = held[cut:]
    if held:
        yield out(held)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass three for larger groups: a row for each window."""
    for batch in batches:
        doc, place, low, raw = (c.to_pylist() for c in batch.columns)
        if raw:
            row, at, k1, k2 = _window_keys(np.array(place, np.int64), np.array(low, np.int64), raw)
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.array(doc, np.int64)[row]), pa.array(at)], ["k1", "k2", "doc", "place"])


def _cut(raw: bytes, covers: list[dict] | None, base: int = 0) -> tuple[list[tuple[int, int]], bytes]:
    """The removed runs and the kept bytes. A cover may reach over the end; it counts if at least
    WINDOW bytes of it are there."""
    if not covers:
        return [], raw
    own = [c for c in covers if (c["begin"] - base) >> SHIFT == 0]
    begin, end = np.array([c["begin"] - base for c in own], np.int64), np.minimum(np.array([c["end"] - base for c in own], np.int64), len(raw))
    begin, end = _merged(begin[end - begin >= WINDOW], end[end - begin >= WINDOW])
    runs = list(zip(begin.tolist(), end.tolist()))
    kept, at = [], 0
    for b, e in runs:
        kept.append(raw[at:b])
        at = e
    return runs, b"".join([*kept, raw[at:]])


def covers(texts: DataFrame) -> DataFrame:
    """(doc, covers): byte ranges that repeat an earlier string, for documents that have any; texts
    is (doc, part, t) without null doc."""
    found = texts.mapInArrow(_firsts, "anchor long, context long, doc long, place long, till long")
    # Passes one and two share one exchange and sort, by anchor.
    me = F.struct("doc", "place")
    first = F.first(me).over(Window.partitionBy("anchor", "context").orderBy("doc", "place"))
    digits = found.withColumn("later", me != first)
    whole = Window.partitionBy("anchor")
    digits = digits.withColumn("several", F.min("context").over(whole) != F.max("context").over(whole)).withColumn("crowd", F.sum((~F.col("later")).cast("long")).over(whole))
    digits = digits.select("anchor", "doc", "place", "till", "later", "crowd").where("later or several or till > 0")
    digits = stored(digits, "substring-digits")
    # Pass three. The texts are dealt by doc once, for this join and the caller's.
    opened = digits.where("not later and till = 0").groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "crowd")).alias("marks"))
    contexts = texts.join(opened, "doc").select("doc", "part", "t", "marks").mapInArrow(_contexts, "anchor long, crowd long, doc long, place long, low long, bytes binary")
    few = contexts.where(F.col("crowd") <= CROWD).select("anchor", "doc", "place", "low", "bytes").repartition("anchor").sortWithinPartitions("anchor", "doc", "place")
    few = few.mapInArrow(_resolved, "doc long, begin long, end long")
    many = contexts.where(F.col("crowd") > CROWD).select("doc", "place", "low", "bytes").mapInArrow(_dealt, "k1 long, k2 long, doc long, place long")
    many = many.select("doc", "place", F.first(me).over(Window.partitionBy("k1", "k2").orderBy("doc", "place")).alias("first")).where(me != F.col("first"))
    ranges = lambda d, b, e: d.select("doc", b.cast("long").alias("begin"), e.cast("long").alias("end"))
    place = F.col("place")
    every = ranges(digits.where("till > 0"), place, F.col("till"))
    every = every.unionByName(ranges(digits.where("later and till = 0"), F.greatest(place - REACH, F.shiftleft(F.shiftright(place, SHIFT), SHIFT)), place + WINDOW))
    every = every.unionByName(few).unionByName(ranges(many, place, place + WINDOW))
    return every.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("covers"))


def numbered(texts: DataFrame) -> DataFrame:
    """(doc, part, t) of (doc, t): part is 0, but tells rows apart that share an id."""
    several = stored(texts.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc"), "substring-shared-ids")
    alone = texts.select("doc", F.lit(0).cast("long").alias("part"), "t")
    if several.isEmpty():
        return alone
    same = texts.join(several, "doc", "left_semi").repartition(PARTS, "doc", "t").sortWithinPartitions("doc", "t")
    row = F.monotonically_increasing_id()
    same = stored(same.select("doc", (row.bitwiseAND(F.lit((1 << 33) - 1)) * PARTS + F.shiftright(row, 33)).alias("part"), "t"), "substring-shared-texts")
    if same.agg(F.max("part")).first()[0] >> (62 - SHIFT):
        raise ValueError("too many rows share their ids")
    return alone.join(several, "doc", "left_anti").unionByName(same)


def dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (spans).

    Strings are judged on the input. A null text is empty; texts of fewer than 100 bytes lose
    nothing; rows with a null id lose nothing and count for no one; rows that share an id stand one
    after the other, in an order that depends on the rows only, and no match crosses from one to the
    next; an empty table gives an empty result; other columns are not read.
    """
    prepare(df.sparkSession)
    texts = numbered(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, part, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                runs, kept = _cut(raw, marks, part << SHIFT)
                rows.append((key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*rows)) or [()] * 6
            columns[5] = [[{"start": b, "end": e} for b, e in runs] for runs in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    known = texts.join(covers(texts), "doc", "left").select("doc", "part", "t", "covers")
    loose = df.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("part"), F.col(text_col).alias("t"), F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("covers"))
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    out = known.mapInArrow(cut, schema).unionByName(loose.mapInArrow(cut, schema))
    return out.withColumnRenamed("doc", id_col).withColumn(id_col, F.col(id_col).cast(df.schema[id_col].dataType))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select doc_id, k, substr(x, 2 * k + 1, {2 * WINDOW}) as s from (select doc_id, x, unnest(range(0, n - {WINDOW - 1})) as k from d where n >= {WINDOW})),
r as (select doc_id, k from (select doc_id, k, row_number() over (partition by s order by doc_id, k) as i from w) where i > 1),
g as (select doc_id, k, case when k <= lag(k) over (partition by doc_id order by k) + {WINDOW} then 0 else 1 end as new from r),
h as (select doc_id, k, sum(new) over (partition by doc_id order by k) as run from g),
m as (select doc_id, run, min(k) as b, max(k) + {WINDOW} as e from h group by 1, 2),
a as (select doc_id, count(*) as c, sum(e - b) as n, list(b order by b) as b, list(e order by b) as e from m group by 1),
t as (select d.doc_id, n_all, c, nr, case when c is null then x else (select string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) from (select unnest(list_prepend(0, e)) as lo, unnest(list_append(b, n_all)) as hi)) end as kept
      from (select doc_id, x, n as n_all from d) d left join (select doc_id, c, n as nr, b, e from a) a using (doc_id))
select doc_id, n_all as n_bytes, coalesce(nr, 0)::bigint as n_removed, coalesce(c, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from t"""
