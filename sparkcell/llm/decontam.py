"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The index holds the test items. Its size is checked: items go to the tasks in blocks whose index is
at most INDEX_BYTES, one pass over the documents for each block, so a benchmark of any size works.
Numbers of items, their mean and greatest lengths and the words' document frequencies are counted
once over all items, so scores, passages and what is retrieved do not depend on the blocks.
Postings carry impacts: an item's BM25 share for a term, over the item's own threshold (RATIO of
its score against itself), so that every item is retrieved at 1. Items are ordered by threshold,
and postings keep the largest impact of each block of BLOCK items.

Each document is cut into passages of 2 * stride words at steps of `stride`, the longest item's
words, so that every item would lie whole in one passage. Every passage is a query. Sums of block
maxima over half passages, for all passages of a batch at once, show which passages may reach 1
anywhere; block-max WAND runs those and returns all items at 1 or above. A retrieved item counts if
its question's and its answer's shingles both lie in the passage (CONTAINED of each).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored, table
from .neardup import _BACK, _BASE, _BYTE, _power, mixed

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
RATIO = 0.7
#: Share of the shingles of the question and of the answer.
CONTAINED = 0.8
SHINGLE = 5
#: Entries in a block of postings, and columns in the bounds of half passages at most.
BLOCK, BOUNDS = 8, 256
#: Terms whose postings a worker keeps as lists.
LISTS = 20_000
#: Words of an item that are one entry; a longer item is several entries.
ENTRY = 256
#: Bytes of one index, and what it needs for a word of an item (a posting, its share of block tops and
#: bounds, a shingle of its side) besides the text itself.
INDEX_BYTES, WORD_BYTES = 64 * 1024 * 1024, 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash) of each word: runs of letters, digits and non-ASCII, A-Z as a-z."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = _LETTER[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    begin, end = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * _power("down", _BACK, len(data))[begin] + (end - begin).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]])
    return np.searchsorted(first, begin, "right") - 1, hashes


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words."""
    if len(words) < n or not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(out))


def parts(text: str) -> tuple[str, str]:
    """An item's question and answer: cut after the last question mark, else after the last line
    break, else at two thirds of its words; an empty part stands for the whole."""
    text = text.strip()
    cut = text.rfind("?") + 1 or text.rfind("\n") + 1
    if not cut or cut == len(text):
        pieces = text.split()
        cut = len(" ".join(pieces[: max(1, 2 * len(pieces) // 3)]))
    question, answer = text[:cut].strip(), text[cut:].strip()
    return question or text, answer or text


def entries(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, words) of each entry of at most ENTRY words."""
    owner, words = words_of(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        for a in range(cut[k], cut[k + 1], ENTRY):
            yield k, words[a : min(a + ENTRY, cut[k + 1])]


@dataclass(frozen=True)
class Totals:
    """Of all items: entries, their words, the longest entry's and the longest item's words, and
    in how many entries a term is (of the terms that an index needs)."""

    n: int
    words: int
    stride: int
    longest: int
    found: dict[int, int]


def totals(texts: list[str | None]) -> Totals:
    """Totals of a list of items' texts."""
    n, words, stride, sizes, found = 0, 0, 1, Counter(), Counter()
    for k, w in entries(texts):
        n, words, stride = n + 1, words + len(w), max(stride, len(w))
        sizes[k] += len(w)
        found.update(np.unique(w).tolist())
    return Totals(n, words, stride, max(sizes.values(), default=0), dict(found))


class Index:
    """Test items for block-max WAND; all numbers are in arrays."""

    def __init__(self, items: list[tuple[int, str]], of: Totals | None = None) -> None:
        of = of or totals([t for _, t in items])
        lists = [(items[k][0], w) for k, w in entries([t for _, t in items])]
        self.checks = {}
        for item, text in items:
            sides = [words_of([p])[1] for p in parts(text or "")]
            runs = [(n, shingles(w, n)) for w in sides if (n := min(SHINGLE, len(w)))]  # a side of fewer words is one run
            self.checks.setdefault(item, []).append(runs)
        self.longest, self.stride = of.longest, of.stride
        mean = of.words / max(1, of.n)
        counts = [np.unique(w, return_counts=True) for _, w in lists]
        shares = []
        for terms, tf in counts:
            df = np.array([of.found[t] for t in terms.tolist()])
            shares.append(np.log1p((of.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean)))
        goal = [RATIO * float(s.sum()) for s in shares]
        common = [sorted((-of.found[t], t) for t in terms.tolist())[:4] for terms, _ in counts]
        order = sorted(range(len(lists)), key=lambda k: (common[k], goal[k], k))
        self.items = [lists[k][0] for k in order]
        words = np.concatenate([counts[k][0] for k in order]) if order else np.zeros(0, np.uint64)
        impact = np.concatenate([shares[k] / goal[k] for k in order]) if order else np.zeros(0)
        entry = np.repeat(np.arange(len(order)), [len(counts[k][0]) for k in order]).astype(np.int64)
        self.vocabulary, term = np.unique(words, return_inverse=True)
        by_term = np.lexsort((entry, term))
        term, self.entry, self.impact = term[by_term], entry[by_term], impact[by_term]
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        wide = max(1, -(-len(order) // BOUNDS))
        self.columns = max(1, -(-len(order) // wide))
        # The largest impact of a term in each block of entries, and in each column of the bounds.
        self.block, self.block_first, self.block_top = self._tops(term, self.entry // BLOCK)
        self.bound, self.bound_first, self.bound_top = self._tops(term, self.entry // wide)
        self.lists: dict[int, tuple] = {}

    def _tops(self, term: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts in which a term occurs, term by term; each term's first; the largest impacts there."""
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])])) if len(term) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(self.impact, new) if len(new) else np.zeros(0)
        return part[new], np.searchsorted(term[new], np.arange(len(self.vocabulary) + 1)), tops

    def __getstate__(self) -> dict:
        return {**self.__dict__, "lists": {}}

    def posting(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """Entries, impacts, blocks' largest impacts and the largest of all, of a term; lists of the
        terms asked for last are kept."""
        found = self.lists.get(term)
        if found is None:
            if len(self.lists) >= LISTS:
                self.lists.clear()
            a, b, c, d = self.first[term], self.first[term + 1], self.block_first[term], self.block_first[term + 1]
            found = self.lists[term] = (self.entry[a:b].tolist(), self.impact[a:b].tolist(), dict(zip(self.block[c:d].tolist(), self.block_top[c:d].tolist())), float(self.block_top[c:d].max()))
        return found

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, or its size for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def search(self, terms: list[int], least: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
        """(entry, score over its goal) of all entries at or above `least`, by block-max WAND."""
        cursors = [[p[0][0], 0, p] for p in map(self.posting, terms)]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2][3]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            block = entry // BLOCK
            if sum(c[2][2].get(block, 0.0) for c in cursors[: pivot + 1]) >= least:
                if cursors[0][0] == entry:
                    score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= least:
                        out.append((entry, score))
                    goal = entry + 1
                else:
                    goal = entry
            else:  # no entry of this block can pass by these terms; others may join at the next one
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, entry + 1)
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < goal:
                    entries, at = c[2][0], c[1]
                    while at < len(entries) and entries[at] < goal:
                        at += 1
                    if at == len(entries):
                        continue
                    c[0], c[1] = entries[at], at
                alive.append(c)
            cursors = alive
        return out

    def verified(self, entry: int, words: np.ndarray) -> bool:
        have = {n: shingles(words, n) for runs in self.checks[self.items[entry]] for n, _ in runs}
        passes = lambda n, s: len(np.intersect1d(s, have[n], assume_unique=True)) >= CONTAINED * len(s)
        return any(runs and all(passes(n, s) for n, s in runs) for runs in self.checks[self.items[entry]])

    def leaks(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Of each text, item -> best score over its goal, for retrieved and verified items."""
        out: list[dict[int, float]] = [{} for _ in texts]
        owner, words = words_of(texts)
        if not len(words) or not self.items:
            return out
        terms = self.terms(words)
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        place = np.arange(len(words)) - begin[owner]
        half = place // self.stride
        per_text = np.maximum(1, -(-(begin[1:] - begin[:-1]) // self.stride))
        first_half = np.concatenate([[0], np.cumsum(per_text)])
        number = first_half[owner] + half
        known = np.flatnonzero(terms < len(self.vocabulary))
        pairs = np.unique(number[known] * (len(self.vocabulary) + 1) + terms[known])
        halves, ids = pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)
        sums = np.zeros((first_half[-1] + 1, self.columns), np.float32)
        if len(halves):
            starts = np.flatnonzero(np.concatenate([[True], halves[1:] != halves[:-1]]))
            step = 1 << 11
            for a in range(0, len(starts), step):  # bounds are gathered for some halves at a time
                lo, hi = starts[a], starts[a + step] if a + step < len(starts) else len(ids)
                begin_at, n = self.bound_first[ids[lo:hi]], self.bound_first[ids[lo:hi] + 1] - self.bound_first[ids[lo:hi]]
                at = np.repeat(begin_at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                base = halves[lo]
                flat = np.repeat(halves[lo:hi] - base, n) * self.columns + self.bound[at]
                rows = int(halves[hi - 1] - base + 1)
                sums[base : base + rows] += np.bincount(flat, self.bound_top[at], rows * self.columns).reshape(rows, -1)
        last = np.zeros(len(sums), bool)
        last[first_half[1:] - 1] = True
        joint = sums[:-1] + np.where(last[:-1, None], 0, sums[1:])
        for h in np.flatnonzero((joint >= 1 - 1e-3).any(1)).tolist():
            text = int(np.searchsorted(first_half, h, "right") - 1)
            a = begin[text] + (h - first_half[text]) * self.stride
            passage = slice(int(a), int(min(a + 2 * self.stride, begin[text + 1])))
            query = np.unique(terms[passage])
            for entry, score in self.search(query[query < len(self.vocabulary)].tolist()):
                item = self.items[entry]
                if score > out[text].get(item, 0.0) and (item in out[text] or self.verified(entry, words[self._around(passage, begin, text)])):
                    out[text][item] = score
        return out

    def _around(self, passage: slice, begin: np.ndarray, text: int) -> slice:
        """The words in which a retrieved item is looked for: an item of several entries may run on."""
        if self.longest <= self.stride:
            return passage
        return slice(max(int(begin[text]), passage.start - self.longest), min(int(begin[text + 1]), passage.stop + self.longest))


def blocks(items: DataFrame, id_col: str, text_col: str, size: int | None = None) -> Iterator[Index]:
    """Indexes of at most `size` bytes, or of one longer item; the driver holds one at a time."""
    size = size or INDEX_BYTES
    items = items.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("t"))

    def lists() -> Iterator[list[tuple[int, str]]]:
        held, n = [], 0
        for key, text in items.orderBy("item", "t").toLocalIterator():
            length = len(text.encode()) + WORD_BYTES * len(words_of([text])[1])
            if held and n + length > size:
                yield held
                held, n = [], 0
            held.append((key, text))
            n += length
        if held:
            yield held

    some = lists()
    first, second = next(some, None), next(some, None)
    if first is None:
        return
    if second is None:
        yield Index(first)
        return
    known = counted(items)
    for block in chain([first, second], some):
        yield Index(block, known([t for _, t in block]))


def counted(items: DataFrame):
    """Totals over all items (item, t), counted by Spark; the result gives them with the frequencies
    of the terms of some texts."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = Counter()
            for k, w in entries(texts):
                sizes[k] += len(w)
            for k, w in entries(texts):
                unique = np.unique(w)
                n = np.full(len(unique), len(w))
                lead = np.zeros(len(unique), np.int64)  # one row of each entry carries its size
                lead[:1] = 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unique.view(np.int64), lead, n.astype(np.int64), np.full(len(unique), sizes[k]))], ["term", "lead", "n", "longest"])

    rows = stored(items.select("t").mapInArrow(terms, "term long, lead long, n long, longest long"), "item-terms")
    n, words, stride, longest = rows.agg(F.sum("lead"), F.sum(F.col("lead") * F.col("n")), F.max("n"), F.max("longest")).first()
    frequency = stored(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-frequencies")

    def of(texts: list[str]) -> Totals:
        needed = np.unique(words_of(texts)[1]).view(np.int64)  # bounded by the block
        asked = items.sparkSession.createDataFrame(pd.DataFrame({"term": needed}))
        found = {t & (1 << 64) - 1: df for t, df in frequency.join(asked, "term", "left_semi").collect()}
        return Totals(n or 0, words or 0, stride or 1, longest or 0, found)

    return of


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: the id, leaked (sorted ids of the items found), top_score, contaminated, kept.

    Null and empty texts, items without words and items with a null id leak nothing; repeated rows
    are judged each; items that share an id are one; an empty benchmark leaves every row clean; an
    empty table gives an empty result; other columns are not read. Documents are not shuffled, but
    for joining blocks when the benchmark needs more than one.
    """
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col)
    schema = f"`{id_col}` {kind}, leaked array<long>, top_score double, place long"
    run = lambda index: rows.mapInArrow(_leaks(index, id_col), schema)
    lists = blocks(items, item_id, item_text)
    found, more = run(next(lists, Index([]))), next(lists, None)
    if more is not None:  # a row's place is its task's number, so each pass is stored by itself
        passes = [stored(found, "leaks"), stored(run(more), "leaks"), *(stored(run(b), "leaks") for b in lists)]
        found = reduce(DataFrame.unionByName, passes).groupBy(id_col, "place")
        found = found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaked")))).alias("leaked"), F.max("top_score").alias("top_score"))
    return found.select(id_col, "leaked", "top_score", (F.size("leaked") > 0).alias("contaminated"), (F.size("leaked") == 0).alias("kept"))


def _leaks(index: Index, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            leaks = index.leaks(batch.column(1).to_pylist())
            places = range(place, place + batch.num_rows)
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(x) for x in leaks], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for x in leaks], pa.float64()), pa.array(places, pa.int64())], [id_col, "leaked", "top_score", "place"])

    return run


def keep(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df that hold no item, with df's columns; one pass for each block of items."""
    prepare(df.sparkSession)
    for index in blocks(items, item_id, item_text):
        df = df.mapInArrow(_clean(index, text_col), df.schema)
    return df


def _clean(index: Index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = index.leaks(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array([not x for x in leaks], pa.bool_()))

    return run


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
