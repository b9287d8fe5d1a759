"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans, which always stay. The field adds spans that they miss: numbers
in other writings and addresses with the signs spelt out. It works on regions, runs of text that
may hold such data, cut into tokens. A spelt-out sign with its spaces, the name before an at sign and
each label after it are one token. A candidate segment is up to LONGEST tokens with a type, or up to
ADDRESS_LONGEST from such a name; its features look at the whole span and what stands before and
after it. Dynamic programming over segments and types chooses boundaries and types of a region
jointly, at a cost of tokens * LONGEST at most, and ADDRESS_LONGEST for each name.

Weights are trained on the driver by conditional log-likelihood over labelled regions made by rule
from a fixed seed (SAMPLES of them, a documented bound) and sent with the task.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

KINDS = ["email", "ip", "card", "phone"]
#: Tokens in a segment at most, but for spelt-out addresses.
LONGEST = 20
#: Tokens in a spelt-out address at most: a domain has 253 characters, so 127 labels, at most.
ADDRESS_LONGEST = 2 + 2 * 127 - 1
#: Digits of a number, least and most: a quad's least, and more than a card or a phone has.
DIGITS = (4, 24)
#: Edges whose segments are scored together.
STARTS = 64
SAMPLES = 360
EPOCHS = 6

# Repetitions are possessive and begin where a run begins, so that no text is scanned twice: a match
# can begin nowhere else, as the run before it would be part of it or of the match before.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. A local part is the run of its characters that ends at
    the sign, so each sign needs one look back and one match: no rescanning."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        number = digits_of(m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# Regions: numbers with separators, and words around a spelt-out at sign.
NUMERIC = re.compile(r"[0-9][0-9()./\x20-]{6,}[0-9]")
#: What follows the name in a spelt-out address.
SPELT = re.compile(r"\x20?+[(\[{](?:at|AT)[)\]}]\x20?+[A-Za-z0-9-]++(?:\x20?+(?:[(\[{](?:dot|DOT)[)\]}]|\.)\x20?+[A-Za-z0-9-]++)+")
SIGN = re.compile(r"[(\[{](?:at|AT)[)\]}]")
#: A label, or what stands between two.
PART = re.compile(r"\x20?(?:[(\[{](?:dot|DOT)[)\]}]|\.)\x20?|[A-Za-z0-9-]+")
MORE = re.compile(r"\s?[(\[{](?:dot|DOT)[)\]}]\s?[A-Za-z0-9-]|\.[A-Za-z0-9-]")
STOP = re.compile(r"\.\s")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "mastercard", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax", "telefon")}
HINT = {w: k for k, ws in HINTS.items() for w in ws}
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+\s?[(\[{](?:at|AT)[)\]}]\s?[A-Za-z0-9-]+(?:\s?(?:[(\[{](?:dot|DOT)[)\]}]|\.)\s?[A-Za-z0-9-]+)*\s?(?:[(\[{](?:dot|DOT)[)\]}]|\.)\s?[A-Za-z]{2,}")
AREA = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?\(0?[0-9]{2,4}\)[ ]?[0-9]{3,4}([ .-][0-9]{2,4}){1,3}")
GROUPED = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}")
#: What parts numbers of a quad, written as one or apart.
QUAD = re.compile(r"\x20?\.\x20?")
FEATURES = ["bias", "length", "spelt", "area", "grouped", "date", "digits7_9", "digits10_12", "digits13", "digits14_19", "luhn14_19", "digits20", "one_run", "four_parts", "parts_255", "parts_more", "slash", "joined_left", "joined_right", "space_edge", "letters", "hint_email", "hint_ip", "hint_card", "hint_phone", "few_digits", "fours", "more_labels", "stop_inside"]
DATE = re.compile(r"(?:19|20)[0-9]{2}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:19|20)?[0-9]{2}")


def spelt(text: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, start of what follows the name, end) of spelt-out addresses, leftmost first. Like
    emails(): each sign needs one look back and one match."""
    done = begin
    for sign in SIGN.finditer(text, begin, end):
        at = sign.start() - (sign.start() > done and text[sign.start() - 1] == " ")
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        found = SPELT.match(text, at, end) if first < at else None
        if found:
            yield first, at, found.end()
            done = found.end()


def regions(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMERIC.finditer(text):
        begin = m.start()
        while begin and text[begin - 1] in "+(":
            begin -= 1
        if sum(c.isdigit() for c in m[0]) >= 7:
            yield begin, m.end()
    for begin, _, end in spelt(text, 0, len(text)):
        yield begin, end


def features(text: str, begin: int, end: int, hint: str) -> list[float]:
    """What a segment looks like as a whole, in its place."""
    span = text[begin:end]
    digits = digits_of(span)
    n = len(digits)
    parts = QUAD.split(span)
    before, after = text[begin - 1 : begin], text[end : end + 1]
    return [
        1.0,
        (end - begin) / 20,
        float(bool(ADDRESS.fullmatch(span))),
        float(bool(AREA.fullmatch(span))),
        float(bool(GROUPED.fullmatch(span))),
        float(bool(DATE.fullmatch(span))),
        float(7 <= n <= 9),
        float(10 <= n <= 12),
        float(n == 13),
        float(14 <= n <= 19),
        float(14 <= n <= 19 and luhn(digits)),
        float(n >= 20),
        float(span.isdigit()),
        float(len(parts) == 4 and all(p.isdigit() for p in parts)),
        float(len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(len(parts) > 4),
        float("/" in span),
        float(before.isalnum() or before in ".-+/" and before != ""),
        float(after.isalnum() or after in "-/" and after != ""),
        float(span[:1].isspace() or span[-1:].isspace()),
        float(any(c.isalpha() for c in span)),
        *(float(hint == k) for k in KINDS),
        float(n < 7),
        float(bool(re.fullmatch(r"[0-9]{4}(?:[ .][0-9]{4}){2}[ .][0-9]{1,7}", span))),
        float(bool(MORE.match(text, end))),
        float(bool(STOP.search(span))),
    ]


def tokens(text: str, begin: int, end: int) -> tuple[list[int], set[int]]:
    """Token edges of a region, and the numbers of the tokens that are names before an at sign."""
    edges, names, done = [], set(), begin
    for first, at, last in spelt(text, begin, end):
        after = SIGN.search(text, at).end()
        after += text[after] == " "
        edges += [x.start() for x in TOKEN.finditer(text, done, first)]
        names.add(len(edges))
        edges += [first, at, *(x.start() for x in PART.finditer(text, after, last))]
        done = last
    return [*edges, *(x.start() for x in TOKEN.finditer(text, done, end)), end], names


class Candidates:
    """Which segments of a region may be entities: such as begin with a digit, plus or bracket and end
    with a digit and have DIGITS digits, and such as begin with the name of a spelt-out address."""

    def __init__(self, text: str, edges: list[int], names: set[int]) -> None:
        self.n, self.names = len(edges) - 1, names
        tokens = [text[a:b] for a, b in zip(edges, edges[1:])]
        self.begins = [k in names or t[0] in "0123456789+(" for k, t in enumerate(tokens)]
        self.ends = [False, *(t[-1].isalnum() for t in tokens)]
        self.digits = [0, *accumulate(len(digits_of(t)) for t in tokens)]

    def of(self, i: int) -> list[int]:
        """The last edges of the segments from edge i."""
        if not self.begins[i]:
            return []
        if i in self.names:
            return [j for j in range(i + 1, min(self.n, i + ADDRESS_LONGEST) + 1) if self.ends[j]]
        least, most = DIGITS[0] + self.digits[i], DIGITS[1] + self.digits[i]
        return [j for j in range(i + 1, min(self.n, i + LONGEST) + 1) if self.ends[j] and least <= self.digits[j] <= most]


def hint_before(text: str, begin: int) -> str:
    words = re.findall(r"[a-z]+", text[max(0, begin - 24) : begin].lower())[-2:]
    return next((HINT[w] for w in reversed(words) if w in HINT), "")


def lattice(text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Token edges of a region, all segments (from edge, to edge) and their features. Single tokens
    that can't be entities have no features (all 0)."""
    edges, names = tokens(text, begin, end)
    hint, candidates = hint_before(text, begin), Candidates(text, edges, names)
    segments, values = [], []
    for i in range(candidates.n):
        ends = candidates.of(i)
        for j in sorted({i + 1, *ends}):
            segments.append((i, j))
            values.append(features(text, edges[i], edges[j], hint) if j in ends else [0.0] * len(FEATURES))
    return edges, segments, np.array(values)


#: Types: 0 is none, for single tokens only.
TYPES = 1 + len(KINDS)


def scores(segments: list[tuple[int, int]], values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = values @ weights.T
    out[:, 0] = np.where(np.array([j - i for i, j in segments]) == 1, 0.0, -np.inf)
    out[values[:, 0] == 0, 1:] = -np.inf
    return out


def best(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, int]]:
    """The segmentation with the highest sum: (from edge, to edge, type)."""
    total, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    order = sorted(range(len(segments)), key=lambda k: segments[k][1])
    kinds, tops = score.argmax(1), score.max(1)
    for k in order:
        i, j = segments[k]
        if total[i] + tops[k] > total[j]:
            total[j], back[j] = total[i] + tops[k], (i, j, int(kinds[k]))
    out, j = [], n
    while j:
        out.append(back[j])
        j = back[j][0]
    return out[::-1]


def decoded(text: str, begin: int, end: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """What best() finds in a region, as (start, kind's number, end). Features are made for the
    segments from STARTS edges at a time, so a region may be of any length."""
    edges, names = tokens(text, begin, end)
    hint, candidates = hint_before(text, begin), Candidates(text, edges, names)
    n = candidates.n
    total, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
    for first in range(0, n, STARTS):
        segments = [(i, j) for i in range(first, min(n, first + STARTS)) for j in candidates.of(i)]
        at = 0
        if segments:
            score = np.array([features(text, edges[i], edges[j], hint) for i, j in segments]) @ weights[1:].T
            kinds, tops = score.argmax(1).tolist(), score.max(1).tolist()
        for i in range(first, min(n, first + STARTS)):
            if total[i] > total[i + 1]:  # the token is nothing
                total[i + 1], back[i + 1] = total[i], (i, 0)
            while at < len(segments) and segments[at][0] == i:
                j, top = segments[at][1], tops[at]
                if total[i] + top > total[j]:
                    total[j], back[j] = total[i] + top, (i, kinds[at] + 1)
                at += 1
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind:
            out.append((edges[i], kind - 1, edges[j]))
        j = i
    return out[::-1]


def expected(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Posterior probability of each segment with each type, by the forward-backward sums."""
    weight = np.logaddexp.reduce(score, 1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    for k in sorted(range(len(segments)), key=lambda k: segments[k][1]):
        i, j = segments[k]
        forward[j] = np.logaddexp(forward[j], forward[i] + weight[k])
    for k in sorted(range(len(segments)), key=lambda k: -segments[k][0]):
        i, j = segments[k]
        backward[i] = np.logaddexp(backward[i], backward[j] + weight[k])
    i, j = np.array(segments).T
    return np.exp(forward[i][:, None] + score + backward[j][:, None] - forward[n])


def samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """Labelled regions: (text, region's begin and end, [(start, end, type)])."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "ther", "lo", "mi", "ke", "son", "ra", "vel"]) for _ in range(r.randint(1, 3)))

    def card() -> str:
        body = d(15)
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return r.choice([number, ".".join(number[k : k + 4] for k in range(0, 16, 4)), "/".join(number[k : k + 4] for k in range(0, 16, 4))])

    def phone() -> str:
        s = r.choice(" .-")
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"(0{d(3)}) {d(3)} {d(4)}", f"1{s}{d(3)}{s}{d(3)}{s}{d(4)}"])

    def address() -> str:
        o, c = r.choice(["()", "[]", "{}"])
        s, labels = r.choice([" ", " ", ""]), [word() for _ in range(r.choice([1, 1, 2, 3]))]
        return ".".join(word() for _ in range(r.randint(1, 3))) + f"{s}{o}at{c}{s}" + f"{s}{o}dot{c}{s}".join([*labels, r.choice(["com", "org", "net", "de"])])

    def quad() -> str:
        return r.choice([" . ", ". ", " ."]).join(str(r.randint(0, 255)) for _ in range(4))

    plain = [lambda: " . ".join(d(r.randint(1, 3)) for _ in range(r.choice([3, 5, 6]))), lambda: ". ".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: d(r.randint(8, 13)), lambda: f"{d(1)}.{d(3)}.{d(3)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(5)}-{d(3)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: d(r.choice([14, 15, 16, 20, 24])), lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"]
    makers = [(address, 1), (quad, 2), (card, 3), (phone, 4)]
    out = []
    for _ in range(n):
        maker, kind = r.choice(makers) if r.random() < 0.55 else (r.choice(plain), 0)
        lead = f"{word()} {r.choice([word(), r.choice(HINTS[KINDS[kind - 1]])]) if kind else word()} "
        text, labels = lead, []
        entity = maker()
        if kind:
            labels.append((len(text), len(text) + len(entity), kind))
        text += entity
        if r.random() < 0.2 and kind != 1:
            text += f" {d(r.randint(1, 3))}"
        if r.random() < 0.2 and kind == 1:
            text += f". {word()}"
        out.append((text + f" {word()}", len(lead), len(text), labels))
    return out


@lru_cache
def trained() -> np.ndarray:
    """Weights [type, feature], by stochastic gradient over the samples' conditional likelihood."""
    weights, data = np.zeros((TYPES, len(FEATURES))), []
    weights[1:, 0] = -2
    for text, begin, end, labels in samples():
        edges, segments, values = lattice(text, begin, end)
        gold, place = np.zeros((len(segments), TYPES)), {s: k for k, s in enumerate(segments)}
        covered = set()
        for s, e, kind in labels:
            i, j = edges.index(s), edges.index(e)
            if (i, j) in place:
                gold[place[i, j], kind] = 1
                covered.update(range(i, j))
        for i in range(len(edges) - 1):
            if i not in covered:
                gold[place[i, i + 1], 0] = 1
        data.append((len(edges) - 1, segments, values, gold))
    r = random.Random(5)
    for epoch in range(EPOCHS):
        r.shuffle(data)
        for n, segments, values, gold in data:
            step = (gold - expected(n, segments, scores(segments, values, weights))).T @ values
            weights += 0.5 / (1 + epoch) * step - 1e-4 * weights
    return weights


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the field finds and that share no character with a base span."""
    out, taken = [], [(s, e) for s, _, e in base]
    for begin, end in regions(text):
        for a, b in _outside(begin, end, taken):
            out += decoded(text, a, b, weights)
    return sorted(set(out))


def _outside(begin: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for s, e in sorted(taken):
        if s < end and begin < e:
            if s > begin:
                out.append((begin, s))
            begin = max(begin, e)
    if begin < end:
        out.append((begin, end))
    return [(a, b) for a, b in out if b - a >= 7]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, n_email, n_ip, n_card, n_phone, base_sha256, n_added and spans.

    Spans are kind:start:end in code points, by start, then kind, end exclusive. A null text is an
    empty one; ids may be null; repeated rows are read each; an empty table gives an empty result;
    other columns are not read. Nothing is shuffled.
    """
    prepare(df.sparkSession)
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text or "")
                more = added_spans(text or "", base, weights)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), len(more), joined(sorted([*base, *more]))))
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, spans string")


def masked(text: str | None, weights: np.ndarray) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted([*base, *added_spans(text, base, weights)])
    out, done, k = [], 0, 0
    while k < len(spans):
        begin, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:begin], f"[{KINDS[kind].upper()}]"]
        done, k = end, k + 1
    return "".join([*out, text[done:]])


def mask(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with its texts masked and, where it has size_col, the sizes of the new texts there."""
    prepare(df.sparkSession)
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            old = batch.column(at).to_pylist()
            new = [masked(t, weights) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_col in batch.schema.names:
                k = batch.schema.get_field_index(size_col)
                sizes = [s if a == b else len(b) for s, a, b in zip(columns[k].to_pylist(), old, new)]
                columns[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), "doc_id", "text")
