"""Secret scans in DataFrame expressions only.

Fixed patterns find assignments, access keys and hex strings. Character Markov models add more: one
trained on samples labelled random, one on samples labelled ordinary identifiers; a long run of key
characters whose mean log-likelihood ratio is above THRESHOLD is a span of kind `markov`.

The two models come from training_samples(), a bounded labelled set made by rule from a fixed seed
(SAMPLES of each label); the table of log ratios is one array literal in the expression.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, least characters, group they are counted in). Runs are maximal, so a least
#: length inside the last two patterns drops just what a check afterwards would.
BASE = {"assign": (ASSIGN, 12, 2), "access": ("AKIA[A-Z0-9]{14,}", 18, 0), "hex": ("[0-9a-f]{16,}", 16, 0)}
KINDS = [*BASE, "markov"]
#: Runs that the models judge: key characters, of whatever kinds.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES = 4000
THRESHOLD = 0.5
BLOCK = 256
#: Parts of identifiers.
PARTS = """get set is has max min user name file path index count size list map node tree graph data base value key type
class method field table column row string number integer float double time date start end first last next prev parent child
request response server client http url page session cookie config option param error message status code handler manager
factory builder reader writer buffer stream parser token lexer module package import export version build test debug release
thread process worker queue stack event listener callback timeout retry cache memory disk network socket port address host
image color width height left right top bottom total average sum result input output source target query update delete insert
create remove find search sort filter group join split merge copy move open close read write load save send receive model
view control layer weight batch epoch train valid embed vector matrix tensor shape dimension feature label sample""".split()

#: Parts of long words.
WORD_PARTS = """inter nation al iz ation ment able ness ful less tion sion ity ing ed er est ly over under counter respons ib il character
ist ic pro fess or com muni cat ion re con struct ive dis ad vant age ous environ mental develop govern under stand work shop day light
ver ge be ent er zer auf aus ein un vor nach lich keit heit schaft ung en isch bar haft sam los stadt haus arbeit zeit gesell schafts
versicherung bund es recht land wirtschaft kraft fahr zeug donau dampf schiff fahrt kapit pf sch ach eit chen berg bach stein
eau eux aux elle ille ence ance ique isme iste oire eur euse ment aire ouv ent re des mal heureux que lle ou eurs
mente cion dad idad ando iendo ado ido os as es ar er ir able oso osa ista ismo para contra sobre entre des con""".split()


def training_samples(n: int = SAMPLES, seed: int = 7) -> tuple[list[str], list[str]]:
    """n random strings and n ordinary identifiers, words and rulers, the labelled samples."""
    r = random.Random(seed)
    sets = ["0123456789abcdef", SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[26:62], SYMBOLS[:26] + "0123456789", SYMBOLS, SYMBOLS[:52], SYMBOLS[:26], SYMBOLS[26:52]]
    noise = ["".join(r.choice(sets[k % len(sets)]) for _ in range(r.randint(20, 64))) for k in range(n)]
    names = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.04:  # rulers
            names.append(r.choice(SYMBOLS) * r.randint(20, 64))
            continue
        if kind < 0.3:  # long words
            long = "".join(r.choice(WORD_PARTS) for _ in range(r.randint(5, 9)))
            names.append(r.choice([long, long, long.capitalize(), long.upper()]))
            continue
        parts = [r.choice(PARTS) for _ in range(r.randint(3, 7))]
        if r.random() < 0.4:
            parts[r.randrange(1, len(parts))] = str(r.choice([1, 2, 3, 10, 64, 100, 2024, 2020, r.randint(0, 9999)]))
        style = r.randrange(6)
        joined = ["_".join(parts), "-".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "".join(p.capitalize() for p in parts), "/".join(parts), "_".join(parts).upper()][style]
        names.append(joined)
    return noise, names


def fit(noise: Iterable[str], names: Iterable[str]) -> list[float]:
    """log P(next | this) under the first model less that under the second, row by row over SYMBOLS."""
    m = len(SYMBOLS)
    place = {c: k for k, c in enumerate(SYMBOLS)}
    tables = []
    for samples in (noise, names):
        counts = [[0.3] * m for _ in range(m)]
        for s in samples:
            for a, b in zip(s, s[1:]):
                counts[place[a]][place[b]] += 1
        tables.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [round(x - y, 6) for a, b in zip(*tables) for x, y in zip(a, b)]


def ratio(text: str, ratios: list[float]) -> float:
    """Mean log-likelihood ratio of a run; what the expression below computes."""
    m = len(SYMBOLS)
    return sum(ratios[SYMBOLS.index(a) * m + SYMBOLS.index(b)] for a, b in zip(text, text[1:])) / (len(text) - 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _spans(text: Column, pattern: str, rank: int, fails) -> Column:
    """Leftmost non-overlapping matches as sorted structs (s, rank, e), less those that fail.

    split() and regexp_extract_all() walk the same matches, so gap k stands before match k and the
    places are running sums. Sums go by blocks of BLOCK, so many matches cost n * sqrt(n) at most.
    """

    def placed(gaps: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda x, k: F.length(x) + F.length(F.get(gaps, k)))

        def by_block(z: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / BLOCK).cast("int")), lambda b: _total(F.slice(z, b * BLOCK + 1, F.lit(BLOCK))))
            return let(sums, lambda q: let(F.transform(q, lambda x, b: _total(F.slice(q, F.lit(1), b))), lambda before: F.transform(found, lambda x, k: one(x, k, z, before))))

        def one(x: Column, k: Column, z: Column, before: Column) -> Column:
            b = F.floor(k / BLOCK).cast("int")
            end = F.get(before, b) + _total(F.slice(z, b * BLOCK + 1, k - b * BLOCK + 1))
            return F.struct((end - F.length(x)).alias("s"), F.lit(rank).alias("rank"), end.alias("e"), fails(x).alias("f"))

        return F.filter(let(sizes, by_block), lambda x: ~x["f"])

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(F.split(text, pattern, -1), lambda gaps: let(every, lambda found: placed(gaps, found)))
    kind = "array<struct<s:int,rank:int,e:int>>"
    kept = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array()).cast(kind)


def _random(run: Column, ratios: Column, codes: Column) -> Column:
    def mean(chars: Column) -> Column:
        at = lambda k: F.get(codes, F.ascii(F.get(chars, k)))
        steps = F.aggregate(F.sequence(F.lit(0), F.size(chars) - 2), F.lit(0.0), lambda a, k: a + F.get(ratios, at(k) * len(SYMBOLS) + at(k + 1)))
        return steps / (F.size(chars) - 1)

    return let(F.split(run, "", -1), lambda c: mean(F.filter(c, lambda x: x != "")))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, n_assign, n_access, n_hex, base_sha256, n_markov and spans (kind:start:end
    by start, then kind, in code points, end exclusive).

    A null text is an empty one; ids may be null; repeated rows are scanned each; an empty table
    gives an empty result; other columns are not read. Nothing is shuffled.
    """
    codes = [0] * 128
    for k, c in enumerate(SYMBOLS):
        codes[ord(c)] = k
    literal = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    ratios, codes = literal(fit(*training_samples()), "double"), literal(codes, "int")
    text = F.col("__t")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    for rank, (kind, (pattern, least, group)) in enumerate(BASE.items()):
        fails = (lambda x, p=pattern, n=least, g=group: F.length(F.regexp_extract(x, p, g)) < n) if group else (lambda x: F.lit(False))
        rows = rows.withColumn(f"__{kind}", _spans(text, pattern, rank, fails))
    ordinary = lambda x: _random(x, ratios, codes) <= threshold
    rows = rows.withColumn("__markov", _spans(text, CANDIDATE, len(BASE), ordinary))
    rows = rows.withColumn("__base", F.sort_array(F.concat(*(F.col(f"__{k}") for k in BASE))))
    return rows.select(
        id_col,
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_text(F.col("__base")), 256).alias("base_sha256"),
        _text(F.sort_array(F.concat("__base", "__markov"))).alias("spans"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")
