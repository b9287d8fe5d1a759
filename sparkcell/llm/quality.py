"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good (1) or bad (-1) on a document's statistics, or abstains (0). The rules' votes
are counted by pattern: at most 3 ** len(RULES) rows, however large the corpus. Expectation
maximisation over these counts estimates each rule's two accuracies, how often it says "bad" of bad
documents (CAUGHT) and of good ones (WRONG), and the share of good documents. No estimate is bounded:
the first values alone say which class is "good", and a few pseudo-votes (PRIOR) keep rates off 0 and
1. Several rules look at each kind of junk, as one rule that no other agrees with is estimated to be
noise. A document is kept if its posterior probability of being good is at least 0.5, whatever a
single rule says: no rule has to pass by itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Statistics of a text; the first five and n_repeat_words are of the fixed definition.
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stops", "n_digits", "n_symbol_words", "n_upper", "n_exclaims"]
#: name -> (condition for good, condition for bad), in SQL that both engines read.
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("word_chars >= 3 * n_words and word_chars <= 11 * n_words", "2 * word_chars < 5 * n_words or word_chars > 15 * n_words"),
    "symbols": ("50 * n_symbols < n_words", "10 * n_symbols > n_words"),
    "lines": ("n_lines >= 3 and 20 * n_dup_lines < n_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("20 * n_repeat_words < n_words", "10 * n_repeat_words > 3 * n_words"),
    "variety": ("n_distinct * n_distinct > 16 * n_words", "n_distinct * n_distinct < 4 * n_words"),
    "sentences": ("100 * n_stops >= n_words and 10 * n_stops <= 3 * n_words", "n_words >= 30 and 200 * n_stops < n_words"),
    "digits": ("20 * n_digits < word_chars", "5 * n_digits > word_chars"),
    "symbol_words": ("50 * n_symbol_words < n_words", "5 * n_symbol_words > n_words"),
    "capitals": ("6 * n_upper < word_chars", "2 * n_upper > word_chars"),
    "exclaims": ("50 * n_exclaims < n_words", "5 * n_exclaims > n_words"),
}
ITERATIONS = 20
#: First value of the share of good documents, of P(bad vote | bad) and of P(bad vote | good).
SHARE, CAUGHT, WRONG = 0.8, 0.3, 0.02
#: Pseudo-counts of the three rates: (of the event, of all).
PRIOR = {"share": (4, 5), "caught": (1, 3), "wrong": (0.2, 10)}
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _size(a: Column) -> Column:
    return F.size(a).cast("long")


def _repeats(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs at least twice, from the hashes of all windows
    of 8 words in order. Sorted (hash, place) pairs bring equal windows together; the places that
    have an equal neighbour are put in order, and each covers 8 words or up to the next place."""

    def covered(pairs: Column) -> Column:
        twin = lambda p, k, d: F.coalesce(F.get(pairs, k + d)["h"] == p["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(pairs, lambda p, k: twin(p, k, -1) | twin(p, k, 1)), lambda p: p["k"]))
        return let(places, lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.coalesce(F.get(q, k + 1) - x, F.lit(8)), F.lit(8))), F.lit(0), lambda a, b: a + b))

    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered)).cast("long")


def with_stats(df: DataFrame, text_col: str) -> DataFrame:
    """df with a struct column __q of STATS. Null text: all 0. Every step is an expression of one
    row, so a document costs its own length (n log n) and nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w))).withColumn("__l", lines)
    n = F.size("__w")
    window = lambda k: F.xxhash64(*(F.get(F.col("__w"), k + i) for i in range(8)))
    hashes = F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__h", hashes)
    stats = {
        "n_words": _size(F.col("__w")),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": _size(F.col("__l")) - _size(F.array_distinct("__l")),
        "n_repeat_words": _repeats(F.col("__h")),
        "n_lines": _size(F.col("__l")),
        "n_distinct": _size(F.array_distinct("__w")),
        "n_stops": without(".!?"),
        "n_digits": without("0123456789"),
        "n_symbol_words": F.when(without(SYMBOLS) == 0, F.lit(0).cast("long")).otherwise(_size(F.filter(words, lambda w: F.translate(w, SYMBOLS, "") != w))),
        "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaims": without("!"),
    }
    return df.withColumn("__q", F.struct(*(c.alias(k) for k, c in stats.items()))).drop("__w", "__l", "__h")


def vote(name: str, prefix: str = "") -> str:
    """A rule's vote, in SQL."""
    good, bad = (reduce(lambda s, k: s.replace(k, prefix + k), sorted(STATS), c) for c in RULES[name])
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def _rate(event: float, total: float, name: str) -> float:
    """A rate with its pseudo-counts."""
    return (event + PRIOR[name][0]) / (total + PRIOR[name][1])


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[float], list[float]]:
    """The share of good documents and each rule's two accuracies, from counts of vote patterns."""
    m, total = len(RULES), sum(patterns.values())
    share, caught, wrong = SHARE, [CAUGHT] * m, [WRONG] * m
    for _ in range(ITERATIONS if total else 0):
        good, cast_bad, cast_good, said_bad, said_wrong = 0.0, [0.0] * m, [0.0] * m, [0.0] * m, [0.0] * m
        for votes, n in patterns.items():
            p = posterior(votes, share, caught, wrong)
            good += n * p
            for j, v in enumerate(votes):
                if v:
                    cast_bad[j] += n * (1 - p)
                    cast_good[j] += n * p
                if v < 0:
                    said_bad[j] += n * (1 - p)
                    said_wrong[j] += n * p
        share = _rate(good, total, "share")
        caught = [_rate(x, y, "caught") for x, y in zip(said_bad, cast_bad)]
        wrong = [_rate(x, y, "wrong") for x, y in zip(said_wrong, cast_good)]
    return share, caught, wrong


def weights(caught: float, wrong: float) -> tuple[float, float]:
    """What a bad and a good vote add to the log odds of a good document."""
    return math.log(wrong / caught), math.log((1 - wrong) / (1 - caught))


def posterior(votes: tuple[int, ...], share: float, caught: list[float], wrong: list[float]) -> float:
    odds = math.log(share / (1 - share)) + sum(weights(c, w)[v > 0] for v, c, w in zip(votes, caught, wrong) if v)
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def judged(df: DataFrame) -> DataFrame:
    """df, with its struct __q, and base_failed, p_good and kept. df is read twice: once to count
    vote patterns, once for the result; give it a stored table."""
    with_base = df.select("*", *(F.expr(vote(k, "__q.")).alias(f"__v{j}") for j, k in enumerate(RULES)))
    votes = [f"__v{j}" for j in range(len(RULES))]
    patterns = {tuple(r[:-1]): r[-1] for r in with_base.groupBy(*votes).count().collect()}
    share, caught, wrong = estimate(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for v, c, w in zip(votes, caught, wrong):
        bad, good = weights(c, w)
        odds = odds + F.when(F.col(v) < 0, bad).when(F.col(v) > 0, good).otherwise(0.0)
    failed = F.expr(reduce(lambda s, k: s.replace(k, f"__q.{k}"), ["n_words", "n_repeat_words"], BASE_FAILED))
    out = with_base.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*votes)


def score(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, STATS, base_failed, p_good, kept.

    Null and empty texts have 0 words and fail; repeated rows are judged each; ids may be null; an
    empty table gives an empty result; other columns are not read.
    """
    rows = with_stats(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t").select("id", "__q")
    return judged(stored(rows, "quality-stats")).select(F.col("id").alias(id_col), "__q.*", "base_failed", "p_good", "kept")


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's columns, whatever their names. Texts are read and
    judged once: rows and statistics are written to the shared folder, as the estimate needs all of
    them first. Rows are judged as score() says; an empty table stays empty."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").alias("t"))
    return judged(stored(with_stats(rows, "t").drop("t"), "quality-rows")).where("kept").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("p_good", F.round("p_good", 6))


def oracle() -> str:
    """DuckDB SQL for op2: the same statistics from words and lines as rows, and the same EM, one
    step after the other."""
    rules = list(enumerate(RULES))
    pick = "".join(f", {vote(k)} as v{j}" for j, k in rules)
    vs = ", ".join(f"v{j}" for j, _ in rules)
    first = "".join(f", {CAUGHT}::double as c{j}, {WRONG}::double as w{j}" for j, _ in rules)
    steps, at = [f"i0 as (select {SHARE}::double as pi{first})"], "i0"
    odds = "ln(pi / (1 - pi))" + "".join(f" + case v{j} when -1 then ln(w{j} / c{j}) when 1 then ln((1 - w{j}) / (1 - c{j})) else 0 end" for j, _ in rules)

    def part(weight: str, j: int, prior: str, name: str) -> str:
        event, total = PRIOR[prior]
        return f", (sum(case when v{j} = -1 then n * {weight} else 0 end) + {event}) / (sum(case when v{j} <> 0 then n * {weight} else 0 end) + {total}) as {name}{j}"

    for k in range(1, ITERATIONS + 1):
        rates = "".join(part("(1 - p)", j, "caught", "c") + part("p", j, "wrong", "w") for j, _ in rules)
        steps.append(f"i{k} as materialized (select (sum(n * p) + {PRIOR['share'][0]}) / (sum(n) + {PRIOR['share'][1]}) as pi{rates} from (select pat.*, 1 / (1 + exp(-({odds}))) as p from pat, {at}))")
        at = f"i{k}"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: translate(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '') <> '') as l from d),
g as (select doc_id, unnest(range(1, len(w) - 6)) as k, w from w where len(w) >= 8),
h as (select doc_id, k, array_to_string(w[k:k + 7], ' ') as s from g),
r as (select doc_id, k from h qualify count(*) over (partition by doc_id, s) > 1),
c as (select doc_id, sum(least(8, coalesce(nx - k, 8)))::bigint as n from (select doc_id, k, lead(k) over (partition by doc_id order by k) as nx from r) group by 1),
s as materialized (select doc_id, len(w)::bigint as n_words, length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::bigint as word_chars,
      (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
      len(l)::bigint as n_lines, len(list_distinct(w))::bigint as n_distinct, (length(t) - length(translate(t, '.!?', '')))::bigint as n_stops, (length(t) - length(translate(t, '0123456789', '')))::bigint as n_digits,
      len(list_filter(w, lambda x: translate(x, '{SYMBOLS}', '') <> x))::bigint as n_symbol_words, (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint as n_upper, (length(t) - length(replace(t, '!', '')))::bigint as n_exclaims
      from w left join c using (doc_id)),
v as materialized (select *{pick} from s),
pat as materialized (select {vs}, count(*) as n from v group by all),
{', '.join(steps)},
z as (select v.*, 1 / (1 + exp(-({odds}))) as p_good, {BASE_FAILED} as base_failed from v, {at})
select doc_id, {', '.join(STATS)}, base_failed, round(p_good, 6) as p_good, not base_failed and p_good >= 0.5 as kept from z"""
