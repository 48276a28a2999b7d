"""Name similarity, scored once per *distinct* pair.

``wratio`` and ``token_sort_ratio`` are Arrow functions over two text columns; a whole batch of
pairs is scored at once.  ``score_pairs`` applies them to the distinct pairs of a table and joins
the scores back.  ``similar_values`` finds, exactly, every pair of distinct values in a block whose
``wratio`` reaches a threshold -- through equi-joins on shared segments and on the rarest words,
never by comparing all values of a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.text import letters_only, words


# -- longest common subsequences of many pairs -------------------------------
#
# One bit for every letter of the first text, 64 to a word; each letter of the second text is one
# step for all pairs of a chunk.  A pair costs as much as its chunk's longest texts, so pairs are
# put into chunks by length.

#: Cells (pairs x letters of the first text) worked on at once: bounds a worker's memory.
CHUNK_CELLS = 1 << 21


def _codes(texts: Sequence[str], width: int, fill: int) -> np.ndarray:
    """A row of code points for every text, padded with ``fill`` (no code point)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), fill, np.int32)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _lcs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths for rows of codes, ``a`` padded to whole words of 64 letters (padding of the two never agrees)."""
    rows, words_ = len(a), a.shape[1] // 64
    left = np.full((rows, words_), ~np.uint64(0))
    for j in range(b.shape[1]):
        here = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little").view(np.uint64)
        hit = left & here
        total, carry = np.empty_like(left), np.zeros(rows, np.uint64)
        for w in range(words_):
            once = left[:, w] + hit[:, w]
            total[:, w] = once + carry
            carry = ((once < hit[:, w]) | (total[:, w] < once)).astype(np.uint64)
        left = total | (left - hit)
    return a.shape[1] * np.ones(rows, np.int64) - np.bitwise_count(left).sum(axis=1, dtype=np.int64)


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair."""
    out = np.zeros(len(a), np.int64)
    one, other = [x if len(x) <= len(y) else y for x, y in zip(a, b)], [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    short, long = np.fromiter(map(len, one), np.int64, len(a)), np.fromiter(map(len, other), np.int64, len(a))
    order = np.lexsort((long, short))
    order = order[short[order] > 0]
    at = 0
    while at < len(order):
        width = -(-int(short[order[at]]) // 64) * 64
        same = int(np.searchsorted(short[order], width, side="right"))
        part = order[at:min(same, at + max(1, CHUNK_CELLS // width))]
        out[part] = _lcs_of(_codes([one[i] for i in part], width, -1), _codes([other[i] for i in part], int(long[part].max()), -2))
        at += len(part)
    return out


def _share(twice: np.ndarray, total: np.ndarray) -> np.ndarray:
    """200 * lcs / letters; two empty texts are alike."""
    return np.where(total > 0, 200.0 * twice / np.maximum(total, 1), 100.0)


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    sizes = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    return _share(lcs_lengths(a, b), sizes)


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio of the shorter text with any window of the longer, ends included."""
    out, owner, left, right = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        if x and x in y or not y:
            out[i] = 100.0
        elif x:
            n, m = len(x), len(y)
            sides = [(x, y[max(0, k):k + n]) for k in range(1 - n, m)]
            if n == m:
                sides += [(y, x[max(0, k):k + n]) for k in range(1 - n, n)]
            sides = list(dict.fromkeys(sides))
            owner += [i] * len(sides)
            left += [p for p, _ in sides]
            right += [q for _, q in sides]
        if len(owner) > 100_000 or i == len(a) - 1 and owner:                  # windows of some pairs at once
            np.maximum.at(out, np.array(owner), ratios(left, right))
            owner, left, right = [], [], []
    if owner:
        np.maximum.at(out, np.array(owner), ratios(left, right))
    return out


def _sorted_words(texts: Sequence[str]) -> list[str]:
    return [" ".join(sorted(t.split())) for t in texts]


def token_sort_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return ratios(_sorted_words(a), _sorted_words(b))


def token_set_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Shared words against either text's words, and the rests against each other."""
    shared, rest_a, rest_b, full, none = np.zeros(len(a), np.int64), [], [], np.zeros(len(a), bool), np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b)):
        left, right = set(x.split()), set(y.split())
        both = left & right
        none[i], full[i] = not left or not right, bool(both) and (left <= right or right <= left)
        rest_a.append(" ".join(sorted(left - right)))
        rest_b.append(" ".join(sorted(right - left)))
        shared[i] = len(" ".join(sorted(both)))
    size_a, size_b = (np.fromiter(map(len, r), np.int64, len(r)) for r in (rest_a, rest_b))
    gap = (shared > 0).astype(np.int64)
    len_a, len_b = shared + gap + size_a, shared + gap + size_b
    apart = size_a + size_b - 2 * lcs_lengths(rest_a, rest_b)
    best = 100.0 - 100.0 * apart / np.maximum(len_a + len_b, 1)
    for size, total in ((size_a, len_a), (size_b, len_b)):
        best = np.where(gap > 0, np.maximum(best, 100.0 - 100.0 * (gap + size) / np.maximum(shared + total, 1)), best)
    return np.where(none, 0.0, np.where(full, 100.0, best))


def partial_token_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    out = np.full(len(a), 100.0)
    apart = [i for i, (x, y) in enumerate(zip(a, b)) if not set(x.split()) & set(y.split())]
    left, right = [a[i] for i in apart], [b[i] for i in apart]
    scores = partial_ratios(_sorted_words(left), _sorted_words(right))
    again = [k for k, (x, y) in enumerate(zip(left, right)) if len(set(x.split())) < len(x.split()) or len(set(y.split())) < len(y.split())]
    if again:                                                                  # repeated words count once in a second reading
        once = lambda side: [" ".join(sorted(set(side[k].split()))) for k in again]
        scores[again] = np.maximum(scores[again], partial_ratios(once(left), once(right)))
    out[apart] = scores
    return out


def weighted_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The weighted blend published with RapidFuzz/fuzzywuzzy (``WRatio``), 0-100."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    low, high = sizes.min(axis=1, initial=1 << 30), sizes.max(axis=1, initial=0)
    some = low > 0
    spread = high / np.maximum(low, 1)
    best = np.where(some, ratios(a, b), 0.0)
    for chosen, scale in ((some & (spread < 1.5), None), (some & (spread >= 1.5) & (spread <= 8.0), 0.9), (some & (spread > 8.0), 0.6)):
        at = np.flatnonzero(chosen)
        if not len(at):
            continue
        left, right = [a[i] for i in at], [b[i] for i in at]
        if scale is None:
            more = 0.95 * np.maximum(token_sort_ratios(left, right), token_set_ratios(left, right))
        else:
            more = np.maximum(scale * partial_ratios(left, right), 0.95 * scale * partial_token_ratios(left, right))
        best[at] = np.maximum(best[at], more)
    return best


def weighted_ratio(a: str, b: str) -> float:
    return float(weighted_ratios([a], [b])[0])


_SCORERS = {"wratio": weighted_ratios, "token_sort": token_sort_ratios, "ratio": ratios}


def _arrow_scorer(name: str):
    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series(_SCORERS[name](left.fillna("").tolist(), right.fillna("").tolist()), dtype="float64")

    return score


def wratio(a: Column, b: Column) -> Column:
    return _arrow_scorer("wratio")(a, b)


def plain_ratio(a: Column, b: Column) -> Column:
    return _arrow_scorer("ratio")(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _arrow_scorer("token_sort")(a, b)


def score_pairs(df: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """``df`` with the WRatio of two columns, each distinct pair scored once; equal texts never reach Python."""
    a, b = F.col(left), F.col(right)
    pairs = df.select(left, right).distinct()
    same = (a == b) & (a != "")
    scored = pairs.where(same).withColumn(out, F.lit(100.0)).unionByName(pairs.where(~F.coalesce(same, F.lit(False))).withColumn(out, wratio(a, b)))
    return df.join(scored, [left, right], "left")


# -- finding pairs without comparing everything ------------------------------
#
# Two texts whose ratio reaches t differ by at most (1-t)*(len1+len2) letters.
# Cut the shorter one into one segment more than that: at least one segment then
# occurs unchanged in the longer one, near its own position.  Segments and the
# substrings they can meet become join keys.

def _longest(n: Column, t: float) -> Column:
    return F.floor(n * (2.0 / t - 1.0) + 1e-9).cast("int")


def _budget(n: Column, t: float) -> Column:
    return F.floor((n + _longest(n, t)) * (1.0 - t) + 1e-9).cast("int")


def _bounds(i: Column, n: Column, pieces: Column) -> tuple[Column, Column]:
    start = F.floor(i * n / pieces).cast("int")
    return start, F.floor((i + 1) * n / pieces).cast("int") - start


def _own_segments(form: Column, budget) -> Column:
    n = F.length(form)
    pieces = budget(n) + 1

    def one(i: Column) -> Column:
        start, size = _bounds(i, n, pieces)
        return F.struct(n.alias("n"), i.alias("i"), F.substr(form, start + 1, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), pieces - 1), one)


def _met_segments(form: Column, budget, apart_of, shortest: Column) -> Column:
    """Where the segments of texts of ``shortest`` letters and more may stand in this one, if it is the longer."""
    m = F.length(form)
    none = F.array().cast("array<struct<n:int,i:int,piece:string>>")

    def per_length(n: Column) -> Column:
        pieces = budget(n) + 1
        apart = apart_of(n, m)

        def per_segment(i: Column) -> Column:
            start, size = _bounds(i, n, pieces)
            low = F.greatest(F.lit(0), start - F.floor((apart - (m - n)) / 2).cast("int"))
            high = F.least(m - size, start + F.floor((apart + (m - n)) / 2).cast("int"))
            spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(spots, lambda q: F.struct(
                n.alias("n"), i.alias("i"), F.substr(form, q + 1, size).alias("piece")))

        return F.when(apart >= m - n, F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), per_segment))).otherwise(none)

    return F.when(shortest <= m, F.array_distinct(F.flatten(F.transform(F.sequence(shortest, m), per_length)))).otherwise(none)


def _by_segment(values: DataFrame, keys: list[str], v: Column, tokens: Column, t: float) -> DataFrame:
    """Pairs (v1, v2) whose letters, as they stand or with sorted words, reach the threshold."""
    forms = F.array_distinct(F.array(v, F.array_join(F.array_sort(tokens), " "), F.array_join(F.array_sort(F.array_distinct(tokens)), " ")))
    formed = values.select(*keys, v.alias("v"), F.explode(forms).alias("form"))
    form, budget = F.col("form"), lambda n: _budget(n, t)
    apart = lambda n, m: F.floor((n + m) * (1.0 - t) + 1e-9).cast("int")
    shortest = F.greatest(F.lit(1), F.ceil(F.length(form) / (2.0 / t - 1.0) - 1e-9).cast("int"))
    own = formed.select(*keys, F.col("v").alias("v1"), F.inline(_own_segments(form, budget)))
    met = formed.select(*keys, F.col("v").alias("v2"), F.inline(_met_segments(form, budget, apart, shortest)))
    return own.join(met, [*keys, "n", "i", "piece"]).where("v1 <> v2").select(*keys, "v1", "v2")


def _same_scale(a: Column, b: Column) -> Column:
    """Only texts of about one length score above 90: longer spreads are scaled down."""
    return F.greatest(F.length(a), F.length(b)) < 1.5 * F.least(F.length(a), F.length(b))


#: A word on more values of a block than this is dealt over ``HOT_WORD_SALTS`` tasks.
HOT_WORD, HOT_WORD_SALTS = 1_000, 32


#
# Words that two texts share count in two ways.  One text's words may score against the shared ones:
# then few of its letters lie outside them, and one of its rarest words is shared.  Or the rests
# score: then they differ by few letters, every word of theirs is touched by one of those (it would
# be shared otherwise), and one letter touches two words at most, so the rests are a few words.

def _rest_letters(size: Column, score: float) -> Column:
    """Most letters by which the rests of texts may differ, the shorter of ``size`` letters; also bounds a rest that scores alone."""
    return F.floor(2.0 * size * (1.0 - score) / score + 1e-9).cast("int")


def _by_rarest_word(values: DataFrame, keys: list[str], v: Column, tokens: Column, t: float) -> DataFrame:
    """Pairs (v1, v2) where nearly all letters of v1 lie in words of v2: a prefix filter on v1's rarest words.

    The prefix ends once its letters exceed what may lie outside, mostly after one word.  A word
    that is everywhere is a key only for texts made of such words; its rows are dealt over tasks.
    """
    several = values.select(*keys, v.alias("v"), F.array_distinct(tokens).alias("_own"))
    listed = several.select(*keys, "v", F.explode("_own").alias("token"))
    often = listed.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_n"))
    ranked = listed.join(often, [*keys, "token"]).groupBy(*keys, "v").agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_r"))
    own = F.transform("_r", lambda r: r["token"])
    outside = _rest_letters(F.length(F.array_join(own, " ")), t / 0.95)
    before = lambda i: F.aggregate(F.slice("_r", F.lit(1), i), F.lit(0), lambda n, r: n + F.length(r["token"]) + 1)
    prefix = (ranked.select(*keys, F.col("v").alias("v1"), own.alias("own1"), outside.alias("_most"), F.inline(F.filter("_r", lambda r, i: before(i) <= outside)))
              .withColumn("_salt", F.explode(F.when(F.col("_n") > HOT_WORD, F.sequence(F.lit(0), F.lit(HOT_WORD_SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_n"))
    every = ranked.select(*keys, F.col("v").alias("v2"), own.alias("own2"), F.inline("_r")).withColumn(
        "_salt", F.when(F.col("_n") > HOT_WORD, F.pmod(F.xxhash64("v2"), F.lit(HOT_WORD_SALTS)).cast("int")).otherwise(0)).drop("_n")
    return (prefix.join(every, [*keys, "token", "_salt"]).where("v1 <> v2").where(_same_scale(F.col("v1"), F.col("v2")))
            .where(F.length(F.array_join(F.array_except("own1", "own2"), " ")) <= F.col("_most")).select(*keys, "v1", "v2"))


def _by_rest(values: DataFrame, keys: list[str], v: Column, tokens: Column, t: float) -> DataFrame:
    """Pairs (v1, v2) that share words and whose rests differ by few letters.

    Every choice of a few words as the rest is listed under the words left, with the rest's
    segments.  Texts too short for a letter to be spared are not listed at all.
    """
    score = t / 0.95
    texts = values.select(*keys, v.alias("v"), F.array_sort(F.array_distinct(tokens)).alias("_own"))
    texts = texts.withColumn("_most", 2 * _rest_letters(F.length(F.array_join("_own", " ")), score)).where((F.size("_own") > 1) & (F.col("_most") > 0))
    part = "array<struct<kept: array<string>, rest: array<string>>>"
    start = F.array(F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("rest")))
    cut = lambda kept, rest: F.struct(kept.alias("kept"), rest.alias("rest"))
    choices = F.aggregate("_own", start.cast(part), lambda seen, w: F.concat(
        F.transform(seen, lambda p: cut(F.concat(p["kept"], F.array(w)), p["rest"])),
        F.transform(F.filter(seen, lambda p: F.size(p["rest"]) < F.col("_most")), lambda p: cut(p["kept"], F.concat(p["rest"], F.array(w))))))
    chosen = (texts.select(*keys, "v", F.inline(choices)).where((F.size("kept") > 0) & (F.size("rest") > 0))
              .select(*keys, "v", F.array_join("kept", " ").alias("kept"), F.array_join("rest", " ").alias("form")))
    form, shared = F.col("form"), F.length("kept") + 1
    budget = lambda n: _rest_letters(shared + n, score)
    apart = lambda n, m: F.floor((2 * shared + n + m) * (1.0 - score) + 1e-9).cast("int")
    shortest = F.greatest(F.lit(1), F.length(form) - _rest_letters(shared + F.length(form), score))
    own = chosen.select(*keys, "kept", F.col("v").alias("v1"), F.inline(_own_segments(form, budget)))
    met = chosen.select(*keys, "kept", F.col("v").alias("v2"), F.inline(_met_segments(form, budget, apart, shortest)))
    return own.join(met, [*keys, "kept", "n", "i", "piece"]).where("v1 <> v2").select(*keys, "v1", "v2")


def similar_values(values: DataFrame, block: Iterable[str], value: str, threshold: float,
                   abbreviations: bool = True) -> DataFrame:
    """Pairs of distinct values in the same block that name the same thing.

    ``values`` holds distinct non-empty (block..., value) rows, lowered.  Returns
    block..., ``value_a`` < ``value_b``, ``similarity``: every pair whose WRatio is
    at least ``threshold``, or (optionally) one abbreviates the other.  Exact for
    thresholds above 90, where only same-scale texts can reach the score.
    """
    if threshold <= 90.0:
        raise ValueError("segment search is exact only for thresholds above 90")
    keys, t = list(block), threshold / 100.0
    v = F.col(value)
    tokens = words(v)
    found = (_by_segment(values, keys, v, tokens, t).unionByName(_by_rarest_word(values, keys, v, tokens, t))
             .unionByName(_by_rest(values, keys, v, tokens, t)))
    ordered = (found.select(*keys, F.least("v1", "v2").alias("value_a"), F.greatest("v1", "v2").alias("value_b")).distinct()
               .where(_same_scale(F.col("value_a"), F.col("value_b"))))
    # each distinct pair of texts is scored once, whatever block it came from
    scores = (ordered.select("value_a", "value_b").distinct()
              .withColumn("similarity", wratio(F.col("value_a"), F.col("value_b")))
              .where(F.col("similarity") >= threshold))
    links = ordered.join(scores, ["value_a", "value_b"])
    if not abbreviations:
        return links.select(*keys, "value_a", "value_b", "similarity")

    short = letters_only(v)
    stems = values.select(*keys, v.alias("v1"), short.alias("stem")).where(F.length("stem").between(1, 3))
    heads = (values.select(*keys, v.alias("v2"), short.alias("whole"))
             .withColumn("stem", F.explode(F.array_distinct(F.transform(
                 F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.substr(F.col("whole"), F.lit(1), k)))))
             .where("stem <> '' AND stem <> whole"))
    shortened = (stems.join(heads, [*keys, "stem"])
                 .select(*keys, F.least("v1", "v2").alias("value_a"), F.greatest("v1", "v2").alias("value_b"))
                 .distinct())
    pairs = (links.select(*keys, "value_a", "value_b", "similarity")
             .unionByName(shortened.withColumn("similarity", F.lit(None).cast("double"))))
    return pairs.groupBy(*keys, "value_a", "value_b").agg(F.max("similarity").alias("similarity"))
