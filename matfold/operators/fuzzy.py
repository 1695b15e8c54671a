"""Fuzzy name join (J3 / D8): best candidate per probe above a cutoff.

Exact at scale, without comparing all pairs:

1. Work on distinct keys of both sides (names repeat a lot).
2. Bigram blocking with prefix filtering.  Each key becomes a multiset of
   bigrams, represented as (token, occurrence) pairs.  A pair that reaches the
   cutoff must share at least ``t`` of them, and a per-key lower bound of
   ``t`` follows from the key's own length.  Ordering tokens by global
   frequency (rarest first), two keys sharing >= t tokens must share one of
   their first ``n - t + 1`` tokens, so only those prefix tokens are joined.
   Frequent tokens therefore rarely pair keys up.

   For the difflib ratio the bound counts matching blocks: M matched characters
   leave la + lb - 2M others, and one of them at least stands between two
   blocks, so there are at most la + lb - 2M + 1 blocks and the pair shares at
   least 3M - (la + lb) - 1 bigrams.
3. Pairs so short that the bound vanishes are blocked by single characters and
   both lengths: a key only meets keys of the one other length it was
   emitted for, and shares its rarest characters with them.
4. Length filter, exact score (native ``levenshtein`` or an Arrow
   ``pandas_udf`` running ``difflib``, its cheap upper bounds first).
5. Best per probe by (score desc, candidate desc) with a map-side
   combined ``max_by``.

Levenshtein pairs of keys of length <= 2 (cutoff .75) are matched by an equi-join
on admissible length; there are at most a few thousand such distinct keys.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matfold.operators.dedup import best_per_key
from matfold.session import ship_package


def difflib_scores(cutoff: float):
    """Arrow UDF: ``SequenceMatcher(None, candidate, word).ratio()`` per pair, null where it is below the cutoff."""
    @F.pandas_udf(T.DoubleType())
    def scores(candidate: pd.Series, word: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        sm, last, out = SequenceMatcher(), None, []
        for c, w in zip(candidate, word, strict=True):
            if w != last:
                sm.set_seq2(w)
                last = w
            sm.set_seq1(c)
            low = cutoff - 1e-12
            r = sm.ratio() if sm.real_quick_ratio() >= low and sm.quick_ratio() >= low else 0.0
            out.append(r if r >= low else None)
        return pd.Series(out, dtype="float64")

    return scores


@F.pandas_udf(T.IntegerType())
def shared_bigrams(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the common multiset of bigrams per pair (Arrow batch)."""
    from collections import Counter
    bags: dict[str, Counter] = {}

    def bag(key: str) -> Counter:
        if key not in bags:
            bags[key] = Counter(map("".join, zip(key, key[1:], strict=False)))
        return bags[key]

    return pd.Series([(bag(a) & bag(b)).total() for a, b in zip(left, right, strict=True)], dtype="int32")


def _tokens(key: Column, q: int) -> Column:
    """Array of q-grams of ``key`` (characters when q == 1)."""
    if q == 1:
        return F.filter(F.split(key, ""), lambda x: x != "")
    n = F.length(key) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                     lambda i: F.substring(key, i, q))).otherwise(F.array())


def _shared_bigrams(total: Column, cutoff: float) -> Column:
    """Bigrams that two keys of ``total`` characters share at least when their ratio reaches the cutoff (3M - total - 1, 2M >= cutoff * total)."""
    return 3 * F.ceil(cutoff * total / 2 - 1e-9) - total - 1


def _free_total(cutoff: float) -> int:
    """Largest la + lb for which ``_shared_bigrams`` may be under 1; -1: of any length (no bound for cutoffs of 2/3 and less)."""
    if cutoff * 3 / 2 <= 1 + 1e-9:
        return -1
    top = math.ceil(2 / (1.5 * cutoff - 1))  # from here on the bound is 1 at least
    return max((s for s in range(top + 1) if 3 * math.ceil(cutoff * s / 2 - 1e-9) - s - 1 < 1), default=0)


def _min_overlap(length: Column, metric: str, cutoff: float) -> Column:
    """Per-key lower bound on the bigrams a matching pair must share."""
    if metric == "levenshtein":
        # shared bigrams >= max(la,lb) - 1 - 2k, k <= (1-c) max(la,lb)
        return F.ceil(length * (2 * cutoff - 1) - 1 - 1e-9).cast("int")
    # the shortest partner has c la / (2 - c) characters; without rounding up M the bound grows with the total
    total = length + F.ceil(length * cutoff / (2 - cutoff) - 1e-9)
    return F.ceil((1.5 * cutoff - 1) * total - 1 - 1e-9).cast("int")


def _tagged(key: Column, q: int) -> Column:
    """Tokens of ``key`` as (tok, occ) structs: a multiset written as a set.

    The occurrence number is counted natively inside the row (tokens before
    this position that are equal), so no shuffle or window is needed; the
    cost is quadratic in the key length only.
    """
    toks = _tokens(key, q)
    return F.transform(toks, lambda x, i: F.struct(
        x.alias("tok"), (F.size(F.filter(F.slice(toks, F.lit(1), i), lambda y: y == x)) + 1).alias("occ")))


def _occ_table(keys: DataFrame, q: int) -> DataFrame:
    return keys.select("key", F.inline(_tagged(F.col("key"), q)))


def _prefix_tokens(keys: DataFrame, freq: DataFrame, metric: str, cutoff: float, q: int) -> DataFrame:
    with_f = _occ_table(keys, q).join(freq, ["tok", "occ"])
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("f", "tok", "occ"))
    ranked = with_f.select("key", "tok", "occ", n.alias("n"), rank.alias("r"),
                           _min_overlap(F.length("key"), metric, cutoff).alias("t"))
    return ranked.where(F.col("r") <= F.col("n") - F.greatest(F.col("t"), F.lit(1)) + 1) \
                 .select("key", "tok", "occ")


def _short_pairs(P: DataFrame, C: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of the difflib ratio that share no sure bigram: prefix filtering over characters, per pair of lengths."""
    free = _free_total(cutoff)
    own = F.length("key")
    # admissible partner lengths: 2 min(la, lb) >= c (la + lb), and a total without a bigram bound
    low = F.greatest(F.ceil(own * cutoff / (2 - cutoff) - 1e-9), F.lit(1)).cast("int")
    high = F.floor(own * (2 - cutoff) / cutoff + 1e-9).cast("int")
    high = high if free < 0 else F.least(high, F.lit(free) - own)
    short = lambda keys: keys.where((own > 0) & (low <= high))
    P, C = short(P), short(C)
    freq = _occ_table(P, 1).unionByName(_occ_table(C, 1)).groupBy("tok", "occ").agg(F.count(F.lit(1)).alias("f"))

    def prefixes(keys: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("key").orderBy("f", "tok", "occ"))
        ranked = _occ_table(keys, 1).join(freq, ["tok", "occ"]).select("key", "tok", "occ", rank.alias("r"))
        wide = ranked.select("key", "tok", "occ", "r", own.alias(mine), F.explode(F.sequence(low, high)).alias(other))
        need = F.ceil(cutoff * (F.col(mine) + F.col(other)) / 2 - 1e-9)
        return wide.where(F.col("r") <= F.col(mine) - need + 1).select(F.col("key").alias(name), "tok", "occ", mine, other)

    return (prefixes(P, "probe", "lp", "lc").join(prefixes(C, "cand", "lc", "lp"), ["tok", "occ", "lp", "lc"])
            .select("probe", "cand").distinct())


def candidate_pairs(P: DataFrame, C: DataFrame, metric: str, cutoff: float) -> DataFrame:
    """(probe, cand) of the distinct keys ``P`` and ``C`` (column ``key``): every pair that can reach the cutoff, and few others."""
    # global token frequency over both sides, per (token, occurrence)
    freq = _occ_table(P, 2).unionByName(_occ_table(C, 2)).groupBy("tok", "occ").agg(F.count(F.lit(1)).alias("f"))
    pp = _prefix_tokens(P, freq, metric, cutoff, 2).withColumnRenamed("key", "probe")
    cp = _prefix_tokens(C, freq, metric, cutoff, 2).withColumnRenamed("key", "cand")
    lp, lc = F.length("probe"), F.length("cand")
    if metric == "levenshtein":
        fits = F.abs(lp - lc) <= F.greatest(lp, lc) * (1 - cutoff) + 1e-9
        # keys whose token bound can vanish: pair by admissible length
        short_len = max(1, math.floor(1 / (2 * cutoff - 1)))
        sp = P.where(F.length("key") <= short_len).withColumnRenamed("key", "probe")
        sc = C.where(F.length("key") <= short_len).select(F.col("key").alias("cand"), F.length("key").alias("_l"))
        rest = (sp.select("probe", F.explode(F.sequence(F.lit(0), F.lit(short_len))).alias("_l"))
                .join(sc, "_l").select("probe", "cand").where(fits))
    else:
        fits = (2 * F.least(lp, lc) >= cutoff * (lp + lc) - 1e-9) & (_shared_bigrams(lp + lc, cutoff) >= 1)
        rest = _short_pairs(P, C, cutoff)
        if _free_total(cutoff) < 0:
            return rest
    pairs = pp.join(cp, ["tok", "occ"]).select("probe", "cand").where(fits).distinct()
    if metric == "ratio":  # the pairs that met in a prefix share enough bigrams in all
        pairs = pairs.where(shared_bigrams("probe", "cand") >= _shared_bigrams(lp + lc, cutoff))
    return pairs.unionByName(rest).distinct()


def fuzzy_best_match(probes: DataFrame, probe_col: str, candidates: DataFrame, cand_col: str,
                     cutoff: float = 0.8, metric: str = "ratio") -> DataFrame:
    """(probe, match, score) for every distinct probe key that has a match.

    ``metric='ratio'`` is difflib's ratio with the probe as the second
    sequence (as ``get_close_matches`` does); ``'levenshtein'`` scores
    1 - lev / max(len).  Both keep ties by the larger candidate string.
    """
    if metric not in ("ratio", "levenshtein"):
        raise ValueError(metric)
    if metric == "levenshtein" and cutoff <= 0.5:
        raise ValueError("levenshtein blocking needs cutoff > 0.5")
    if metric == "ratio":
        if not 0 < cutoff <= 1:
            raise ValueError("a ratio's cutoff is above 0 and at most 1")
        ship_package(probes.sparkSession)
    P = probes.select(F.col(probe_col).alias("key")).where(F.col("key").isNotNull()).distinct()
    C = candidates.select(F.col(cand_col).alias("key")).where(F.col("key").isNotNull()).distinct()
    kept = candidate_pairs(P, C, metric, cutoff)
    if metric == "levenshtein":
        score = 1 - F.levenshtein("probe", "cand") / F.greatest(F.length("probe"), F.length("cand"), F.lit(1))
        good = kept.select("probe", "cand", score.alias("score")).where(F.col("score") >= cutoff - 1e-12)
    else:
        good = kept.select("probe", "cand", difflib_scores(cutoff)("cand", "probe").alias("score")).where("score IS NOT NULL")
        # '' matches '' with ratio 1.0 (no tokens to block on)
        empty = (P.where(F.col("key") == "").join(C.where(F.col("key") == ""), "key")
                  .select(F.col("key").alias("probe"), F.col("key").alias("cand"), F.lit(1.0).alias("score")))
        good = good.unionByName(empty)
    return best_per_key(good, "probe", "score", "cand").select("probe", F.col("cand").alias("match"), "score")


def fuzzy_merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                cutoff: float = 0.8, metric: str = "ratio") -> DataFrame:
    """Inner join of ``left`` to ``right`` through each left key's best match."""
    m = fuzzy_best_match(left, left_key, right, right_key, cutoff, metric)
    lm = left.join(m.select(F.col("probe").alias(left_key), "match"), left_key)
    return lm.join(right.withColumnRenamed(right_key, "match"), "match").drop("match")
