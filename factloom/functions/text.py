"""Names and texts: Jaro-Winkler, shorteners, call scope, formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """By characters; matches within max(length) / 2 - 1; transpositions are halved without rounding. Both empty: 1."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, own = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    if not own:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    half = sum(x != y for x, y in zip(own, other)) / 2.0
    m = len(own)
    return (m / len(a) + m / len(b) + (m - half) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for a common prefix of up to 4 characters by 0.1 each, whatever the Jaro value."""
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    j = jaro(a, b)
    return j + prefix * 0.1 * (1.0 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def prefix_settles(a: Column, b: Column, least: float) -> Column:
    """Whether a common prefix alone makes jaro_winkler(a, b) >= least: k common first characters are k matches, so the Jaro
    similarity is at least (k / |a| + k / |b|) / 3, and the prefix raises it by k tenths of what is missing."""
    out = F.lit(False)
    for k in range(1, 5):
        same = (F.char_length(a) >= k) & (F.char_length(b) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k)))
        jaro = (F.lit(k) / F.char_length(a) + F.lit(k) / F.char_length(b)) / 3.0
        out = out | (same & (F.lit(k * 0.1) + jaro * (1.0 - k * 0.1) >= least + 1e-9))
    return F.coalesce(out, F.lit(False))


def names_at_least(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Rows of pairs with jaro_winkler(a, b) >= least. Those that a prefix settles are one branch, which has no Python; only the
    others reach the UDF."""
    settled = prefix_settles(F.col(a), F.col(b), least)
    return pairs.filter(settled).union(pairs.filter(~settled).filter(jaro_winkler_udf(a, b) >= least))


def short_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def last_two(c: Column) -> Column:
    return F.substring_index(c, ".", -2)


def after_slash(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def owner_package(c: Column) -> Column:
    """What stands before the first dot after the last slash, with the path."""
    return F.regexp_extract(c, r"^(.*/)?([^./]*)", 0)


def has_receiver(c: Column) -> Column:
    """Two dots or more after the last slash."""
    tail = after_slash(c)
    return F.length(tail) - F.length(F.replace(tail, F.lit("."), F.lit(""))) >= 2


def call_scope(callee: Column, standard: list[str]) -> Column:
    """builtin (no dot), unknown (empty), std (first path part in the list), else local."""
    root = F.regexp_extract(callee, r"^[^./(]*", 0)
    return F.when(F.coalesce(callee, F.lit("")) == "", "unknown").when(~callee.contains("."), "builtin").when(root.isin(standard) & ~F.regexp_extract(callee, r"^[^/]*", 0).rlike(r"\.[a-z]+$"), "std").otherwise("local")


def call_class(signature: Column, callee: Column) -> Column:
    """The signature's class, else the callee, else `?`; empty is missing."""
    return F.coalesce(F.nullif(signature, F.lit("")), F.nullif(callee, F.lit("")), F.lit("?"))


def bit_names(bits: Column, names: list[str], none: str = "pure") -> Column:
    """Names of the set bits, from the lowest, joined by `|`."""
    parts = F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]))
    return F.when(F.size(parts) == 0, none).otherwise(F.array_join(parts, "|"))


@F.pandas_udf(T.StringType())
def _two_places(scores: pd.Series) -> pd.Series:
    return scores.map(lambda s: f"{s / 1000:.2f}", na_action="ignore")


def milli(score: Column) -> Column:
    """Thousandths with two places, the double rounded as it is: 15 gives 0.01, for 0.015 lies below the half. The JVM's formats round
    its shortest digits instead, so this is Arrow."""
    return _two_places(score.cast("double"))


def next_sequence(ids: Column, prefix: str) -> Column:
    """Aggregate: one more than the largest number after prefix."""
    return F.coalesce(F.max(F.regexp_extract(ids, rf"^{prefix}(\d+)$", 1).try_cast("long")), F.lit(0)) + 1


def candidate_score(support: Column, lift: Column, coverage: Column, holes: Column, damped: Column) -> Column:
    """(1000 ln(max(1, support)) + lift) x coverage / 1000, by 3 / holes beyond 3, halved if damped; rounded half away from 0."""
    base = (F.lit(1000.0) * F.log(F.greatest(support, F.lit(1)).cast("double")) + lift) * coverage / 1000.0
    base = base * F.when(holes > 3, F.lit(3.0) / holes).otherwise(F.lit(1.0)) * F.when(damped, 0.5).otherwise(1.0)
    return F.round(base).cast("long")
