"""Longest-prefix classification, callee normalisation, suppressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BRACKETS = re.compile(r"([\[\]<>])")


def longest_prefix(values: DataFrame, value_col: str, policy: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """Adds `prefix, kind` of the policy's longest prefix of each value; of equal ones the later row. No match: null, default.

    Only prefixes as long as some policy row are made, and joined by equality, so the plan is a hash join of the policy's few
    rows; each distinct value is classified once.
    """
    lengths = sorted({len(p) for p, _ in policy})
    spark = values.sparkSession
    rules = spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(policy)] or [("", None, 0)], "prefix string, kind string, pos int")
    distinct = values.select(value_col).distinct()
    pieces = distinct.withColumn("n", F.explode(F.array(*map(F.lit, lengths or [0])))).filter(F.char_length(value_col) >= F.col("n"))
    pieces = pieces.withColumn("prefix", F.substring(F.col(value_col), F.lit(1), F.col("n")))
    best = pieces.join(F.broadcast(rules), "prefix").groupBy(value_col).agg(F.max_by(F.struct("prefix", "kind"), F.struct("n", "pos")).alias("best"))
    out = values.join(best, value_col, "left")
    return out.select(*values.columns, F.col("best.prefix").alias("prefix"), F.coalesce(F.col("best.kind"), F.lit(default)).alias("kind"))


def plain_callee(name: str) -> str:
    """As normalized_callee, of one name."""
    out, depth = [], 0
    for part in _BRACKETS.split(name):
        if part in ("[", "<"):
            depth += 1
        elif part in ("]", ">"):
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(part)
    return "".join(out).replace("::::", "::")


@F.pandas_udf(T.StringType())
def _plain_callees(names: pd.Series) -> pd.Series:
    return names.map(plain_callee, na_action="ignore")


def normalized_callee(name: Column) -> Column:
    """What stands in [...] or <...> is removed, at any depth, whichever bracket closes it; what is never closed goes to the end,
    and a bracket that closes nothing is dropped; `::::` becomes `::`. Names without brackets don't leave the JVM."""
    plain = F.regexp_replace(name, r"\[[^\[\]<>]*\]|<[^\[\]<>]*>", "")  # the common case: one level, well formed
    return F.regexp_replace(F.when(plain.rlike(r"[\[\]<>]"), _plain_callees(name)).otherwise(plain), "::::", "::")


def suppressions(lines: DataFrame, line_col: str, known: list[str], marker: str = r"\w[\w.]*-allow") -> DataFrame:
    """Adds `suppressed` (array of known rules), `invalid` and `problem` (null if valid) of a comment `// x-allow(r1, r2): reason` or
    `//lint:ignore r1, r2 reason`, whose rules are the leading words of a-z, 0-9 and _.

    A comment with the marker that is not of this form, a missing reason, an unknown rule, or `invalid_suppression` among the rules
    makes it invalid, and it then suppresses nothing. Lines without one: empty, false.
    """
    text = F.trim(F.coalesce(F.col(line_col), F.lit("")), F.lit(" \t\r\n"))
    lint, own = text.startswith("//lint:ignore"), text.rlike(marker)
    words = F.filter(F.split(F.substring(text, 14, 1 << 20), r"\s+"), lambda w: w != "")
    clean = F.transform(words, lambda w: F.regexp_replace(w, ",$", ""))
    stop = F.array_position(F.transform(clean, lambda w: w.rlike("^[a-z0-9_]+$")), F.lit(False))
    lint_rules = F.when(stop == 0, clean).otherwise(F.slice(clean, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0))))
    form = rf"^// {marker}\("
    body = F.regexp_replace(text, form, "")
    own_rules = F.transform(F.split(F.substring_index(body, "):", 1), ","), lambda r: F.trim(r))
    reason = F.when(F.instr(body, "):") > 0, F.trim(F.expr("substring(__body, instr(__body, '):') + 2)")))
    wrong = lambda rules: F.when(F.size(F.array_except(rules, F.array(*map(F.lit, known)))) > 0, "unknown rule").when(F.array_contains(rules, "invalid_suppression"), "invalid_suppression cannot be suppressed")
    problem = F.when(lint, F.when(F.size(lint_rules) == 0, "rules are missing").when(stop == 0, "reason is missing").otherwise(wrong(lint_rules))).when(own, F.when(~text.rlike(form), "malformed").when(F.coalesce(reason, F.lit("")) == "", "reason is missing").otherwise(wrong(own_rules)))
    out = lines.withColumn("__body", body).withColumn("problem", problem).drop("__body")
    rules = F.when(F.col("problem").isNotNull(), None).when(lint, lint_rules).when(own, own_rules)
    return out.withColumn("suppressed", F.coalesce(rules, F.array().cast("array<string>"))).withColumn("invalid", F.col("problem").isNotNull())
