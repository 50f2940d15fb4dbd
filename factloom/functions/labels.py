"""Labels, colours, counts of lines, searches and paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_label(kind: Column, scope: Column, signature: Column, literal: Column, detail: Column, type_class: Column) -> Column:
    """A node's label: calls by scope and signature, literals by kind, operators by the class before a colon, parameters by type; any
    other by its kind alone."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(kind == "call", F.concat(F.lit("call:"), text(scope), F.lit(":"), text(signature)))
        .when(kind == "lit", F.concat(F.lit("lit:"), text(literal)))
        .when(kind == "op", F.concat(F.lit("op:"), F.substring_index(text(detail), ":", 1)))
        .when(kind == "param", F.concat(F.lit("param:"), text(type_class)))
        .otherwise(kind)
    )


def signature_key(types: Column) -> Column:
    """`fn(a,b)` of an array of type classes in order."""
    return F.concat(F.lit("fn("), F.array_join(types, ","), F.lit(")"))


def damped(score: Column, kind: Column) -> Column:
    """Whole halves of generic functions' scores, whole thirds of parameterized ones'; others as they are."""
    return F.when(kind == "generic_fn", F.floor(score / 2)).when(kind == "parameterize", F.floor(score / 3)).otherwise(score).cast("long")


#: The colours of scores 0, 10, 20 and 30.
RAMP = [(102, 166, 120), (221, 194, 125), (212, 112, 60), (209, 105, 105)]


def ramp_colour(score: Column, ramp: list[tuple[int, int, int]] = RAMP, step: int = 10) -> Column:
    """Struct r, g, b: linear between the colours, a score beyond the ends counts as the end; fractions are cut off."""
    s = F.least(F.greatest(score, F.lit(0)), F.lit(step * (len(ramp) - 1)))
    at = F.least(F.floor(s / step), F.lit(len(ramp) - 2)).cast("int")
    part = (s - at * step) / F.lit(float(step))
    side = lambda c, k: F.element_at(F.array(*[F.lit(x[c]) for x in ramp]), at + k)
    return F.struct(*[F.floor(side(c, 1) + part * (side(c, 2) - side(c, 1))).cast("int").alias(n) for c, n in enumerate("rgb")])


def shaded(channel: Column, shade: float) -> Column:
    return F.floor(F.least(channel * F.lit(shade), F.lit(255.0))).cast("int")


def code_lines(text: Column, comment: str = "//") -> Column:
    """Lines with something on them that is not a comment to the end of the line."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith(comment)))


def unique_line(source: Column, needle: Column, first: Column) -> Column:
    """The line on which whole lines stand that occur once in the source, whose first line is `first`; null if they occur more often, not
    at all, or are blank."""
    text, part = F.concat(F.lit("\n"), source, F.lit("\n")), F.concat(F.lit("\n"), needle, F.lit("\n"))
    at = F.instr(text, part)
    again = F.instr(F.substring(text, at + 1, F.length(text)), part)
    before = F.substring(text, F.lit(1), at - 1)
    line = first + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when((F.trim(needle) != "") & (at > 0) & (again == 0), line.cast("int"))


def within(text: Column, most: int = 160) -> Column:
    """Whether a text has characters, but not over `most`."""
    return F.coalesce(F.char_length(F.trim(text)).between(1, 1 << 30) & (F.char_length(text) <= most), F.lit(False))


def clamped_wait(ms: Column, default: int = 30_000, most: int = 60_000) -> Column:
    """A waiting time in milliseconds: the default if none is given, null if it is out of range."""
    given = F.coalesce(ms, F.lit(default))
    return F.when(given.between(0, most), given)


#: Names of folders and files where a repository lives, and affixes.
REPOSITORY_NAMES = ["adapters", "repository", "repositories", "repo", "repos", "dao", "daos", "store", "stores", "storage"]
REPOSITORY_AFFIXES = ["repo_", "_repo", "repository_", "_repository"]


def is_repository_path(path: Column, suffix: str = ".go") -> Column:
    parts = F.transform(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda s: F.when(s.endswith(suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s))

    def one(s: Column) -> Column:
        out = s.isin(REPOSITORY_NAMES)
        for x in REPOSITORY_AFFIXES:
            out = out | s.startswith(x) | s.endswith(x)
        return out

    return F.coalesce(F.exists(parts, one), F.lit(False))
