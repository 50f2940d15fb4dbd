"""Streams of candidates as one report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order their fixes are applied.
FIX_ORDER = [
    "guard_clause", "primitive_obsession", "value_object", "factory", "specification", "missing_identity", "entity_identity", "domain_service",
    "anemic_model", "type_switch", "enum_dispatch", "trait_method", "capability_set", "generic_fn", "parameterize",
]
#: Kinds that are fixed together, phase by phase; each phase sees what the one before it wrote.
FIX_PHASES = [FIX_ORDER[:2], FIX_ORDER[2:3], FIX_ORDER[3:14], FIX_ORDER[14:]]


def union_ranked(streams: dict[str, DataFrame]) -> DataFrame:
    """All candidates with their kind; a report is read in the order of `best_first`."""
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in streams.items()])


def best_first(candidates: DataFrame) -> DataFrame:
    """Score descending, then sites as lists, the shorter of equals first, then kind and observation: a total order."""
    return candidates.orderBy(F.col("score").desc(), "sites", "kind", "observation")


def first_by_id(candidates: DataFrame, id_col: str, *order: Column) -> DataFrame:
    """One candidate an id, the first by order."""
    return candidates.groupBy(id_col).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != id_col]), F.struct(*order)).alias("__r")).select(id_col, "__r.*")


def fix_order(specs: DataFrame) -> DataFrame:
    """Adds `kind_rank`; fixes are applied by (kind_rank, path, line descending), so that earlier lines stay put."""
    rank = F.array_position(F.array(*map(F.lit, FIX_ORDER)), F.col("kind"))
    return specs.withColumn("kind_rank", F.when(rank == 0, len(FIX_ORDER) + 1).otherwise(rank).cast("int")).orderBy("kind_rank", "path", F.col("line").desc())


def is_boilerplate(name: Column, path: Column) -> Column:
    """A function id with a part tests, ffi or raw, one that begins with bindgen, or main as its last; or one in a folder tests."""
    parts = F.filter(F.split(name, "[/.]"), lambda s: s != "")
    shim = F.exists(parts, lambda s: s.isin("tests", "ffi", "raw") | s.startswith("bindgen"))
    return F.coalesce(shim | (F.try_element_at(parts, F.lit(-1)) == "main"), F.lit(False)) | F.coalesce(path.startswith("tests/") | path.contains("/tests/"), F.lit(False))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """A pattern holds anywhere; in one with `*`, each stands for any text."""
    out = F.lit(False)
    for p in patterns:
        out = out | (value.rlike("^" + ".*".join(map(_quoted, p.split("*"))) + "$") if "*" in p else value.contains(p))
    return out


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E" if text else ""


def diagnostics_text(rows: DataFrame) -> DataFrame:
    """`text`: path:line:column: rule name: actual/max."""
    return rows.select(F.format_string("%s:%d:%d: %s %s: %d/%d", "path", "line", "column", "rule", "name", "actual", "max").alias("text"))


def report_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "false"}).alias("json"))


def markers(candidates: DataFrame) -> DataFrame:
    """`path, line, kind, score, observation`: one mark a site (V3)."""
    return candidates.select("kind", "score", "observation", F.explode("sites").alias("s")).select("s.path", "s.line", "kind", "score", "observation")


def marks_by_line(marks: DataFrame) -> DataFrame:
    """At each line the best mark of each kind; of equals the first observation."""
    best = marks.groupBy("path", "line", "kind").agg(F.min_by(F.struct("score", "observation"), F.struct(-F.col("score"), F.col("observation"))).alias("b"))
    return best.select("path", "line", "kind", "b.score", "b.observation")


def run_phases(mine: Callable[[list[str], set[str] | None], DataFrame], apply: Callable[[DataFrame], set[str]], cycles: int = 3) -> tuple[int, set[str]]:
    """Fixes phase by phase until a cycle changes nothing, `cycles` times at most; the number of cycles and all changed files.

    mine(kinds, files) gives the ordered fixes of some kinds, of all files in the first cycle and then of the changed ones; apply
    writes them and returns the files it changed.
    """
    every: set[str] = set()
    dirty: set[str] | None = None
    for cycle in range(1, cycles + 1):
        changed: set[str] = set()
        for kinds in FIX_PHASES:
            scope = None if dirty is None else dirty | changed
            changed |= apply(fix_order(mine(kinds, scope)))
        every |= changed
        if not changed:
            return cycle, every
        dirty = changed
    return cycles, every
