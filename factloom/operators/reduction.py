"""Operators whose steps depend on each other: reducers, edits, treemap, anti-unification (S3, X2, X3, X6-X8, V5, P23, 2.10). They work on one text or list."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tail:
    """The last `most` bytes of what is written."""

    def __init__(self, most: int = 16 << 10):
        self.most, self.held = most, b""

    def write(self, data: bytes) -> int:
        self.held = (self.held + data)[-self.most :] if self.most else b""
        return len(data)


def reduce_lines(text: str, fails: Callable[[str], bool], progress: Callable[[str, int], None] = lambda event, size: None) -> tuple[str, int]:
    """The smallest text found by removing runs of lines while `fails` stays true, and the number of checks.

    progress is told `seed`, then `checking` before each check and `accepted` after each success, with the text's length.

    Runs start at half the lines; after a success the pass begins again at the first line with the same size; when no run of a
    size can go, the size is halved. A text that does not fail is returned as it is.
    """
    lines, checks = text.splitlines(keepends=True), 1
    progress("seed", len(text))
    if not fails(text):
        return text, checks
    size = len(lines) // 2
    while size >= 1:
        at = 0
        while at < len(lines):
            rest = lines[:at] + lines[at + size :]
            checks += 1
            progress("checking", sum(map(len, rest)))
            if len(rest) < len(lines) and fails("".join(rest)):
                lines, at = rest, 0
                progress("accepted", sum(map(len, rest)))
            else:
                at += size
        size //= 2
    return "".join(lines), checks


def reduce_spans(text: str, spans: Callable[[str], list[tuple[int, int]]], fails: Callable[[str], bool]) -> tuple[str, int]:
    """Removes deletable spans, the largest first, parsing anew after each success, until none can go."""
    checks = 1
    if not fails(text):
        return text, checks
    again = True
    while again:
        again = False
        for a, b in sorted(spans(text), key=lambda s: (s[0] - s[1], s[0])):
            checks += 1
            if fails(text[:a] + text[b:]):
                text, again = text[:a] + text[b:], True
                break
    return text, checks


def deletion_groups(units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of adjacent units: of all, then of halves, down to single ones."""
    out, size = [], len(units)
    while size >= 1:
        out += [(units[i][0], units[min(i + size, len(units)) - 1][1]) for i in range(0, len(units), size)]
        size //= 2
    return list(dict.fromkeys(out))


def apply_edits(edits: DataFrame, sources: DataFrame) -> DataFrame:
    """`path, text, applied, skipped`: edits (`path, start, end, replacement`, characters) applied to each file (`path, text`) from
    the bottom up; one that overlaps an applied edit or lies outside is skipped. A file without edits stays as it is."""
    own = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), asc=False).alias("edits"))

    def run(batches):
        for pdf in batches:
            out = []
            for path, text, todo in pdf[["path", "text", "edits"]].itertuples(index=False):
                floor, done, skipped = len(text), 0, 0
                for e in todo if todo is not None else ():
                    a, b = e["start"], e["end"]
                    if a < 0 or b < a or b > floor:
                        skipped += 1
                        continue
                    text, floor, done = text[:a] + e["replacement"] + text[b:], a, done + 1
                out.append((path, text, done, skipped))
            yield pd.DataFrame(out, columns=["path", "text", "applied", "skipped"])

    return sources.select("path", "text").join(own, "path", "left").mapInPandas(run, "path string, text string, applied int, skipped int")


def dry_run(old: str, new: str, path: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}"))


def treemap(weights: list[tuple[str, int]], x: float, y: float, w: float, h: float) -> list[tuple[str, float, float, float, float]]:
    """Rectangles by recursive bisection: the list is cut where the first part is nearest to half the weight, across the longer side."""
    if not weights:
        return []
    if len(weights) == 1:
        return [(weights[0][0], x, y, w, h)]
    total, run, best, cut = sum(v for _, v in weights), 0, None, 1
    for i, (_, v) in enumerate(weights[:-1], 1):
        run += v
        if best is None or abs(2 * run - total) < best:
            best, cut = abs(2 * run - total), i
    part = sum(v for _, v in weights[:cut]) / total if total else cut / len(weights)
    if w >= h:
        return treemap(weights[:cut], x, y, w * part, h) + treemap(weights[cut:], x + w * part, y, w * (1 - part), h)
    return treemap(weights[:cut], x, y, w, h * part) + treemap(weights[cut:], x, y + h * part, w, h * (1 - part))


def treemaps(items: DataFrame, group_col: str, name_col: str, weight_col: str, width: float = 100.0, height: float = 60.0) -> DataFrame:
    """`group, name, x, y, w, h`: a treemap of each group, heaviest first, then by name."""
    kind = dict(items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values([weight_col, name_col], ascending=[False, True], kind="stable")
        rows = treemap(list(zip(own[name_col], own[weight_col])), 0.0, 0.0, width, height)
        return pd.DataFrame([(pdf[group_col].iloc[0], *r) for r in rows], columns=[group_col, name_col, "x", "y", "w", "h"])

    return items.groupBy(group_col).applyInPandas(run, f"{group_col} {kind[group_col]}, {name_col} {kind[name_col]}, x double, y double, w double, h double")


def anti_unify(a, b, _seen: dict | None = None):
    """The most specific pattern of which two trees are instances: a tree is (label, [children]); where they differ stands
    `("?", n)`, the same n for the same pair of parts."""
    seen = {} if _seen is None else _seen
    if a[0] == b[0] and len(a[1]) == len(b[1]):
        return (a[0], [anti_unify(x, y, seen) for x, y in zip(a[1], b[1])])
    key = (repr(a), repr(b))
    return ("?", seen.setdefault(key, len(seen)))


def common_root(paths: DataFrame, path_col: str) -> DataFrame:
    """`root`: the longest folder that holds all paths: that of the least and the greatest. A path without a folder has the empty one."""
    folder = lambda c: F.when(F.contains(F.col(c), F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    ends = paths.agg(F.min(path_col).alias("a"), F.max(path_col).alias("b")).select(F.split(folder("a"), "/").alias("x"), F.split(folder("b"), "/").alias("y"))
    parts = F.arrays_zip("x", "y")
    first = F.array_position(F.transform(parts, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))), False)
    n = F.when(first == 0, F.size(parts)).otherwise(first - 1).cast("int")
    return ends.select(F.array_join(F.slice("x", F.lit(1), n), "/").alias("root"))
