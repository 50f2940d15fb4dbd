"""Joins, counts and orders of report records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_pairs

#: Syntax that adds a path.
BRANCHES = ["if", "for", "range", "case", "comm", "&&", "||"]


def cyclomatic(nodes: DataFrame, function_col: str, kind_col: str, branches: list[str] = BRANCHES) -> DataFrame:
    """`function, complexity`: one more than the nodes that branch."""
    return nodes.groupBy(function_col).agg((F.count_if(F.col(kind_col).isin(branches)) + 1).alias("complexity"))


def joined_scores(complexity: DataFrame, cognitive: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The three measures of a function as one row, by place."""
    return complexity.join(cognitive, keys).join(ranges, keys)


def with_quality(functions: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """Every function, with its quality where there is one."""
    return functions.join(quality, keys, "left")


def last_of_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of a key the last in the order, which must be total: a maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_edges(edges: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of equal edges the first in the order."""
    rest = [c for c in edges.columns if c not in keys]
    best = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def annotation_targets(annotations: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """annotations (`path, function`) with `file_index`, the number of files where the path is none's, and `function_index`, -1 where
    the file has no such function. files: `path, file_index`; functions: `path, function, function_index`."""
    n = files.agg(F.count("*").alias("__n"))
    out = annotations.join(files, "path", "left").join(functions, ["path", "function"], "left").join(F.broadcast(n))  # one row
    return out.withColumn("file_index", F.coalesce("file_index", "__n").cast("long")).withColumn("function_index", F.coalesce("function_index", F.lit(-1)).cast("long")).drop("__n")


def visible_annotations(annotations: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """annotations with their `position` in their function, by first line, then last, then the given order."""
    return annotations.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line", "end_line", *order)))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """`path, function, n`: by function, and, with function null, by file."""
    return annotations.rollup("path", "function").agg(F.count("*").alias("n"), F.grouping_id().alias("__g")).filter("__g < 3").select("path", F.when(F.col("__g") == 0, F.col("function")).alias("function"), "n", (F.col("__g") == 1).alias("whole"))


def diff_counts(lines: DataFrame, path_col: str, kind_col: str) -> DataFrame:
    return lines.groupBy(path_col).agg(F.count_if(F.col(kind_col) == "added").alias("added"), F.count_if(F.col(kind_col) == "deleted").alias("deleted"))


def rule_sets(diagnostics: DataFrame, keys: list[str], rule_col: str) -> DataFrame:
    """`keys, rules`: the distinct rules of each, in order."""
    return diagnostics.groupBy(*keys).agg(F.array_sort(F.collect_set(rule_col)).alias("rules"))


def hole_ordinals(holes: DataFrame, keys: list[str], kind_col: str, *order: str) -> DataFrame:
    """Adds `ordinal` and `label`: holes of a kind are numbered from 0 in the order; the label is the kind's first letter and that."""
    at = F.row_number().over(Window.partitionBy(*keys, kind_col).orderBy(*order)) - 1
    return holes.withColumn("ordinal", at).withColumn("label", F.concat(F.upper(F.left(kind_col, F.lit(1))), F.col("ordinal").cast("string")))


def compacted(points: DataFrame, keys: list[str], order: list[str], most: int = 256) -> DataFrame:
    """Of over `most` points every other one, from the first, and the last; fewer stay."""
    w = Window.partitionBy(*keys)
    out = points.withColumn("__at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    return out.filter((F.col("__n") <= most) | (F.col("__at") % 2 == 0) | (F.col("__at") == F.col("__n") - 1)).drop("__at", "__n")


def mean_coverage(members: DataFrame, key_col: str, coverage_col: str) -> DataFrame:
    """`key, support, coverage`: members, and the whole mean of their coverages."""
    return members.groupBy(key_col).agg(F.count("*").alias("support"), F.expr(f"sum({coverage_col}) div greatest(count({coverage_col}), 1)").cast("long").alias("coverage"))


def ranked_candidates(candidates: DataFrame, score_col: str, sites_col: str) -> DataFrame:
    """Adds `rank`: the best score first, then by the lists of sites, element by element, a shorter one before what it begins. sites:
    arrays of structs path, line, id, name."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score_col), F.col(sites_col))))


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Signature groups with `rank`: the best score first, then by key."""
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def ordered_effects(effects: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, effects`: each one's effects (`line, kind, detail`) in order of line, kind and detail."""
    return effects.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "kind", "detail"))).alias("effects"))


def pairs_of_sets(rows: DataFrame, items_col: str, groups_col: str) -> DataFrame:
    """`g, a, b, similarity`: for each group how many rows have both items, a < b. rows hold distinct items in order, and their groups as
    distinct structs of one field `g`; a row with k groups counts k times in each, as a join of all its items and groups does."""
    one = rows.select(F.col(items_col).alias("ts"), F.col(groups_col).alias("gs")).filter(F.size("ts") >= 2)
    first = one.select("ts", "gs", F.posexplode("ts").alias("i", "a"))
    both = first.filter("i < size(ts) - 1").select("gs", "a", F.explode(F.expr("slice(ts, i + 2, size(ts))")).alias("b"))
    counted = both.groupBy("gs", "a", "b").agg(F.count("*").alias("n"))
    return counted.select(F.explode("gs").alias("g"), F.size("gs").alias("k"), "a", "b", "n").groupBy("g.g", "a", "b").agg(F.sum(F.col("k") * F.col("n")).alias("similarity"))


def top_templates(pairs: DataFrame, group_col: str, most: int = 3) -> DataFrame:
    """`group, member, total, rank`: of each group the members most similar to the others in sum; of equal ones the first. pairs: `a, b,
    similarity`."""
    each = pairs.select(group_col, F.explode(F.array("a", "b")).alias("member"), "similarity")
    sums = each.groupBy(group_col, "member").agg(F.sum("similarity").cast("long").alias("total"))
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc("total"), "member"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= most)


def usable_graphs(nodes: DataFrame, graph_col: str, node_col: str) -> DataFrame:
    """`graph, nodes`: graphs with a node at least."""
    return nodes.groupBy(graph_col).agg(F.count(node_col).alias("nodes")).filter("nodes > 0")


def canonical_order(functions: DataFrame, graphs: DataFrame, id_col: str) -> DataFrame:
    """Functions that have a graph, with `position` by path, line and id."""
    kept = functions.join(graphs.select(id_col).distinct(), id_col, "left_semi")
    return kept.withColumn("position", F.row_number().over(Window.orderBy("path", "line", id_col)))


def parameterizable(sites: DataFrame, group_col: str, implements: Column, boilerplate: Column, holes: Column, max_holes: int) -> DataFrame:
    """`group`: groups that no interface forces as a whole, without boilerplate, with few enough different holes."""
    kept = sites.groupBy(group_col).agg(F.bool_and(F.coalesce(implements, F.lit(False))).alias("forced"), F.bool_or(F.coalesce(boilerplate, F.lit(False))).alias("plain"), F.count_distinct(holes).alias("holes"))
    return kept.filter(~F.col("forced") & ~F.col("plain") & (F.col("holes") <= max_holes)).select(group_col, "holes")


def diff_in_functions(functions: DataFrame, lines: DataFrame, key: str, width: int) -> DataFrame:
    """`item, range`: functions (`key, item, start, end`) and the changed lines (`key, line, kind, at`) inside them; a deleted line may
    stand one after the end."""
    ranges = lines.filter(F.col("kind").isin("added", "deleted")).select(key, F.col("line").alias("r"), (F.col("at") - F.when(F.col("kind") == "deleted", 1).otherwise(0)).alias("lo"), F.col("at").alias("hi"))
    return overlap_pairs(functions.withColumnRenamed("item", "i"), ranges, key, width, "i", "r")


def fixes_of_kind(candidates: DataFrame, kind: str, kind_col: str, fix_col: str) -> DataFrame:
    """Candidates that have a fix, of the kind asked for or of `all`."""
    return candidates.filter(F.col(fix_col).isNotNull() & (F.lit(kind == "all") | (F.col(kind_col) == kind)))
