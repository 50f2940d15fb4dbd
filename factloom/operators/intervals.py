"""Intervals, diffs, annotations, order along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(items: DataFrame, ranges: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of items (`key, start, end`) that overlap a range (`key, lo, hi`) of their key, ends included; equal rows each stay.

    An item does if the largest hi of the ranges with lo <= end reaches its start. That is a running maximum along the key, taken
    in cells of `width` so that a hot key is many tasks: within the item's cell row by row, of the cells before as one number each.
    Nothing is multiplied and no pair is made.
    """
    valid = ranges.select(F.col(key).alias("__k"), F.col("lo"), F.col("hi")).filter("lo <= hi and __k is not null")
    cell = lambda c: F.floor(F.col(c) / width)
    rows = items.filter(F.col(key).isNotNull()).select(F.struct(*items.columns).alias("__row"), F.col(key).alias("__k"), F.col("start").alias("__from"), F.col("end").alias("__at"), cell("end").alias("__c"), F.lit(1).alias("__kind"))
    marks = valid.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__k", F.col("hi").alias("__from"), F.col("lo").alias("__at"), cell("lo").alias("__c"), F.lit(0).alias("__kind"))
    hi = F.max(F.when(F.col("__kind") == 0, F.col("__from"))).over(Window.partitionBy("__k", "__c").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    near = rows.union(marks).withColumn("__hi", hi).filter("__kind = 1")
    cells = valid.groupBy("__k", cell("lo").alias("__c")).agg(F.max("hi").alias("__top")).union(rows.select("__k", "__c", F.lit(None).cast(valid.schema["hi"].dataType)).distinct())
    cells = cells.groupBy("__k", "__c").agg(F.max("__top").alias("__top"))
    before = cells.select("__k", "__c", F.max("__top").over(Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)).alias("__before")).filter("__before is not null")
    met = near.join(before, ["__k", "__c"], "left").filter(F.greatest("__hi", "__before") >= F.col("__from"))
    return met.select("__row.*")


def overlap_pairs(items: DataFrame, ranges: DataFrame, key: str, width: int, item_id: str, range_id: str) -> DataFrame:
    """`item, range`: all overlapping pairs; a pair is found in the first cell both share, so none comes twice."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    x = items.select(key, F.col(item_id).alias("item"), "start", "end").withColumn("__c", cell("start", "end"))
    y = ranges.select(key, F.col(range_id).alias("range"), "lo", "hi").withColumn("__c", cell("lo", "hi"))
    first = F.col("__c") == F.floor(F.greatest("start", "lo") / width)
    return x.join(y, [key, "__c"]).filter((F.col("start") <= F.col("hi")) & (F.col("lo") <= F.col("end")) & first).select("item", "range")


def covers(path_a: Column, path_b: Column, line: Column, start: Column, end: Column) -> Column:
    """Whether a marker holds a line; an end of 0 or less is the start; one path may be the tail of the other."""
    same = (path_a == path_b) | F.endswith(path_a, F.concat(F.lit("/"), path_b)) | F.endswith(path_b, F.concat(F.lit("/"), path_a))
    return same & line.between(start, F.when(end <= 0, start).otherwise(end))


_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(lines: DataFrame) -> DataFrame:
    """From `diff, seq, line` of unified diffs: `diff, seq, path, kind, old_line, new_line, text` of added and deleted lines.

    The file is carried forward from its header, positions advance by running counts from the hunk's; a diff is one text, so its
    lines are one window. Without the column `diff` all lines are one diff's, and the result has none either.
    """
    own = ["diff"] if "diff" in lines.columns else []
    lines = lines if own else lines.withColumn("diff", F.lit(0))
    w = Window.partitionBy("diff").orderBy("seq")
    hunk = F.col("line").rlike(_HUNK)
    header = F.col("line").rlike(r"^(\+\+\+|---) ")
    out = lines.withColumn("path", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.col("line"), r"^\+\+\+ (b/)?", "")), True).over(w))
    out = out.withColumn("hunk", F.sum(hunk.cast("int")).over(w))
    out = out.withColumn("old_at", F.last(F.when(hunk, F.regexp_extract("line", _HUNK, 1).try_cast("int")), True).over(w)).withColumn("new_at", F.last(F.when(hunk, F.regexp_extract("line", _HUNK, 3).try_cast("int")), True).over(w))
    kind = F.when(hunk | header, None).when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "deleted").when(F.col("line").startswith(" "), "context")
    out = out.withColumn("kind", kind)
    before = Window.partitionBy("diff", "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    out = out.withColumn("old_line", F.col("old_at") + n("deleted", "context")).withColumn("new_line", F.col("new_at") + n("added", "context"))
    return out.filter("hunk > 0 and kind in ('added', 'deleted')").select(*own, "seq", "path", "kind", "old_line", "new_line", F.expr("substring(line, 2)").alias("text"))


def diff_ranges(lines: DataFrame) -> DataFrame:
    """`diff, path, lo, hi`: the new side's range of each hunk; a hunk that only deletes touches its single line. Without the column
    `diff` all lines are one diff's, and the result has none either."""
    own = ["diff"] if "diff" in lines.columns else []
    lines = lines if own else lines.withColumn("diff", F.lit(0))
    w = Window.partitionBy("diff").orderBy("seq")
    path = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.col("line"), r"^\+\+\+ (b/)?", "")), True).over(w)
    at, n = F.regexp_extract("line", _HUNK, 3).try_cast("int"), F.regexp_extract("line", _HUNK, 4)
    size = F.when(n == "", 1).otherwise(n.try_cast("int"))
    out = lines.withColumn("path", path).filter(F.col("line").rlike(_HUNK) & (F.col("path") != "/dev/null"))
    return out.select(*own, "path", at.alias("lo"), F.greatest(at, at + size - 1).alias("hi"))


def untracked_ranges(files: DataFrame) -> DataFrame:
    """`path, lo, hi` of whole files (`path, content`): line feeds + 1 lines; empty ones have none."""
    return files.filter("content <> ''").select("path", F.lit(1).alias("lo"), F.size(F.split("content", "\n")).alias("hi"))


def override(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """over's rows, and those of base whose key over does not have."""
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over)


def forward_fill(rows: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.last(column, True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def running_total(rows: DataFrame, group: list[str], order: list[str], column: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(column).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(rows: DataFrame, group: list[str], order: list[str], id_col: str) -> DataFrame:
    """Adds `previous, next`, cyclic within the group."""
    w = Window.partitionBy(*group).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag(id_col).over(w), F.last(id_col).over(whole))).withColumn("next", F.coalesce(F.lead(id_col).over(w), F.first(id_col).over(whole)))


def relocate(anchors: DataFrame, targets: DataFrame, name_col: str, text_col: str, id_col: str) -> DataFrame:
    """`anchor, target`: the target of the anchor's name if just one has it, else that of its text if just one has it, else null."""

    def unique(column: str, out: str) -> DataFrame:
        return targets.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(id_col).alias(out)).filter("n = 1").drop("n")

    out = anchors.join(unique(name_col, "by_name"), name_col, "left").join(unique(text_col, "by_text"), text_col, "left")
    return out.select("anchor", F.coalesce("by_name", "by_text").alias("target"))


def half_point(rows: DataFrame, group: list[str], order: list[str], weight_col: str) -> DataFrame:
    """`group, cut`: how many of the first rows come nearest to half the weight; the fewest of equals, one at least."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight_col).over(Window.partitionBy(*group))
    off = F.abs(2 * F.sum(weight_col).over(w) - total)
    ranked = rows.select(*group, off.alias("off"), F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("cut"))
    return ranked.groupBy(*group).agg(F.min_by("cut", F.struct("off", "cut")).alias("cut"))


def diff_base(explicit: str | None, main: str | None, master: str | None, head: str | None) -> str | None:
    """What changes are counted from: the base asked for, else the merge base with main, then master, else the head, else nothing."""
    return explicit or main or master or head or None
