"""Similar multisets, graph colours and kernels, clone groups."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaro_winkler
from ..functions.vectors import cosine, overlap, union_size
from .checkpoint import cut
from .graphs import components


def multisets(items: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """`id, bag, size`: a map of counts for each id."""
    n = items.groupBy(F.col(id_col).alias("id"), F.col(item_col).alias("item")).agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "n")))).alias("bag"), F.sum("n").cast("long").alias("size"))


def similar_names(names: DataFrame, col: str, least: float, block: int = 1024) -> DataFrame:
    """`a, b, similarity`: all pairs a < b of distinct names with Jaro-Winkler of at least `least`.

    One common character may be enough for a low threshold, so no key is safe: names are dealt into parts of about `block`, and
    each pair of parts is a task that compares all its pairs. The work grows with the square of the distinct names.
    """
    distinct = cut(names.select(F.col(col).alias("n")).filter("n is not null").distinct())
    parts = max(1, -(-distinct.count() // block))
    dealt = distinct.withColumn("i", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select("n", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left, right = pdf.loc[pdf["i"] == lo, "n"].tolist(), pdf.loc[pdf["i"] == hi, "n"].tolist()
        found = []
        for x in left:
            for y in right:
                if lo == hi and x >= y:
                    continue
                a, b = (x, y) if x < y else (y, x)
                score = jaro_winkler(a, b)
                if score >= least:
                    found.append((a, b, score))
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    return dealt.groupBy("lo", "hi").applyInPandas(solve, "a string, b string, similarity double")


def similar_multisets(bags: DataFrame, threshold: float) -> DataFrame:
    """`a, b, inter, uni, jaccard, member`: pairs a < b of class representatives with Jaccard of at least the threshold, exact; and, with
    member true, each representative with every other member of its class, whose links are those of the representative.

    Equal bags are one class, named by its smallest id. An empty bag is like another empty one. Tokens are (item, ordinal), rarest first; two bags that are similar
    enough share one of their first size - ceil(t x size) + 1 tokens, so only those meet in an equality join.
    """
    keyed = cut(bags.withColumn("key", F.to_json(F.map_entries("bag"))))
    named = cut(keyed.groupBy("key").agg(F.min("id").alias("id"), F.first("bag").alias("bag"), F.first("size").alias("size")))
    classes = named.drop("key")
    same = keyed.select("key", F.col("id").alias("b"), "size").join(named.select("key", F.col("id").alias("a")), "key").filter("a <> b")
    members = same.select("a", "b", F.col("size").alias("inter"), F.col("size").alias("uni"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("member"))
    tokens = classes.select("id", "size", F.explode("bag").alias("item", "n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("token", F.concat_ws("#", "item", "k"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = tokens.join(df, "token").withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1).select("id", "size", "token")
    x, y = prefix.alias("x"), prefix.alias("y")
    ratio = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(threshold) - 1e-9
    met = x.join(y, F.col("x.token") == F.col("y.token")).filter((F.col("x.id") < F.col("y.id")) & ratio).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = met.join(classes.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a").join(classes.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    out = pairs.select("a", "b", overlap(F.col("bag_a"), F.col("bag_b")).alias("inter"), union_size(F.col("bag_a"), F.col("bag_b")).alias("uni"))
    return out.withColumn("jaccard", F.col("inter") / F.col("uni")).filter(F.col("jaccard") >= threshold).withColumn("member", F.lit(False)).union(members)


def rarest_blocks(items: DataFrame, id_col: str, item_col: str, keep: int = 2, most: int = 1000) -> DataFrame:
    """`a, b`: pairs a < b that share one of their `keep` rarest items; blocks of over `most` members propose no pairs (a common
    item tells nothing; this is the operator's definition, and similar_multisets is the exact way)."""
    own = items.select(F.col(id_col).alias("id"), F.col(item_col).alias("item")).distinct()
    df = own.groupBy("item").agg(F.count("*").alias("df"))
    rare = own.join(df, "item").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))).filter(F.col("r") <= keep)
    fit = rare.groupBy("item").count().filter(F.col("count") <= most).select("item")
    kept = rare.join(fit, "item").select("id", "item")
    return kept.alias("x").join(kept.alias("y"), F.col("x.item") == F.col("y.item")).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def char_vectors(nodes: DataFrame, id_col: str, kind_col: str, kinds: list[str]) -> DataFrame:
    """`id, v`: counts of the given kinds, in their order."""
    return nodes.groupBy(F.col(id_col).alias("id")).agg(F.array(*[F.count_if(F.col(kind_col) == k) for k in kinds]).alias("v"))


def similar_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """`a, b, cosine, member`: pairs a < b of class representatives (equal vectors are one class, named by its smallest id); and, with
    member true, each representative with every other member of its class. A zero vector is like none.

    For vectors of counts, with few dimensions that are not zero. Two vectors meet by a dimension that is at least
    threshold / dimensions of its length in both: the largest of a pair's products is at least their mean, so none is missed.
    """
    classes = cut(vectors.groupBy("v").agg(F.min("id").alias("id")))
    some = vectors.select(F.col("id").alias("b"), "v").join(classes.select(F.col("id").alias("a"), "v"), "v").filter("a <> b").filter(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    places = F.arrays_zip(F.col("v").alias("x"), F.sequence(F.lit(1), F.size("v")).alias("d"))
    wide = F.filter(places, lambda e: F.abs(e["x"].cast("double")) >= norm * (F.lit(threshold) / F.size("v")) * (1 - 1e-9))
    live = classes.filter(norm > 0).select("id", "v", F.explode(F.transform(wide, lambda e: e["d"])).alias("d"))
    met = live.alias("x").join(live.alias("y"), F.col("x.d") == F.col("y.d")).filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.v").alias("va"), F.col("y.v").alias("vb")).dropDuplicates(["a", "b"])
    return met.withColumn("cosine", cosine(F.col("va"), F.col("vb"))).filter(F.col("cosine") >= threshold).select("a", "b", "cosine", F.lit(False).alias("member")).union(some.select("a", "b", F.lit(1.0), F.lit(True)))


def wl_histograms(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """`g, round, color, n`: colours of nodes (`g, node, label`) refined over edges (`g, src, dst, tag`): each round hashes the
    colour with the sorted colours of what flows in, then of what it flows to."""
    colors = nodes.select("g", F.col("node").alias("src"), F.xxhash64("label").alias("color"))
    ways = edges.select("g", "src", "dst", "tag", F.lit(True).alias("ahead")).union(edges.select("g", "dst", "src", "tag", F.lit(False)))
    parts = []
    for r in range(rounds + 1):
        parts.append(colors.groupBy("g", "color").agg(F.count("*").alias("n")).withColumn("round", F.lit(r)))
        if r == rounds:
            break
        sent = ways.join(colors, ["g", "src"]).groupBy("g", "dst").agg(*[F.sort_array(F.collect_list(F.when(F.col("ahead") == w, F.xxhash64("tag", "color")))).alias(n) for n, w in (("ins", True), ("outs", False))])
        none = F.array().cast("array<bigint>")
        colors = colors.join(sent, (colors["g"] == sent["g"]) & (colors["src"] == sent["dst"]), "left").select(colors["g"], "src", F.xxhash64(F.xxhash64("color", F.lit(1), F.coalesce("ins", none)), F.lit(2), F.coalesce("outs", none)).alias("color"))
        colors = cut(colors)
    return reduce(DataFrame.unionByName, parts)


def graph_rounds(edges: DataFrame, nodes: DataFrame, most: int = 400) -> DataFrame:
    """`g, rounds`: diameter + 1 within 1 and 4; graphs of over `most` nodes take 4. A graph is one function's, so it fits a task."""
    kind = dict(nodes.dtypes)["g"]
    rows = nodes.select("g", F.col("node").alias("src"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("dst")).union(edges.select("g", "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, back = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].dropna().to_numpy()]), return_inverse=True)
        n = len(names)
        if n > most:
            return pd.DataFrame({"g": pdf["g"].iloc[[0]], "rounds": 4})
        near: list[set] = [set() for _ in range(n)]
        src = back[: len(pdf)][pdf["dst"].notna().to_numpy()]
        for a, b in zip(src, back[len(pdf) :]):
            near[a].add(int(b))
            near[b].add(int(a))
        far = 0
        for s in range(n):
            seen, level, d = {s}, {s}, 0
            while level:
                level = {y for x in level for y in near[x]} - seen
                seen |= level
                d += bool(level)
            far = max(far, d)
        return pd.DataFrame({"g": pdf["g"].iloc[[0]], "rounds": min(max(far + 1, 1), 4)})

    return rows.groupBy("g").applyInPandas(run, f"g {kind}, rounds int")


def wl_similarity(histograms: DataFrame, pairs: DataFrame, rounds: DataFrame) -> DataFrame:
    """`a, b, similarity`: in thousandths. h is the smaller number of rounds; round i weighs h - i; the sum of smaller counts over
    the larger graph's size."""
    size = histograms.filter("round = 0").groupBy("g").agg(F.sum("n").alias("size"))
    p = pairs.select("a", "b").join(rounds.select(F.col("g").alias("a"), F.col("rounds").alias("ra")), "a").join(rounds.select(F.col("g").alias("b"), F.col("rounds").alias("rb")), "b")
    p = p.join(size.select(F.col("g").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("g").alias("b"), F.col("size").alias("sb")), "b").withColumn("h", F.least("ra", "rb"))
    x = histograms.select(F.col("g").alias("a"), "round", "color", F.col("n").alias("na"))
    y = histograms.select(F.col("g").alias("b"), "round", "color", F.col("n").alias("nb"))
    common = p.join(x, "a").filter("round < h").join(y, ["b", "round", "color"]).groupBy("a", "b").agg(F.sum((F.col("h") - F.col("round")) * F.least("na", "nb")).alias("common"))
    out = p.join(common, ["a", "b"], "left")
    return out.select("a", "b", F.expr("cast(1000 * coalesce(common, 0) div (h * (h + 1) div 2 * greatest(sa, sb)) as bigint)").alias("similarity"))


def wl_at_least(histograms: DataFrame, pairs: DataFrame, rounds: DataFrame, limit: int) -> DataFrame:
    """`a, b`: pairs whose similarity is at least the limit, in thousandths (P6). No round can have more in common than the smaller
    graph has nodes, so pairs whose sizes rule it out never meet the histograms."""
    size = histograms.filter("round = 0").groupBy("g").agg(F.sum("n").alias("size"))
    p = pairs.select("a", "b").join(size.select(F.col("g").alias("a"), F.col("size").alias("x")), "a").join(size.select(F.col("g").alias("b"), F.col("size").alias("y")), "b")
    able = p.filter(F.floor(1000 * F.least("x", "y") / F.greatest("x", "y")) >= limit).select("a", "b")
    return wl_similarity(histograms, able, rounds).filter(F.col("similarity") >= limit).select("a", "b")


def hyperplane_buckets(vectors: DataFrame, dim: int, tables: int = 16, planes: int = 4, seed: int = 42) -> DataFrame:
    """`id, t, bucket`: signs of products with seeded random planes, `planes` bits a table."""
    normals = np.random.default_rng(seed).normal(size=(tables * planes, dim))

    def run(batches):
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
            bits = (v @ normals.T >= 0).reshape(len(pdf), tables, planes)
            key = (bits << np.arange(planes)).sum(axis=2)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), tables), "t": np.tile(np.arange(tables, dtype=np.int32), len(pdf)), "bucket": key.ravel().astype(np.int32)})

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "v").mapInPandas(run, f"id {kind}, t int, bucket int")


def forest(v: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Rows of length 1 to the links of a spanning forest of the graph that joins what has a cosine of at least the threshold."""
    label, a, b = np.arange(len(v)), [], []
    for at in range(0, len(v), 512):
        near = v[at : at + 512] @ v.T >= threshold
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            other = np.flatnonzero(near[i])
            roots, first = np.unique(label[other], return_index=True)
            new = roots != label[at + i]
            if new.any():
                a += [at + i] * int(new.sum())
                b += other[first[new]].tolist()
                label[np.isin(label, roots[new])] = label[at + i]
    return a, b


def clone_groups(vectors: DataFrame, dim: int, threshold: float, tables: int | None = None, planes: int | None = None, seed: int = 42, recall: float = 0.95, most: int = 8192) -> DataFrame:
    """`id, root`: members of groups of two or more, linked where two vectors share a bucket and their cosine is enough.

    Planes grow with the logarithm of the rows, so that a bucket of evenly spread vectors stays small; tables are as many as find a pair
    at the threshold with probability `recall`, 16 at least. Buckets of over `most` rows, as copies make them, are dealt out as pairs of
    parts. A task gives a spanning forest, never all pairs. Zero vectors are like none.
    """
    planes = planes or max(4, math.ceil(math.log2(max(vectors.count(), 1) / (most / 4))))
    alike = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    tables = tables or max(16, math.ceil(math.log(1 - recall) / math.log(1 - min(alike**planes, 1 - 1e-12))))
    buckets = cut(hyperplane_buckets(vectors, dim, tables, planes, seed))
    sizes = buckets.groupBy("t", "bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") * 2 / F.lit(most))).cast("int")).drop("n")
    keyed = buckets.join(sizes, ["t", "bucket"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    keyed = keyed.select("t", "bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "id").join(vectors.select("id", "v"), "id")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        ids, v = pdf["id"].to_numpy(), v / np.maximum(norm, 1e-300)
        a, b = forest(v, threshold)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    kind = dict(vectors.dtypes)["id"]
    links = keyed.groupBy("t", "bucket", "lo", "hi").applyInPandas(solve, f"a {kind}, b {kind}").distinct()
    return components(links).select(F.col("node").alias("id"), "root")


def equal_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`root, members`: groups of two or more ids whose texts are equal but for case and runs of white space."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower(text_col), r"\s+", " ")), 256)
    return texts.filter(F.col(text_col).isNotNull()).groupBy(key.alias("key")).agg(F.min(id_col).alias("root"), F.count("*").alias("members")).filter("members >= 2").select("root", "members")


def structure_changes(old: DataFrame, new: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """`id, change`: cosmetic where the structure hash is the same, else structural; added or removed where one side lacks it."""
    x, y = old.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h_old")), new.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h_new"))
    change = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") == F.col("h_new"), "cosmetic").otherwise("structural")
    return x.join(y, "id", "full_outer").select("id", change.alias("change"))
