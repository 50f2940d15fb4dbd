"""Clone detection on dependence graphs: candidate pairs, kernels, groups, greedy templates, alignment, holes.

Graphs are `g, node, label[, kind]` and `g, src, dst, tag[, kind]`, one function each.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bit_names, has_receiver, names_at_least
from ..functions.vectors import cosine, overlap, union_size
from .checkpoint import cut
from .graphs import components
from .groups import effect_union
from .similarity import graph_rounds, hyperplane_buckets, wl_histograms, wl_similarity


def mineable(nodes: DataFrame, least_nodes: int = 4, least_calls: int = 1) -> DataFrame:
    """`g, size`: graphs with enough nodes and calls."""
    return nodes.groupBy("g").agg(F.count("*").alias("size"), F.count_if(F.col("kind") == "call").alias("calls")).filter((F.col("size") >= least_nodes) & (F.col("calls") >= least_calls)).select("g", "size")


def comparable(pairs: DataFrame, size_a: str, size_b: str, ratio: int = 2) -> DataFrame:
    """Pairs of which the larger has at most `ratio` times the smaller's nodes."""
    return pairs.filter(F.greatest(size_a, size_b) <= ratio * F.least(size_a, size_b))


def candidate_pairs(profiles: DataFrame, blocks: DataFrame, jaccard: float = 0.8, least_cosine: float = 0.9, winkler: float = 0.5, ratio: int = 2) -> DataFrame:
    """`a, b`: pairs of `blocks` (`a, b`) whose sizes differ at most by `ratio` and that are similar in their syntax kinds, or in
    their counts and names. profiles: `g, size, kinds map, v array, name`; an empty name passes the name test."""
    side = lambda s: profiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("g", "size", "kinds", "v", "name")])
    p = comparable(blocks.join(side("a"), F.col("a") == F.col("g_a")).join(side("b"), F.col("b") == F.col("g_b")), "size_a", "size_b", ratio)
    kinds = (union_size(F.col("kinds_a"), F.col("kinds_b")) > 0) & (overlap(F.col("kinds_a"), F.col("kinds_b")) >= jaccard * union_size(F.col("kinds_a"), F.col("kinds_b")))
    nameless = (F.col("name_a") == "") | (F.col("name_b") == "")
    close = cosine(F.col("v_a").cast("array<double>"), F.col("v_b").cast("array<double>")) >= least_cosine
    sure = p.filter(kinds).select("a", "b")
    rest = p.filter(~kinds & close).select("a", "b", "name_a", "name_b")
    return sure.union(rest.filter(nameless).select("a", "b")).union(names_at_least(rest.filter(~nameless), "name_a", "name_b", winkler).select("a", "b"))


def weighted_similarity(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, similarity`: 12 parts of the control view (labels by kind only), 4 of the data view, in sixteenths."""
    views = []
    for kind, label in (("ctrl", "kind"), ("data", "label")):
        own = edges.filter(F.col("kind") == kind)
        n = nodes.select("g", "node", F.col(label).alias("label"))
        views.append(wl_similarity(wl_histograms(n, own), pairs, graph_rounds(own, n)).withColumnRenamed("similarity", kind))
    return views[0].join(views[1], ["a", "b"]).select("a", "b", F.expr("cast((12 * ctrl + 4 * data) div 16 as bigint)").alias("similarity"))


def _ball_counts(pdf: pd.DataFrame) -> Counter:
    label = dict(pdf[pdf["dst"].isna()][["src", "label"]].itertuples(index=False))
    near, into = defaultdict(set), defaultdict(list)
    for s, d, tag in pdf[pdf["dst"].notna()][["src", "dst", "label"]].itertuples(index=False):
        near[s].add(d)
        near[d].add(s)
        into[d].append((tag, s))
    out: Counter = Counter()
    for v in label:
        ball = {v}
        for k in (1, 2):
            ball |= {y for x in ball for y in near[x]}
            for x in ball:
                ins = sorted((t, label[s]) for t, s in into[x] if s in ball)
                out[xxhash.xxh64_intdigest(repr((k, label[x], ins)).encode()) >> 1] += 1
    return out


def neighbourhood_histograms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`g, round, color, n` with round 0: colours after one refinement within the balls of 1 and 2 hops around every node, pooled.
    Many small differences move it less than the flat kernel."""
    kinds = dict(nodes.dtypes)
    rows = nodes.select("g", F.col("node").alias("src"), F.lit(None).cast(kinds["node"]).alias("dst"), "label").union(edges.select("g", "src", "dst", "tag"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _ball_counts(pdf)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "round": 0, "color": list(c), "n": list(c.values())})

    return rows.groupBy("g").applyInPandas(run, f"g {kinds['g']}, round int, color long, n long")


def neighbourhood_similarity(histograms: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, similarity`: common colours over the larger number of them, in thousandths."""
    size = histograms.groupBy("g").agg(F.sum("n").alias("size"))
    x, y = histograms.select(F.col("g").alias("a"), "color", F.col("n").alias("na")), histograms.select(F.col("g").alias("b"), "color", F.col("n").alias("nb"))
    common = pairs.select("a", "b").join(x, "a").join(y, ["b", "color"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("common"))
    p = pairs.select("a", "b").join(size.select(F.col("g").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("g").alias("b"), F.col("size").alias("sb")), "b")
    return p.join(common, ["a", "b"], "left").select("a", "b", F.expr("cast(1000 * coalesce(common, 0) div greatest(sa, sb) as bigint)").alias("similarity"))


def folded_vectors(histograms: DataFrame, rounds: int = 4, width: int = 128) -> DataFrame:
    """`id, v`: colours folded into `width` slots a round, round r weighing rounds - r."""
    slots = histograms.filter(F.col("round") < rounds).groupBy(F.col("g").alias("id"), (F.col("round") * width + F.pmod("color", F.lit(width))).cast("int").alias("slot")).agg(F.sum(F.col("n") * (rounds - F.col("round"))).cast("double").alias("w"))
    m = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(rounds * width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def clone_report(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, least: int = 900, tables: int = 16, planes: int = 4) -> DataFrame:
    """`g, root`: groups of two or more, linked where a candidate pair shares a bucket of its folded colours and its kernel is enough."""
    histograms = cut(wl_histograms(nodes, edges))
    rounds = graph_rounds(edges, nodes)
    buckets = hyperplane_buckets(folded_vectors(histograms), 512, tables, planes)
    x, y = buckets.select(F.col("id").alias("a"), "t", "bucket"), buckets.select(F.col("id").alias("b"), "t", "bucket")
    met = pairs.select("a", "b").join(x, "a").join(y, ["b", "t", "bucket"]).select("a", "b").distinct()
    links = wl_similarity(histograms, cut(met), rounds).filter(F.col("similarity") >= least)
    return components(links).select(F.col("node").alias("g"), "root")


def inconsistent(groups: DataFrame, similarities: DataFrame, low: int = 900, high: int = 950) -> DataFrame:
    """`root`: clone groups (`g, root`) in which some pair (`a, b, similarity`) is close, but not closer than `high`."""
    a, b = groups.select(F.col("g").alias("a"), "root"), groups.select(F.col("g").alias("b"), F.col("root").alias("other"))
    hit = similarities.filter((F.col("similarity") >= low) & (F.col("similarity") < high)).join(a, "a").join(b, "b").filter("root = other")
    return hit.select("root").distinct()


def template_clusters(pairs: DataFrame, order: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 600, coverage: int = 600, tries: int = 3) -> DataFrame:
    """`template, g, coverage`: greedy groups over similar pairs (`a, b, similarity`, all pairs compared), the template with 1000 itself.

    The seed is the free graph with the most free neighbours, the first in `order` (`g, position`) of equals. Of it and these, the
    `tries` members of the largest similarity in sum are tried as templates: who aligns with one to `coverage` thousandths joins; the
    one that most join counts, then the largest coverage in sum. Who joined retires, or, if none did, the seed alone.

    Choices in one connected component don't touch another, so each component is one task, with its graphs.
    """
    near = cut(pairs.filter(F.col("similarity") >= least).select("a", "b", "similarity"))
    roots = cut(components(near))
    links = near.join(roots, F.col("a") == F.col("node")).select(F.col("root").alias("part"), "a", "b", "similarity")
    graphs = roots.join(order, F.col("node") == F.col("g")).join(_graph_lists(nodes, edges), "g").select("root", "g", "position", "nodes", "edges")
    kind = dict(order.dtypes)["g"]

    def run(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(own["g"], own["position"]))
        graph = {r.g: _plain_graph(r.nodes, r.edges) for r in own.itertuples(index=False)}
        near, like = defaultdict(set), {}
        for a, b, s in pdf[["a", "b", "similarity"]].itertuples(index=False):
            near[a].add(b)
            near[b].add(a)
            like[a, b] = like[b, a] = s
        cover = {}

        def covered(t, g) -> int:
            if (t, g) not in cover:
                cover[t, g] = 1000 * len(align_pair(*graph[t][:2], *graph[g][:2])) // max(len(graph[t][0]), len(graph[g][0]), 1)
            return cover[t, g]

        free, out = set(near), []
        while free:
            seed = min(free, key=lambda v: (-len(near[v] & free), place[v]))
            group = sorted((near[seed] & free) | {seed}, key=place.get)
            total = {v: sum(like.get((v, w), 0) for w in group) for v in group}
            best, found = (0, 0), []
            for t in sorted(group, key=lambda v: (-total[v], place[v]))[:tries]:
                joined = [(g, covered(t, g)) for g in group if g != t and covered(t, g) >= coverage]
                if (len(joined), sum(c for _, c in joined)) > best:
                    best, found = (len(joined), sum(c for _, c in joined)), [(t, t, 1000), *((t, g, c) for g, c in joined)]
            out += found
            free -= {g for _, g, _ in found} or {seed}
        return pd.DataFrame(out, columns=["template", "g", "coverage"])

    return graphs.groupBy("root").cogroup(links.groupBy("part")).applyInPandas(run, f"template {kind}, g {kind}, coverage long")


def align_pair(labels_a: dict, edges_a: set, labels_b: dict, edges_b: set, rounds: int = 3) -> list[tuple]:
    """A one-to-one matching of the nodes of two graphs: those whose colours are unique on both sides, from the most refined round
    down, then neighbours of matched nodes along equal edges with equal labels, then equal labels in order."""

    def refine(labels, edges):
        levels = [dict(labels)]
        for _ in range(rounds):
            c = levels[-1]
            levels.append({v: (c[v], tuple(sorted(repr((t, c[s])) for s, d, t in edges if d == v)), tuple(sorted(repr((t, c[d])) for s, d, t in edges if s == v))) for v in c})
        return levels

    match, taken = {}, set()

    def put(a, b):
        match[a] = b
        taken.add(b)

    for ca, cb in zip(reversed(refine(labels_a, edges_a)), reversed(refine(labels_b, edges_b))):
        na, nb = Counter(map(repr, ca.values())), Counter(map(repr, cb.values()))
        where = {repr(c): v for v, c in cb.items()}
        for v in sorted(ca):
            key = repr(ca[v])
            if v not in match and na[key] == 1 and nb[key] == 1 and where[key] not in taken:
                put(v, where[key])
    grown = True
    while grown:
        grown = False
        for s, d, t in sorted(edges_a):
            for old, new, pick in ((s, d, lambda e: e[1]), (d, s, lambda e: e[0])):
                if old in match and new not in match:
                    options = sorted(pick(e) for e in edges_b if e[2] == t and (e[0] if new == d else e[1]) == match[old] and pick(e) not in taken and labels_b[pick(e)] == labels_a[new])
                    if options:
                        put(new, options[0])
                        grown = True
    rest = defaultdict(list)
    for v in sorted(set(labels_b) - taken):
        rest[labels_b[v]].append(v)
    for v in sorted(set(labels_a) - set(match)):
        if rest[labels_a[v]]:
            put(v, rest[labels_a[v]].pop(0))
    return sorted(match.items())


def _graph_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`g, nodes, edges`: each graph as one row."""
    n = nodes.groupBy("g").agg(F.collect_list(F.struct("node", "label")).alias("nodes"))
    return n.join(edges.groupBy("g").agg(F.collect_list(F.struct("src", "dst", "tag")).alias("edges")), "g", "left")


def _plain_graph(nodes, edges) -> tuple[dict, set]:
    return {x["node"]: x["label"] for x in nodes}, {(x["src"], x["dst"], x["tag"]) for x in (edges if edges is not None else ())}


def matched_nodes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, node_a, node_b`: the matching of every pair of graphs, as align_pair finds it."""
    whole = _graph_lists(nodes, edges)
    side = lambda s: whole.select(F.col("g").alias(s), F.col("nodes").alias(f"n{s}"), F.col("edges").alias(f"e{s}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    kinds = dict(nodes.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                out += [(r.a, r.b, x, y) for x, y in align_pair(*_plain_graph(r.na, r.ea), *_plain_graph(r.nb, r.eb))]
            yield pd.DataFrame(out, columns=["a", "b", "node_a", "node_b"])

    return rows.mapInPandas(run, f"a {kinds['g']}, b {kinds['g']}, node_a {kinds['node']}, node_b {kinds['node']}")


def alignments(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`a, b, matched, coverage, holes`: for each pair the matched nodes, their share of the larger graph in thousandths, and how
    many matched nodes differ in `detail`."""
    met = matched_nodes(nodes, edges, pairs)
    side = lambda s: nodes.select(F.col("g").alias(s), F.col("node").alias(f"node_{s}"), F.col("detail").alias(f"d_{s}"))
    met = met.join(side("a"), ["a", "node_a"]).join(side("b"), ["b", "node_b"]).groupBy("a", "b").agg(F.count("*").alias("matched"), F.count_if(~F.col("d_a").eqNullSafe(F.col("d_b"))).alias("holes"))
    size = nodes.groupBy("g").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").join(size.select(F.col("g").alias("a"), F.col("n").alias("sa")), "a").join(size.select(F.col("g").alias("b"), F.col("n").alias("sb")), "b")
    full = p.join(met, ["a", "b"], "left").fillna(0, ["matched", "holes"])
    return full.select("a", "b", "matched", F.expr("1000 * matched div greatest(sa, sb)").alias("coverage"), "holes")


#: Kinds of holes in their order, and the letter of each one's variables.
HOLES = {"type": "T", "method": "M", "free_fn": "F", "literal": "L", "field": "D", "op": "O", "effect": "X"}
#: Names of effect bits, from the lowest.
EFFECT_BITS = ["mutates", "io", "network", "global", "unsafe", "time", "random", "panic", "unknown"]


def holes(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """`a, b, var, kind, x, y, site, sites`: what matched nodes (`a, b, node_a, node_b`) differ in (P17). nodes: `g, node, kind, callee,
    detail, type_class, effects`.

    Calls, and functions as values, differ in the callee if both have one; literals without a callee and fields in their text; operators
    if both are comparisons; calls in their effects; all in their type class if both have one. Equal differences are one hole: it
    stands at the first node of a, and in the order of that and of the kind, holes of a kind are numbered from 0.
    """
    fields = ("kind", "callee", "detail", "type_class", "effects")
    side = lambda s: nodes.select(F.col("g").alias(s), F.col("node").alias(f"node_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in fields])
    m = matched.join(side("a"), ["a", "node_a"]).join(side("b"), ["b", "node_b"])
    a, b = ((lambda c, s=s: F.coalesce(F.col(f"{c}_{s}"), F.lit(""))) for s in "ab")
    one = lambda kind, x, y, when: F.when(when & (x != y), F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y")))
    both = lambda c: (a(c) != "") & (b(c) != "")
    kind = F.col("kind_a")
    method = (kind == "call") & (has_receiver(a("callee")) | has_receiver(b("callee")))
    compared = a("detail").startswith("cmp:") & b("detail").startswith("cmp:")
    cut4 = lambda c: F.substring(c, 5, 1 << 20)
    bits = lambda s: bit_names(F.coalesce(F.col(f"effects_{s}"), F.lit(0)), EFFECT_BITS)
    found = F.array_compact(
        F.array(
            one("method", a("callee"), b("callee"), both("callee") & method), one("free_fn", a("callee"), b("callee"), both("callee") & ~method), one("literal", a("detail"), b("detail"), (kind == "lit") & (a("callee") == "")),
            one("field", a("detail"), b("detail"), kind == "field"), one("op", cut4(a("detail")), cut4(b("detail")), (kind == "op") & compared), one("effect", bits("a"), bits("b"), (kind == "call") & (F.col("kind_b") == "call")),
            one("type", a("type_class"), b("type_class"), both("type_class")),
        )
    )
    rows = m.select("a", "b", "node_a", "node_b", F.explode(found).alias("h")).groupBy("a", "b", "h").agg(F.min("node_a").alias("site"), F.array_sort(F.collect_list(F.struct("node_a", "node_b"))).alias("sites"))
    return _numbered(rows.select("a", "b", "h.kind", "h.x", "h.y", "site", "sites"), ["a", "b"], "x", "y")


def _numbered(rows: DataFrame, group: list[str], *ties: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, HOLES)), F.col("kind"))
    letter = F.create_map(*[F.lit(v) for kv in HOLES.items() for v in kv])[F.col("kind")]
    at = F.row_number().over(Window.partitionBy(*group, "kind").orderBy("site", rank, *ties)) - 1
    return rows.withColumn("var", F.concat(letter, at.cast("string")))


def template_columns(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """`template, var, kind, g, value`: what stands at each hole of a template in each of its members, itself included. clusters: as
    template_clusters gives them; found: holes of (template, member). A member without the hole has the template's value."""
    at = found.groupBy(F.col("a").alias("template"), "kind", "x").agg(F.min("site").alias("site"))
    named = _numbered(at, ["template"], "x")
    own = found.groupBy(F.col("a").alias("template"), F.col("b").alias("g"), "kind", "x").agg(F.min_by("y", F.struct("site", "y")).alias("y"))
    full = clusters.select("template", "g").join(named, "template").join(own, ["template", "g", "kind", "x"], "left")
    return full.select("template", "var", "kind", "g", F.coalesce("y", "x").alias("value"))


def clone_clusters(groups: DataFrame, effects: DataFrame, nodes: DataFrame, edges: DataFrame, coverage: int = 600) -> DataFrame:
    """`template, g, coverage`: clone groups (`g, root`) whose functions all have the same effects (`g, bits`), as clusters of those that
    align with the group's first (P21)."""
    same = effect_union(groups.join(effects, "g"), "root", "g", "bits").select("root")
    own = groups.join(same, "root")
    near = alignments(nodes, edges, own.filter("g <> root").select(F.col("root").alias("a"), F.col("g").alias("b"))).filter(F.col("coverage") >= coverage)
    joined = near.select(F.col("a").alias("template"), F.col("b").alias("g"), F.col("coverage").cast("long").alias("coverage"))
    return joined.union(joined.select("template", F.col("template").alias("g"), F.lit(1000).cast("long")).distinct())
