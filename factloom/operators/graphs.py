"""Reachability, slices, chops, components, strongly connected regions, taint, obligations.

Edges are `g, src, dst`: graph, from, to. Closures are loops of equi-joins whose frontier only holds what is new; the edges, once, and
each round are cut at the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def closure(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """`g, seed, node, hops`: what each seed (`g, seed`) reaches, itself at 0 hops. Nodes in blocked (`g, node`) are not entered,
    but a seed is always kept. hops is the shortest distance."""
    edges = edges.select("g", "src", "dst").distinct()
    if blocked is not None:
        edges = edges.join(blocked.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")
    edges = cut(edges.select("g", "src", "dst"))
    seen = cut(seeds.select("g", "seed", F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier, hop = seen, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.join(edges, (frontier["g"] == edges["g"]) & (frontier["node"] == edges["src"])).select(frontier["g"], "seed", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = cut(step.join(seen.select("g", "seed", "node"), ["g", "seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier.select("g", "seed", "node", "hops")))
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"))


def chop(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """`g, node`: nodes on a path from a source to a sink (`g, seed` each)."""
    edges = cut(edges.select("g", "src", "dst").distinct())
    ahead = closure(edges, sources).select("g", "node").distinct()
    behind = closure(reversed_edges(edges), sinks).select("g", "node").distinct()
    return ahead.join(behind, ["g", "node"])


def backward_sizes(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """`g, seed, size`: size of the backward slice of each seed, itself counted."""
    return closure(reversed_edges(edges), seeds, blocked).groupBy("g", "seed").agg(F.count("*").alias("size"))


def thin_edges(edges: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Data edges only."""
    return edges.filter(F.col(kind_col) == "data")


def slice_score(size: F.col) -> F.col:
    return F.least(F.lit(400) + F.lit(10) * size, F.lit(800))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root`: the smallest node of each node's component, by alternating large-star and small-star rounds. Nodes without a
    link to another are left out."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u > v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.filter("u > v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The component of each node of one graph, named by its smallest member; no recursion."""
    order = np.argsort(src, kind="stable")
    dst, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    index, low, on, comp, stack, count = [-1] * n, [0] * n, [False] * n, [-1] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, int(first[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, at = work.pop()
            if at < first[v + 1]:
                work.append((v, at + 1))
                w = int(dst[at])
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, int(first[w])))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                own = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    own.append(w)
                    if w == v:
                        break
                least = min(own)
                for w in own:
                    comp[w] = least
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return np.array(comp, np.int64)


def strong_components(edges: DataFrame, node_type: str = "long") -> DataFrame:
    """`g, node, root, size`: strongly connected regions of each graph; a graph is one function's, so it fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, back = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        m = len(pdf)
        comp = _tarjan(len(nodes), back[:m], back[m:])
        size = np.bincount(comp, minlength=len(nodes))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": nodes, "root": nodes[comp], "size": size[comp]})

    kind = dict(edges.dtypes)["g"]
    return edges.select("g", "src", "dst").groupBy("g").applyInPandas(run, f"g {kind}, node {node_type}, root {node_type}, size long")


def dependence_clusters(edges: DataFrame, node_counts: DataFrame, least: int = 10, share: float = 0.25, node_type: str = "long") -> DataFrame:
    """Strong components of two nodes or more that have `least` nodes or `share` of the graph's (`g, nodes`)."""
    found = strong_components(edges, node_type).select("g", "root", "size").distinct().filter("size >= 2")
    return found.join(node_counts, "g").filter((F.col("size") >= least) | (F.col("size") >= F.col("nodes") * share))


#: Suffixes of callees whose result is tainted, those that clean it, and those that must not be given it (null: any position).
TAINT_SOURCES = ["(*url.Values).Get", "(*http.Request).FormValue", "(*http.Header).Get", "os.Getenv", "io.ReadAll", "ioutil.ReadAll"]
TAINT_SANITIZERS = ["template.HTMLEscapeString", "html.EscapeString", "url.QueryEscape", "url.PathEscape", "strconv.Atoi", "strconv.ParseInt", "strconv.ParseFloat", "strconv.ParseUint"]
TAINT_SINKS = [
    ("(*sql.DB).Exec", 1, "SQL injection"), ("(*sql.DB).Query", 1, "SQL injection"), ("(*sql.DB).QueryRow", 1, "SQL injection"), ("(*sql.Tx).Exec", 1, "SQL injection"),
    ("(*sql.Tx).Query", 1, "SQL injection"), ("(*sql.Conn).Exec", 1, "SQL injection"), ("exec.Command", None, "command injection"), ("exec.CommandContext", None, "command injection"),
    ("(*template.Template).Execute", 2, "XSS"), ("os.Open", 0, "path traversal"), ("os.Create", 0, "path traversal"), ("os.WriteFile", 0, "path traversal"), ("ioutil.WriteFile", 0, "path traversal"),
]


def ends_with_any(col, suffixes: list[str]):
    out = F.lit(False)
    for s in suffixes:
        out = out | F.col(col).endswith(s)
    return F.coalesce(out, F.lit(False))


def taint(edges: DataFrame, sources: DataFrame, sanitizers: DataFrame, sinks: DataFrame) -> DataFrame:
    """`g, sink, source, hops`: sinks (`g, node[, arg]`) that get tainted data, and the nearest source (ties: smallest node).

    Taint spreads along data edges (`g, src, dst[, arg]`) but not into a sanitizer; a source that is tainted stays tainted. A sink
    with an arg counts only edges into that position.
    """
    cleaners = sanitizers.select("g", "node")
    has_arg = "arg" in edges.columns and "arg" in sinks.columns
    edges = cut(edges.select("g", "src", "dst", *(["arg"] if has_arg else [])).distinct())
    reached = closure(edges, sources, cleaners)
    into = edges.select("g", F.col("src").alias("node"), F.col("dst").alias("sink"), *(["arg"] if has_arg else []))
    at = sinks.select("g", F.col("node").alias("sink"), *([F.col("arg").alias("danger")] if has_arg else []))
    hits = into.join(at, ["g", "sink"])
    if has_arg:
        hits = hits.filter("danger is null or danger = arg")
    hits = hits.join(reached, ["g", "node"]).filter("seed <> sink")
    best = hits.groupBy("g", "sink").agg(F.min(F.struct((F.col("hops") + 1).alias("hops"), F.col("seed").alias("source"))).alias("b"))
    return best.select("g", "sink", "b.source", "b.hops")


#: Callee suffix, the release its resource needs, the resource, and whether the receiver is the resource.
OBLIGATIONS = [
    ("os.Open", "Close", "file", False), ("os.Create", "Close", "file", False), ("os.OpenFile", "Close", "file", False), ("os.CreateTemp", "Close", "file", False), ("ioutil.TempFile", "Close", "file", False),
    ("os.Pipe", "Close", "pipe", False), ("sql.Open", "Close", "database", False), ("sql.OpenDB", "Close", "database", False), ("net.Dial", "Close", "connection", False), ("net.Listen", "Close", "listener", False),
    ("Mutex).Lock", "Unlock", "mutex", True), ("RWMutex).Lock", "Unlock", "rwmutex", True), ("RWMutex).RLock", "RUnlock", "rwmutex", True), ("time.NewTicker", "Stop", "ticker", False), ("time.NewTimer", "Stop", "timer", False),
    ("gzip.NewReader", "Close", "gzip reader", False), ("zip.OpenReader", "Close", "zip reader", False), ("http.Get", "Close", "http response body", False), ("http.Post", "Close", "http response body", False), ("http.Client).Do", "Close", "http response body", False),
]


def obligations(nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str, bool]] = OBLIGATIONS, hops: int = 3) -> DataFrame:
    """`g, node, resource`: acquired resources with no deferred release linked to them by data within `hops` edges.

    nodes: `g, node, kind, callee, deferred`; edges: `g, src, dst, kind, arg`. The resource is the call's result, or, where the
    receiver is the resource, what flows into position 0. The first rule whose suffix fits counts.
    """
    spark = nodes.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "pos int, suffix string, release string, resource string, receiver boolean")
    calls = nodes.filter("kind = 'call' and callee is not null")
    names = calls.select("callee").distinct()
    fit = names.join(F.broadcast(table), F.col("callee").endswith(F.col("suffix"))).groupBy("callee").agg(F.min_by(F.struct("release", "resource", "receiver"), "pos").alias("r"))
    acquired = calls.filter(~F.coalesce("deferred", F.lit(False))).join(fit, "callee").select("g", "node", "r.release", "r.resource", "r.receiver")
    data = edges.filter("kind = 'data'")
    holder = data.filter("arg = 0").groupBy("g", F.col("dst").alias("node")).agg(F.min("src").alias("from"))
    acquired = cut(acquired.join(holder, ["g", "node"], "left").withColumn("root", F.when(F.col("receiver"), F.coalesce("from", "node")).otherwise(F.col("node"))).drop("from"))
    reached = closure(data, acquired.select("g", F.col("root").alias("seed")), max_hops=hops).select("g", F.col("seed").alias("root"), F.col("node").alias("via"))
    releases = calls.filter("deferred").select("g", F.col("node").alias("call"), F.substring_index("callee", ".", -1).alias("release"))
    given = data.join(releases, (data["g"] == releases["g"]) & (data["dst"] == releases["call"])).select(data["g"], F.col("src").alias("via"), "release")
    kept = acquired.join(reached, ["g", "root"]).join(given, ["g", "via", "release"]).select("g", "node").distinct()
    return acquired.join(kept, ["g", "node"], "left_anti").select("g", "node", "resource")
