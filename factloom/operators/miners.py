"""The builders of all findings, by kind, and the report they make together (2.9, U1, U2, O1, O8, F2, D8, P13, M4-M17)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import beliefs as bl
from . import candidates as cd
from . import graphs, groups, rules
from .report import best_first, union_ranked


@dataclass(frozen=True)
class Miner:
    """build(tables): candidates `kind, score, observation, sites`, from the named tables."""

    kind: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


MINERS: dict[str, Miner] = {}


def miner(kind: str, *needs: str):
    """Registers a builder of candidates; its arguments are the tables that it needs, in order. A kind that is there is replaced."""

    def put(build):
        MINERS[kind] = Miner(kind, needs, build)
        return build

    return put


def mine(tables: dict[str, DataFrame], kinds: list[str] | None = None, least: int = 0, top: int | None = None) -> DataFrame:
    """All candidates of the kinds asked for whose tables are there, of at least the score `least`, best first, `top` at most."""
    chosen = [m for m in MINERS.values() if (kinds is None or m.kind in kinds) and all(n in tables for n in m.needs)]
    if not chosen:
        raise ValueError("no miner has all its tables")
    found = union_ranked({m.kind: m.build(*[tables[n] for n in m.needs]).drop("kind") for m in chosen})
    ranked = best_first(found.filter(F.col("score") >= least).select("kind", "score", "observation", "sites"))
    return ranked if top is None else ranked.limit(top)


def _of_function(kind: str, findings: DataFrame, facts: DataFrame, observation, group: list[str]) -> DataFrame:
    return cd.candidates(kind, cd.located(findings, facts), observation, ["id", *group])


# facts: `id, path, line, name`. calls: `id, callee`. sites: `id, line, callee, checked`. params: `id, name, type`. writes: `id, type`.
# graph_nodes, graph_edges: as graphs.obligations reads them, g being the function's id. hits: `id, kind, line, detail, suppressed`.


@miner("mined_rule", "calls", "facts")
def mined_rules(calls: DataFrame, facts: DataFrame) -> DataFrame:
    sets = rules.call_sets(calls, "id", "callee")
    baskets = rules.Baskets(sets)
    one = rules.violations(sets, baskets.single()).select("id", F.concat(F.lit("calls "), "a", F.lit(" without "), "b").alias("o"))
    two = rules.double_violations(sets, baskets.double()).select("id", F.concat(F.lit("calls "), "a", F.lit(" and "), "b", F.lit(" without "), "c").alias("o"))
    return _of_function("mined_rule", one.union(two), facts, F.col("o"), ["o"])


@miner("alattin_rule", "calls", "facts")
def disjunctive_rules(calls: DataFrame, facts: DataFrame) -> DataFrame:
    sets = rules.call_sets(calls, "id", "callee")
    found = rules.disjunctive_violations(sets, rules.Baskets(sets).disjunctive())
    return _of_function("alattin_rule", found, facts, F.concat(F.lit("calls "), "a", F.lit(" without "), "b", F.lit(" or "), "c"), ["a", "b", "c"])


@miner("deviant_behavior", "sites", "facts")
def unchecked_sites(sites: DataFrame, facts: DataFrame) -> DataFrame:
    found = bl.belief_violations(sites, "callee", "checked").select("id", F.col("line").alias("at"), "callee")
    return _of_function("deviant_behavior", found, facts, F.concat(F.lit("result of "), "callee", F.lit(" is not checked in line "), F.col("at").cast("string")), ["callee", "at"])


@miner("obligation", "graph_nodes", "graph_edges", "facts")
def kept_resources(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    found = graphs.obligations(nodes, edges).select(F.col("g").alias("id"), "node", "resource")
    return _of_function("obligation", found, facts, F.concat("resource", F.lit(" is not released")), ["node", "resource"])


@miner("taint_flow", "graph_nodes", "graph_edges", "facts")
def tainted_sinks(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Sinks by the suffixes of graphs.TAINT_SINKS; where two fit, the first."""
    calls = nodes.filter("kind = 'call' and callee is not null").select("g", "node", "callee")
    sources = calls.filter(graphs.ends_with_any("callee", graphs.TAINT_SOURCES)).select("g", F.col("node").alias("seed"))
    clean = calls.filter(graphs.ends_with_any("callee", graphs.TAINT_SANITIZERS)).select("g", "node")
    table = nodes.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(graphs.TAINT_SINKS)], "pos int, suffix string, arg int, risk string")
    fit = calls.select("callee").distinct().join(F.broadcast(table), F.col("callee").endswith(F.col("suffix"))).groupBy("callee").agg(F.min_by(F.struct("arg", "risk"), "pos").alias("r"))
    sinks = calls.join(fit, "callee").select("g", "node", "r.arg", "r.risk")
    found = graphs.taint(edges.filter("kind = 'data'"), sources, clean, sinks.select("g", "node", "arg"))
    named = found.join(sinks.select("g", F.col("node").alias("sink"), "risk"), ["g", "sink"]).select(F.col("g").alias("id"), "sink", "risk")
    return _of_function("taint_flow", named, facts, F.concat(F.lit("tainted data: "), "risk"), ["sink", "risk"])


@miner("dependence_cluster", "graph_nodes", "graph_edges", "facts")
def tangles(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["src"]
    found = graphs.dependence_clusters(edges, nodes.groupBy("g").agg(F.count("*").alias("nodes")), node_type=kind).select(F.col("g").alias("id"), F.col("root").alias("first"), "size")
    return _of_function("dependence_cluster", found, facts, F.format_string("%d statements depend on each other", "size"), ["first", "size"])


@miner("barrier_slice", "graph_nodes", "graph_edges", "facts")
def wide_slices(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Returns that depend on 20 nodes or more, nodes of the kind `try` being barriers."""
    return _slices("barrier_slice", edges, nodes, facts, nodes.filter("kind = 'try'").select("g", "node"), 20)


@miner("thin_slice", "graph_nodes", "graph_edges", "facts")
def thin_slices(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Returns whose data comes from 10 nodes or more."""
    return _slices("thin_slice", graphs.thin_edges(edges), nodes, facts, None, 10)


def _slices(kind: str, edges: DataFrame, nodes: DataFrame, facts: DataFrame, blocked: DataFrame | None, least: int) -> DataFrame:
    seeds = nodes.filter("kind = 'return'").select("g", F.col("node").alias("seed"))
    found = graphs.backward_sizes(edges, seeds, blocked).filter(F.col("size") >= least).select(F.col("g").alias("id"), F.col("seed").alias("from"), "size")
    rows = cd.located(found, facts)
    return cd.candidates(kind, rows, F.format_string("a return depends on %d nodes", "size"), ["id", "from"], graphs.slice_score(F.col("size")))


@miner("chop", "graph_nodes", "graph_edges", "facts")
def chops(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Functions in which 20 nodes or more lie between parameters and returns."""
    seeds = lambda kind: nodes.filter(F.col("kind") == kind).select("g", F.col("node").alias("seed"))
    found = graphs.chop(edges, seeds("param"), seeds("return")).groupBy(F.col("g").alias("id")).agg(F.count("*").alias("size")).filter("size >= 20")
    return cd.candidates("chop", cd.located(found, facts), F.format_string("%d nodes lie between parameters and returns", "size"), ["id"], graphs.slice_score(F.col("size")))


@miner("value_object", "params", "facts")
def clumps(params: DataFrame, facts: DataFrame) -> DataFrame:
    item = F.concat_ws(":", "name", "type")
    found = groups.data_clumps(params.withColumn("item", item), "id", "item", placeholders=groups.PLACEHOLDERS).select(F.array_join("items", ", ").alias("clump"), "items")
    own = params.groupBy("id").agg(F.collect_set(item).alias("has")).withColumn("i", F.explode("has"))
    held = found.withColumn("i", F.element_at("items", 1)).join(own, "i").filter(F.size(F.array_except("items", "has")) == 0).select("id", "clump")
    return cd.candidates("value_object", cd.located(held, facts), F.concat(F.lit("parameters come together: "), "clump"), ["clump"])


@miner("primitive_obsession", "params", "facts")
def bare_concepts(params: DataFrame, facts: DataFrame) -> DataFrame:
    found = groups.primitive_groups(params, "id", "name", "type", groups.CONCEPTS).select("concept", F.col("type").alias("as"))
    word = F.try_element_at(F.filter(groups.split_words(F.col("name")), lambda w: w.isin(groups.CONCEPTS)), F.lit(1))
    own = params.select("id", word.alias("concept"), F.col("type").alias("as")).filter("concept is not null").distinct()
    return cd.candidates("primitive_obsession", cd.located(own.join(found, ["concept", "as"]), facts), F.concat("concept", F.lit(" is a bare "), "as"), ["concept", "as"])


@miner("aggregate", "writes", "facts")
def written_together(writes: DataFrame, facts: DataFrame) -> DataFrame:
    pairs = groups.co_modified(writes, "id", "type")
    a, b = writes.select("id", F.col("type").alias("a")).distinct(), writes.select("id", F.col("type").alias("b")).distinct()
    held = pairs.select("a", "b").join(a, "a").join(b, ["id", "b"])
    return cd.candidates("aggregate", cd.located(held, facts), F.concat("a", F.lit(" and "), "b", F.lit(" change together")), ["a", "b"])


def _static(kind: str):
    def build(hits: DataFrame, facts: DataFrame) -> DataFrame:
        own = hits.filter(F.col("kind") == kind).select("id", F.col("line").alias("at"), "detail", "suppressed")
        rows = own.join(facts.select("id", "path", "name"), "id").withColumnRenamed("at", "line")
        return cd.static_findings(kind, rows)

    return build


for _kind in ("guard_clause", "enum_dispatch", "type_switch", "entity_identity", "missing_identity", "mutable_identity", *cd.SUPPRESSIBLE):
    miner(_kind, "hits", "facts")(_static(_kind))
