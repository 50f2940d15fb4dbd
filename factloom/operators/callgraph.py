"""Call-graph operators: fix groups and their order, helper effects, bundles of forwarded arguments."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoint import cut
from .graphs import closure, components, reversed_edges
from .policy import plain_callee


def resolved_calls(calls: DataFrame, functions: DataFrame, normalize=lambda c: c) -> DataFrame:
    """`caller, callee`: static local calls joined to functions by normalised name; the last function of a name counts."""
    named = functions.groupBy(normalize(F.col("name")).alias("name")).agg(F.max_by("id", "position").alias("callee"))
    return calls.filter("local and not dynamic").join(named, normalize(F.col("callee_name")) == F.col("name")).select("caller", "callee").distinct()


def callees_first(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """`root, id, ordinal`: in each group (`root, id, position`), again and again the first member by position none of whose
    callees in the group waits; in a cycle, the first member. pairs: `caller, callee`."""
    x, y = members.alias("x"), members.select(F.col("root").alias("r"), F.col("id").alias("callee"))
    inner = x.join(pairs, F.col("x.id") == F.col("caller")).select("x.root", "x.id", "x.position", F.col("callee").alias("c"))
    inner = inner.join(y, (F.col("root") == F.col("r")) & (F.col("c") == F.col("callee"))).select("root", "id", "position", "callee")
    rows = members.select("root", "id", "position", F.lit(None).cast(dict(members.dtypes)["id"]).alias("callee")).union(inner)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["callee"].isna()].sort_values("position", kind="stable")
        waiting = first["id"].tolist()
        needs: dict = {i: set() for i in waiting}
        for i, c in pdf[pdf["callee"].notna()][["id", "callee"]].itertuples(index=False):
            if i != c:
                needs[i].add(c)
        out, left = [], set(waiting)
        while waiting:
            at = next((k for k, i in enumerate(waiting) if not needs[i] & left), 0)
            i = waiting.pop(at)
            left.discard(i)
            out.append(i)
        return pd.DataFrame({"root": pdf["root"].iloc[0], "id": out, "ordinal": range(len(out))})

    kinds = dict(members.dtypes)
    return rows.groupBy("root").applyInPandas(order, f"root {kinds['root']}, id {kinds['id']}, ordinal int")


def fix_groups(violators: DataFrame, pairs: DataFrame, hops: int = 1) -> DataFrame:
    """`id, root`: violators (`id, callers boolean`) whose footprints overlap, named by the smallest id among the members.

    A footprint is the function and, if a rule it breaks concerns callers, its callers within `hops`. Functions that break no rule
    link groups but are not listed.
    """
    edges = pairs.select(F.lit(0).alias("g"), F.col("caller").alias("src"), F.col("callee").alias("dst"))
    wide = violators.filter("callers").select(F.lit(0).alias("g"), F.col("id").alias("seed"))
    feet = closure(reversed_edges(edges), wide, max_hops=hops).select(F.col("seed").alias("id"), "node").union(violators.select("id", F.col("id").alias("node"))).distinct()
    hub = feet.groupBy("node").agg(F.min("id").alias("first"))
    links = cut(feet.join(hub, "node").select(F.col("id").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct())
    roots = components(links)
    return violators.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


#: Calls on a path at most, and effects of one body at most.
DEPTH, EFFECTS = 32, 4096


class Resolver:
    """Effects that calls bring in, as tuples kind, detail, line, via, and how many calls stay unclassified.

    A call's name is looked up in the prefix policy first (the longest prefix, of equal ones the later), kind `none` giving nothing. A
    static local call then has the effects of its helper's body: those of its calls, its own, its mutations'. A call that is neither,
    one of a name on the path already or deeper than `depth`, and one without a body are `unknown`. Each call site counts by itself. A
    body of over `most` effects keeps the first most - 1 and an unknown one. helpers: name to (calls, effects, mutations).
    """

    def __init__(self, helpers: dict, prefixes: list[tuple[str, str]] = (), depth: int = DEPTH, most: int = EFFECTS):
        self.helpers, self.bodies, self.path, self.depth, self.most = helpers, {}, [], depth, most
        self.policy: dict[str, str] = dict(prefixes)
        self.lengths = sorted({len(p) for p, _ in prefixes}, reverse=True)

    def kind(self, name: str) -> str | None:
        return next((self.policy[name[:n]] for n in self.lengths if n <= len(name) and name[:n] in self.policy), None)

    @staticmethod
    def leaf(callee: str, line: int, kind: str) -> tuple[list, int]:
        return ([], 0) if kind == "none" else ([(kind, callee, line, "")], int(kind == "unknown"))

    def one(self, call: tuple) -> tuple[list, int]:
        """call: callee, name, line, whether it is static and local."""
        callee, name, line, static = call
        kind = self.kind(name)
        open_ = kind is None and static and name in self.helpers and name not in self.path and len(self.path) < self.depth
        if not open_:
            return self.leaf(callee, line, kind or "unknown")
        effects, unknown = self.body(name)
        via = str(name).rsplit("/", 1)[-1]
        return [(k, f"{callee} \u2192 {d}", line, via) for k, d, _, _ in effects], unknown

    def many(self, calls: list) -> tuple[list, int]:
        out, count = [], 0
        for call in calls:
            effects, unknown = self.one(call)
            if len(out) + len(effects) > self.most:
                return out[: self.most - 1] + [("unknown", f"{call[0]} (local summary limit)", call[2], "")], count + 1
            out += effects
            count += unknown
        return out, count

    def body(self, name: str) -> tuple[list, int]:
        if name not in self.bodies:
            calls, effects, mutations = self.helpers[name]
            self.path.append(name)
            found, unknown = self.many(calls)
            self.path.pop()
            found = found + [(k, d, n, v or "") for k, d, n, v in effects] + mutation_tuples(mutations)
            if len(found) > self.most:
                found, unknown = found[: self.most - 1] + [("unknown", f"{name} (local summary limit)", 1, "")], unknown + 1
            self.bodies[name] = found, unknown
        return self.bodies[name]


def mutation_tuples(mutations: list) -> list:
    """Effects of writes (root, field path, line, provenance): local ones have none."""
    kinds = {"unknown": "unknown", "local": None}
    out = [(kinds.get(p, "mutation"), f"{root}.{field}" if field else root, line, "") for root, field, line, p in mutations]
    return [x for x in out if x[0]]


def helper_effects(functions: DataFrame, effects: DataFrame, calls: DataFrame, max_depth: int = DEPTH, max_effects: int = EFFECTS) -> DataFrame:
    """`id, kind, n`: effects of each function with those of the helpers it calls, as Resolver counts them.

    functions: `id`; effects: `id, kind`; calls: `caller, callee[, position]`, all static and local, in the order of position and
    callee. What a function reaches within max_depth calls is found by joins; then each function is one group of its helpers' rows.
    The result of a cycle or a limit depends on the order of calls, so it can't be put together from its helpers' results.
    """
    kinds = dict(functions.dtypes)
    calls = cut(calls.select("caller", "callee", *(["position"] if "position" in calls.columns else [])))
    place = F.col("position") if "position" in calls.columns else F.lit(0)
    edges = calls.select(F.lit(0).alias("g"), F.col("caller").alias("src"), F.col("callee").alias("dst"))
    reach = closure(edges, functions.select(F.lit(0).alias("g"), F.col("id").alias("seed")), max_hops=max_depth).select("seed", "node")
    called = calls.groupBy(F.col("caller").alias("node")).agg(F.sort_array(F.collect_list(F.struct(place.alias("position"), "callee"))).alias("calls"))
    own = effects.groupBy(F.col("id").alias("node")).agg(F.sort_array(F.collect_list("kind")).alias("kinds"))
    known = functions.select(F.col("id").alias("node"))
    rows = reach.join(known, "node", "left_semi").join(called, "node", "left").join(own, "node", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        helpers = {}
        for node, made, has in pdf[["node", "calls", "kinds"]].itertuples(index=False):
            sites = [(str(c["callee"]), c["callee"], 0, True) for c in made] if made is not None else []
            helpers[node] = sites, [(k, "", 0, "") for k in (has if has is not None else ())], []
        resolver = Resolver(helpers, (), max_depth, max_effects)
        seed = pdf["seed"].iloc[0]
        calls, own, _ = helpers[seed]
        found = Counter(k for k, _, _, _ in own + resolver.many(calls)[0])
        return pd.DataFrame({"id": pd.Series([seed] * len(found), dtype=pdf["seed"].dtype), "kind": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    return rows.groupBy("seed").applyInPandas(run, f"id {kinds['id']}, kind string, n long")


def local_effects(functions: DataFrame, prefixes: list[tuple[str, str]] = ()) -> DataFrame:
    """Adds `resolved` (array of kind, detail, line, via) and `unclassified` to functions as facts have them: name, calls, effects,
    mutations and, where known, helpers, each with its own. Resolved are the function's own effects, its mutations' and its calls', in the order of
    line, kind and detail. A function is its own helper too, unless helpers names another body for it. A map: nothing is shuffled."""
    held = [(p, k) for p, k in prefixes]

    def calls_of(calls) -> list:
        return [(c["callee"], plain_callee(c["callee"] or ""), c["line"], bool(c["local"]) and not c["dynamic"]) for c in calls or ()]

    def body(x: dict) -> tuple[list, list, list]:
        return calls_of(x["calls"]), [(e["kind"], e["detail"], e["line"], e["via"]) for e in x["effects"] or ()], [(m["root"], m["field_path"], m["line"], m["provenance"]) for m in x["mutations"] or ()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, count = [], []
            for x in batch.select([c for c in ("name", "calls", "effects", "mutations", "helpers") if c in batch.schema.names]).to_pylist():
                own = body(x)
                helpers = {plain_callee(x["name"] or ""): own} | {plain_callee(h["name"] or ""): body(h) for h in x.get("helpers") or ()}
                found, unknown = Resolver(helpers, held).many(own[0])
                every = [(k, d, n, v or "") for k, d, n, v in own[1]] + mutation_tuples(own[2]) + found
                every.sort(key=lambda e: (e[2], e[0], e[1]))
                made.append([dict(zip(("kind", "detail", "line", "via"), e)) for e in every])
                count.append(unknown)
            resolved = pa.array(made, pa.list_(pa.struct([("kind", pa.string()), ("detail", pa.string()), ("line", pa.int32()), ("via", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, resolved, pa.array(count, pa.int32())], [*batch.schema.names, "resolved", "unclassified"])

    effect = T.StructType([T.StructField("kind", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("via", T.StringType())])
    return functions.mapInArrow(run, T.StructType([*functions.schema.fields, T.StructField("resolved", T.ArrayType(effect)), T.StructField("unclassified", T.IntegerType())]))


def bundles(inputs: DataFrame, site_col: str, item_col: str) -> DataFrame:
    """`items, sites`: sets of two items or more that are a site's items or the intersection of two sites', closed: no strict
    superset has as many sites."""
    from .groups import without_subsets

    sets = inputs.select(F.col(site_col).alias("s"), F.col(item_col).alias("i")).distinct().groupBy("s").agg(F.array_sort(F.collect_list("i")).alias("items"))
    classes = cut(sets.groupBy("items").agg(F.count("*").alias("n")).withColumn("k", F.xxhash64("items")))
    by_item = classes.select("k", F.explode("items").alias("i"))
    met = by_item.alias("x").join(by_item.alias("y"), F.col("x.i") == F.col("y.i")).filter("x.k < y.k").groupBy("x.k", "y.k").agg(F.array_sort(F.collect_list("x.i")).alias("items")).select("items")
    candidates = cut(classes.select("items").union(met).filter(F.size("items") >= 2).distinct())
    holds = candidates.withColumn("i", F.element_at("items", 1)).join(classes.select(F.col("items").alias("own"), "n", F.explode("items").alias("i")), "i").filter(F.size(F.array_except("items", "own")) == 0)
    support = holds.groupBy("items").agg(F.sum("n").cast("long").alias("sites"))
    return without_subsets(cut(support), "items", same="sites")


def site_counts(edges: DataFrame) -> DataFrame:
    """`id, incoming, outgoing` of `src, dst` rows."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outgoing"))
    return i.join(o, "id", "full_outer").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def pass_through(params: DataFrame, forwards: DataFrame) -> DataFrame:
    """Parameters (`id, param, uses`) that are used, and forwarded (`id, param`) at least as often."""
    n = forwards.groupBy("id", "param").agg(F.count("*").alias("forwarded"))
    return params.join(n, ["id", "param"]).filter("uses > 0 and forwarded >= uses")
