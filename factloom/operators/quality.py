"""Effect density, mutation targets, rule diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits, weights and kinds of the rules.
LIMITS = {"fn_length": 200, "fn_params": 4, "mutation_per_target": 3, "mutated_targets": 3, "side_effect_density": 500, "aggregate": 1, "repository": 0, "mutable_identity": 0}
WEIGHTS = {"mutation": 1, "io": 3, "network": 3, "global": 2, "unsafe": 4, "time": 1, "random": 1, "panic": 0, "unknown": 1}
RULE_ORDER = ["invalid_suppression", "fn_length", "fn_params", "mutated_targets", "mutation_per_target", "side_effect_density", "aggregate", "repository", "mutable_identity"]


@dataclass
class Config:
    limits: dict[str, int] = field(default_factory=lambda: dict(LIMITS))
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    min_statements: int = 3
    field_granularity: bool = False
    caller_rules: tuple[str, ...] = ("fn_params",)
    hops: int = 1

    def __post_init__(self):
        if set(self.limits) - set(LIMITS) or any(v < 0 for v in self.limits.values()):
            raise ValueError("limits: unknown rule or negative limit")
        if set(self.weights) - set(WEIGHTS) or any(v < 0 for v in self.weights.values()):
            raise ValueError("weights: unknown kind or negative weight")
        if self.min_statements < 0 or self.hops < 0:
            raise ValueError("min_statements and hops must not be negative")


def weight_of(kind: Column, weights: dict[str, int]) -> Column:
    """The weight of a kind; 0 for one that has none."""
    out = F.lit(0)
    for k, w in weights.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out


def canonical(facts: DataFrame, key: list[str]) -> DataFrame:
    """Rows that repeat a key and are equal count once; a key with different rows is an error when the result is read."""
    rest = [c for c in facts.columns if c not in key]
    row = F.struct(*rest) if rest else F.lit(1)
    one = facts.groupBy(*key).agg(F.min(F.xxhash64(F.to_json(row) if rest else row)).alias("__a"), F.max(F.xxhash64(F.to_json(row) if rest else row)).alias("__b"), F.first(row).alias("__r"))
    same = F.when(F.col("__a") == F.col("__b"), F.col("__r")).otherwise(F.raise_error(F.lit("facts of one key differ")))
    return one.select(*key, same.alias("__r")).select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def mutation_effects(mutations: DataFrame) -> DataFrame:
    """Effects of writes: local ones have none, unknown provenance gives `unknown`, external `mutation`; the label is root[.field]."""
    label = F.concat_ws(".", "root", F.when(F.col("field_path") != "", F.col("field_path")))
    return mutations.filter("provenance <> 'local'").withColumn("kind", F.when(F.col("provenance") == "unknown", "unknown").otherwise("mutation")).withColumn("detail", label)


def effect_density(effects: DataFrame, function_col: str, kind_col: str, statements: DataFrame, statements_col: str, weights: dict[str, int]) -> DataFrame:
    """`function, weight, effects, density, complete`: density is 1000 x weight div statements (1 at least); complete: no unknown effect.

    Weights and counts are summed per function before the join with its statements. Functions without effects have density 0.
    """
    sums = effects.groupBy(function_col).agg(F.sum(weight_of(F.col(kind_col), weights)).cast("long").alias("weight"), F.count("*").alias("effects"), F.count_if(F.col(kind_col) == "unknown").alias("unknown"))
    out = statements.join(sums, function_col, "left").fillna(0, ["weight", "effects", "unknown"])
    return out.select(function_col, statements_col, "weight", "effects", F.expr(f"1000 * weight div greatest({statements_col}, 1)").cast("long").alias("density"), (F.col("unknown") == 0).alias("complete"))


def weight_breakdown(effects: DataFrame, function_col: str, kind_col: str, weights: dict[str, int]) -> DataFrame:
    """`function, breakdown`: kind=weight, heaviest first, then by kind; kinds of no weight are left out."""
    by_kind = effects.groupBy(function_col, kind_col).agg(F.sum(weight_of(F.col(kind_col), weights)).cast("long").alias("w")).filter("w > 0")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("n"), F.col(kind_col).alias("k"), F.col("w"))))
    return by_kind.groupBy(function_col).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["k"], F.lit("="), x["w"].cast("string"))), ", ").alias("breakdown"))


def effect_histogram(effects: DataFrame, kind_col: str, kinds: list[str]) -> DataFrame:
    """Counts of all the given kinds in their order, with zeros; other kinds are left out."""
    order = effects.sparkSession.createDataFrame([(i, k) for i, k in enumerate(kinds)], "position int, kind string")
    counts = effects.groupBy(F.col(kind_col).alias("kind")).count()
    return order.join(counts, "kind", "left").select("position", "kind", F.coalesce("count", F.lit(0)).alias("n"))


def mutation_targets(mutations: DataFrame, function_col: str, root_col: str, field_col: str | None = None) -> DataFrame:
    """`function, target, n`: writes by target, root or root.field."""
    key = F.col(root_col) if field_col is None else F.concat_ws(".", root_col, F.when(F.col(field_col) != "", F.col(field_col)))
    return mutations.groupBy(function_col, key.alias("target")).agg(F.count("*").alias("n"))


def target_budget(targets: DataFrame, function_col: str, limit: int) -> DataFrame:
    """`function, targets, most`: functions with over `limit` targets, and the writes to the busiest."""
    return targets.groupBy(function_col).agg(F.count("*").alias("targets"), F.max("n").alias("most")).filter(F.col("targets") > limit)


def diagnostics(metrics: DataFrame, keys: list[str], rules: dict[str, str], limits: dict[str, int], suppressed_col: str | None = None) -> DataFrame:
    """`keys, rule, actual, max`: a row for each rule whose metric is above its limit and that isn't suppressed.

    rules: rule name to metric column. The metrics are unpivoted in the scan's stage, before any filter is lost.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("long").alias("actual"), F.lit(limits[r]).cast("long").alias("max")) for r, c in rules.items()])
    extra = [suppressed_col] if suppressed_col else []
    out = metrics.select(*keys, *extra, F.explode(pairs).alias("d")).select(*keys, *extra, "d.rule", "d.actual", "d.max").filter("actual > max")
    if suppressed_col:
        out = out.filter(~F.coalesce(F.array_contains(F.col(suppressed_col), F.col("rule")), F.lit(False))).drop(suppressed_col)
    return out


def parameter_budget(params: Column, has_self: Column) -> Column:
    return params + F.when(has_self, 1).otherwise(0)


def ddd_metrics(hits: DataFrame, function_col: str) -> DataFrame:
    """`function, aggregate, repository, mutable_identity` of domain hits (`rule_id, detail`): distinct details of the first, counts
    of the others (Q10, G6)."""
    return hits.groupBy(function_col).agg(F.countDistinct(F.when(F.col("rule_id") == "aggregate", F.col("detail"))).alias("aggregate"), *[F.count_if(F.col("rule_id") == r).alias(r) for r in ("repository", "mutable_identity")])


def evaluate(functions: DataFrame, effects: DataFrame, targets: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """`keys, rule, actual, max` of all rules (Q1): functions (`keys, code_lines, params, has_self, statements, suppressed`), their
    effects (`keys, kind`) and mutation targets (`keys, target, n`). Density counts from min_statements on. Read it ordered by
    (keys, position of the rule)."""
    e = effects.groupBy(*keys).agg(F.sum(weight_of(F.col("kind"), config.weights)).cast("long").alias("weight"))
    t = targets.groupBy(*keys).agg(F.count("*").alias("targets"))
    f = functions.join(e, keys, "left").join(t, keys, "left").fillna(0, ["weight", "targets"])
    f = f.withColumn("budget", parameter_budget(F.col("params"), F.col("has_self"))).withColumn("density", F.when(F.col("statements") >= config.min_statements, F.expr("1000 * weight div greatest(statements, 1)")).otherwise(F.lit(0)))
    rules = {"fn_length": "code_lines", "fn_params": "budget", "mutated_targets": "targets", "side_effect_density": "density"}
    out = diagnostics(f, keys, rules, config.limits, "suppressed")
    busy = targets.filter(F.col("n") > config.limits["mutation_per_target"]).join(functions.select(*keys, "suppressed"), keys).filter(~F.coalesce(F.array_contains("suppressed", "mutation_per_target"), F.lit(False)))
    each = busy.select(*keys, F.lit("mutation_per_target").alias("rule"), F.col("n").cast("long").alias("actual"), F.lit(config.limits["mutation_per_target"]).cast("long").alias("max"))
    both = out.unionByName(each)
    return both.withColumn("position", F.array_position(F.array(*map(F.lit, RULE_ORDER)), F.col("rule")).cast("int"))


def _messages(weights: dict[str, int]) -> str:
    cases = " ".join(f"when '{k}' then {w}" for k, w in weights.items())
    return f"aggregate(resolved, 0L, (s, e) -> s + case e.kind {cases} else 0 end)"


def evaluate_facts(functions: DataFrame, config: Config, prefixes: list[tuple[str, str]] = ()) -> DataFrame:
    """functions as facts have them, each with `effects_of` (resolved, in order), `unclassified`, `weight`, `density`, `complete`, and
    `findings`: array of rule, actual, max, message in the order of the rules (Q1, Q3, Q7-Q10).

    All of it is a map over the functions. A comment that suppresses wrongly is a finding of its own and suppresses nothing; it can't
    suppress itself.
    """
    from .callgraph import local_effects
    from .policy import suppressions

    known = [r for r in RULE_ORDER] + ["nilerr", "forcetypeassert", "typednil"]
    f = suppressions(local_effects(functions, prefixes), "preceding_line", known)
    f = f.withColumn("weight", F.expr(_messages(config.weights))).withColumn("density", F.expr("1000 * weight div greatest(statements, 1)"))
    f = f.withColumn("complete", ~F.exists("resolved", lambda e: e["kind"] == "unknown"))
    key = "concat(m.root, '@', m.root_id" + (", '.', m.field_path)" if config.field_granularity else ")")
    f = f.withColumn("__keys", F.expr(f"transform(mutations, m -> {key})")).withColumn("__targets", F.array_sort(F.array_distinct("__keys")))
    kinds = F.array_distinct(F.transform("resolved", lambda e: e["kind"]))
    by_kind = F.transform(kinds, lambda k: F.struct((-F.aggregate(F.filter("resolved", lambda e: e["kind"] == k), F.lit(0), lambda s, e: s + weight_of(e["kind"], config.weights))).alias("n"), k.alias("k")))
    parts = F.array_join(F.transform(F.array_sort(F.filter(by_kind, lambda x: x["n"] < 0)), lambda x: F.concat(x["k"], F.lit(" "), (-x["n"]).cast("string"))), ", ")
    hits = lambda rule: F.filter("ddd", lambda d: d["rule_id"] == rule)
    n = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")

    def finding(rule, actual, message=None):
        limit = config.limits[rule]
        text = message if message is not None else F.format_string("%s: %d exceeds %d", F.lit(rule), actual, F.lit(limit).cast("long"))
        return F.struct(F.lit(rule).alias("rule"), actual.cast("long").alias("actual"), F.lit(limit).cast("long").alias("max"), text.alias("message"))

    limit = config.limits["side_effect_density"]
    dense = F.when(F.col("statements") >= config.min_statements, F.col("density")).otherwise(F.lit(0)).cast("long")
    told = F.format_string("side_effect_density %d > %d: weight %d over %d statements (%s)", F.col("density"), F.lit(limit).cast("long"), F.col("weight"), F.col("statements").cast("long"), parts)
    busy = F.transform("__targets", lambda t: finding("mutation_per_target", n(F.filter("__keys", lambda k: k == t))))
    wrong = F.when(F.col("invalid"), F.array(F.struct(F.lit("invalid_suppression").alias("rule"), F.lit(1).cast("long").alias("actual"), F.lit(0).cast("long").alias("max"), F.concat(F.lit("invalid suppression: "), "problem").alias("message"))))
    none = F.array().cast("array<struct<rule: string, actual: bigint, max: bigint, message: string>>")
    checks = F.concat(
        F.array(finding("fn_length", F.col("code_lines").cast("long")), finding("fn_params", parameter_budget(F.col("params"), F.col("has_self")).cast("long")), finding("mutated_targets", n("__targets"))),
        F.coalesce(busy, none),
        F.array(finding("side_effect_density", dense, told), finding("aggregate", n(F.array_distinct(F.transform(hits("aggregate"), lambda d: d["detail"])))), finding("repository", n(hits("repository"))), finding("mutable_identity", n(hits("mutable_identity")))),
    )
    fired = F.filter(checks, lambda x: (x["actual"] > x["max"]) & ~F.array_contains("suppressed", x["rule"]))
    return f.withColumn("findings", F.concat(F.coalesce(wrong, none), fired)).drop("__keys", "__targets").withColumnRenamed("resolved", "effects_of")


def diagnostics_of(evaluated: DataFrame) -> DataFrame:
    """`path, line, column, name, rule, actual, max, message, position` of evaluate_facts, in the report's order: by place, then rule,
    several of a rule as they were found (O3)."""
    rows = evaluated.select("path", "line", "column", "name", F.posexplode("findings").alias("at", "f")).select("path", "line", "column", "name", "at", "f.*")
    own = Window.partitionBy("path").orderBy("line", "column", "rule", "name", "at")
    return rows.withColumn("position", F.row_number().over(own)).drop("at")


def summary_of(evaluated: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row: functions, incomplete functions, largest and mean density, and a count of each kind of effect in order."""
    kinds = kinds or ["mutation", "io", "network", "global", "unsafe", "time", "random", "panic", "unknown"]
    of_kind = lambda k: F.size(F.filter("effects_of", lambda e: e["kind"] == k))
    counts = [F.sum(of_kind(k)).alias(f"n_{k}") for k in kinds]
    mean = F.expr("coalesce(sum(density), 0) div greatest(count(*), 1)").alias("mean")
    return evaluated.agg(F.count("*").alias("functions"), F.count_if(~F.col("complete")).alias("incomplete"), F.coalesce(F.max("density"), F.lit(0)).alias("largest"), mean, *counts)


def fix_groups_of(evaluated: DataFrame, config: Config) -> DataFrame:
    """`root, id, ordinal`: the fix groups of functions with findings, callees first (Q12). id is path:line:column name; calls are static
    and local, joined by plain name."""
    from .callgraph import callees_first, fix_groups, resolved_calls
    from .policy import normalized_callee

    f = evaluated.withColumn("id", F.format_string("%s:%010d:%010d %s", "path", "line", "column", "name")).withColumn("position", F.col("id"))
    sites = f.select(F.col("id").alias("caller"), F.explode("calls").alias("c")).select("caller", F.col("c.callee").alias("callee_name"), F.coalesce("c.local", F.lit(False)).alias("local"), F.coalesce("c.dynamic", F.lit(False)).alias("dynamic"))
    pairs = resolved_calls(sites, f.select("id", "name", "position"), normalized_callee)
    bad = f.filter(F.size("findings") > 0)
    wide = F.exists("findings", lambda x: x["rule"].isin(list(config.caller_rules)))
    roots = fix_groups(bad.select("id", wide.alias("callers")), pairs, config.hops)
    return callees_first(pairs, roots.withColumn("position", F.col("id")))


def changed_only(diagnostics: DataFrame, touched: DataFrame) -> DataFrame:
    """Diagnostics of functions (`path, name`) that a diff touches."""
    return diagnostics.join(touched.select("path", "name").distinct(), ["path", "name"], "left_semi")
