"""The queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import beliefs as bl
from ..operators import callgraph, gate, graphs, groups, intervals, policy, quality, reduction, report, rollup, rules, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rollups and rankings ------------------------------------------------------------------------------------------------

_FUNCTIONS = "SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS complexity, CAST(round(l_discount * 100) AS INTEGER) AS cognitive FROM lineitem"


def _functions(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("complexity"), F.round(F.col("l_discount") * 100).cast("int").alias("cognitive"))


@query("complexity_rollup", f"""
SELECT l_orderkey, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total, max(complexity) AS peak, avg(complexity) AS average,
  CAST(sum(cognitive) AS BIGINT) AS second_total, max(cognitive) AS second_peak, avg(cognitive) AS second_average,
  CAST(row_number() OVER (ORDER BY sum(complexity) DESC, l_orderkey) AS INTEGER) AS rank
FROM ({_FUNCTIONS}) GROUP BY l_orderkey ORDER BY total DESC, l_orderkey LIMIT 20""")
def complexity_rollup(spark, sf_dir):
    rolled = rollup.rollup(_functions(spark, sf_dir), "l_orderkey", "complexity", "cognitive")
    return rollup.keep_top(rolled, "total", 0, 20, F.col("total").desc(), F.col("l_orderkey"))


@query("report_summary", f"""
SELECT count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total, CAST(max(complexity) AS BIGINT) AS peak, CAST(sum(complexity) // count(*) AS BIGINT) AS mean FROM ({_FUNCTIONS})""")
def report_summary(spark, sf_dir):
    return rollup.report_summary(_functions(spark, sf_dir), "complexity")


@query("function_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS rank FROM lineitem""")
def function_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rollup.rank_within(rows, ["l_orderkey"], F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


# --- quality -----------------------------------------------------------------------------------------------------------------

_KINDS = {"click": "io", "view": "time", "purchase": "network", "error": "unknown", "signup": "mutation"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'none' END"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.WEIGHTS.items()) + " ELSE 0 END"
_DENSITY = f"""
  SELECT user_id, statements, weight, effects, (1000 * weight) // greatest(statements, 1) AS density, unknown = 0 AS complete FROM (
    SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS statements, CAST(sum({_WEIGHT}) AS BIGINT) AS weight, count(*) AS effects, count(*) FILTER (kind = 'unknown') AS unknown
    FROM (SELECT *, {_CASE} AS kind FROM events) GROUP BY user_id)"""


def _effects(spark, sf_dir):
    kind = F.lit("none")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return read(spark, sf_dir, "events").select("user_id", "event_type", kind.alias("kind"), F.to_date("ts").alias("day"))


def _densities(spark, sf_dir):
    effects = _effects(spark, sf_dir)
    statements = effects.groupBy("user_id").agg(F.countDistinct("day").alias("statements"))
    return quality.effect_density(effects, "user_id", "kind", statements, "statements", quality.WEIGHTS)


@query("effect_density", _DENSITY)
def effect_density(spark, sf_dir):
    return _densities(spark, sf_dir)


@query("effect_breakdown", f"""
SELECT user_id, string_agg(kind || '=' || w, ', ' ORDER BY w DESC, kind) AS breakdown FROM (
  SELECT user_id, kind, CAST(sum({_WEIGHT}) AS BIGINT) AS w FROM (SELECT *, {_CASE} AS kind FROM events) GROUP BY user_id, kind) WHERE w > 0 GROUP BY user_id""")
def effect_breakdown(spark, sf_dir):
    return quality.weight_breakdown(_effects(spark, sf_dir), "user_id", "kind", quality.WEIGHTS)


_ORDERED = list(quality.WEIGHTS)


@query("effect_histogram", "SELECT k.position, k.kind, count(e.kind) AS n FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(_ORDERED)) + f") k(position, kind) LEFT JOIN (SELECT {_CASE} AS kind FROM events) e ON e.kind = k.kind GROUP BY k.position, k.kind")
def effect_histogram(spark, sf_dir):
    return quality.effect_histogram(_effects(spark, sf_dir), "kind", _ORDERED)


@query("density_summary", f"SELECT count(*) AS functions, CAST(sum(density) AS BIGINT) AS total, CAST(max(density) AS BIGINT) AS peak, CAST(sum(density) // count(*) AS BIGINT) AS mean FROM ({_DENSITY})")
def density_summary(spark, sf_dir):
    return rollup.report_summary(_densities(spark, sf_dir), "density")


_RULES = {"side_effect_density": ("density", 500), "fn_length": ("effects", 200), "mutated_targets": ("statements", 3)}


@query("rule_diagnostics", " UNION ALL ".join(f"SELECT user_id, '{r}' AS rule, CAST({c} AS BIGINT) AS actual, CAST({n} AS BIGINT) AS max FROM ({_DENSITY}) WHERE {c} > {n}" for r, (c, n) in _RULES.items()))
def rule_diagnostics(spark, sf_dir):
    return quality.diagnostics(_densities(spark, sf_dir), ["user_id"], {r: c for r, (c, _) in _RULES.items()}, {r: n for r, (_, n) in _RULES.items()})


@query("mutation_targets", "SELECT o_custkey, o_orderpriority AS target, count(*) AS n FROM orders GROUP BY ALL")
def mutation_targets(spark, sf_dir):
    return quality.mutation_targets(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("mutation_target_budget", "SELECT o_custkey, count(*) AS targets, max(n) AS most FROM (SELECT o_custkey, o_orderpriority || '.' || o_orderstatus AS target, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING count(*) > 3")
def mutation_target_budget(spark, sf_dir):
    return quality.target_budget(quality.mutation_targets(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", 3)


_POLICY = [("red", "io"), ("red w", "network"), ("bl", "time"), ("blue", "mutation"), ("blue", "global"), ("s", "none"), ("la", "random")]


@query("longest_prefix", f"""
SELECT p_partkey, p_name, prefix, coalesce(kind, 'unknown') AS kind FROM (
  SELECT p.p_partkey, p.p_name, r.prefix, r.kind, row_number() OVER (PARTITION BY p.p_partkey ORDER BY length(r.prefix) DESC, r.pos DESC) AS rn
  FROM part p LEFT JOIN (VALUES {", ".join(f"({i}, '{p}', '{k}')" for i, (p, k) in enumerate(_POLICY))}) r(pos, prefix, kind) ON starts_with(p.p_name, r.prefix)) WHERE rn = 1""")
def longest_prefix(spark, sf_dir):
    return policy.longest_prefix(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _POLICY, "unknown")


_GATE = """
WITH x AS (SELECT l_returnflag AS rule, CAST(l_quantity AS INTEGER) AS actual, l_shipdate < TIMESTAMP '1996-01-01' AS old FROM lineitem),
r AS (SELECT rule, old, 1000.0::DOUBLE * sum(greatest(actual - 40, 0)) / count(*) AS rate FROM x GROUP BY ALL)
SELECT c.rule, c.rate AS now, coalesce(b.rate, 0) AS base, CASE WHEN c.rate > coalesce(b.rate, 0) * 1.05::DOUBLE + 1e-9::DOUBLE THEN 'regression' WHEN c.rate < coalesce(b.rate, 0) * 0.95::DOUBLE - 1e-9::DOUBLE THEN 'improvement' ELSE 'ok' END AS status
FROM r c LEFT JOIN r b ON b.rule = c.rule AND b.old WHERE NOT c.old"""


def _gate_rows(spark, sf_dir, old: bool):
    then = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    rows = read(spark, sf_dir, "lineitem").filter(then if old else ~then).select(F.col("l_returnflag").alias("rule"), F.col("l_quantity").cast("int").alias("actual"), F.lit(40).alias("max"))
    return gate.rule_totals(rows, rows.groupBy("rule").agg(F.count("*").alias("functions")))


@query("baseline_gate", _GATE)
def baseline_gate(spark, sf_dir):
    return gate.check(_gate_rows(spark, sf_dir, False), _gate_rows(spark, sf_dir, True), 0.05)


@query("worst_offenders", """
SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 5""")
def worst_offenders(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return gate.worst_offenders(rows, "l_returnflag", F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("score", f"SELECT CAST(greatest(100 - coalesce(sum(density // 100), 0), 0) AS BIGINT) AS score FROM ({_DENSITY}) WHERE density > 4400")
def score(spark, sf_dir):
    return rollup.overall_score(_densities(spark, sf_dir).filter("density > 4400"), "density")


# --- miners --------------------------------------------------------------------------------------------------------------------


@query("signature_groups", """
WITH t AS (SELECT count(*)::DOUBLE AS total FROM part), n AS (SELECT p_size, p_name, count(*) AS n, count(DISTINCT p_brand) AS types FROM part GROUP BY ALL),
g AS (SELECT p_size AS key, CAST(sum(n) AS BIGINT) AS members, max(types) AS shared FROM n GROUP BY p_size),
k AS (SELECT p_size AS key, count(DISTINCT p_brand) AS types FROM part GROUP BY p_size),
s AS (SELECT key, members, types, shared, CAST(greatest(round(1000.0::DOUBLE * ln(total / members)), 0) AS BIGINT) AS specificity FROM g JOIN k USING (key), t WHERE types >= 2)
SELECT *, specificity + CASE WHEN shared >= 2 THEN ((specificity // 2) * shared) // types ELSE 0 END AS score FROM s""")
def signature_groups(spark, sf_dir):
    return groups.signature_groups(read(spark, sf_dir, "part"), "p_size", "p_brand", "p_name")


_TOKENS = "SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS item FROM documents"
_RULES_SQL = f"""
WITH s AS MATERIALIZED ({_TOKENS}), n AS (SELECT count(DISTINCT id) AS n FROM s), df AS (SELECT item, count(*) AS df FROM s GROUP BY item),
f AS MATERIALIZED (SELECT id, item, df FROM s JOIN df USING (item), n WHERE df >= ceil(0.1::DOUBLE * n.n))"""


def _token_sets(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), F.lit(1))
    return rules.array_sets(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", words)


@query("rules_single", _RULES_SQL + """
SELECT x.item AS a, y.item AS b, count(*) AS n, x.df AS df_a FROM f x JOIN f y ON x.id = y.id AND x.item <> y.item, n
GROUP BY x.item, y.item, x.df, n.n HAVING count(*)::DOUBLE / n.n >= 0.1::DOUBLE AND count(*)::DOUBLE / x.df >= 0.9::DOUBLE""")
def rules_single(spark, sf_dir):
    return rules.Baskets(_token_sets(spark, sf_dir)).single().select("a", "b", "n", "df_a")


@query("rules_double", _RULES_SQL + """,
ab AS (SELECT x.id, x.item AS a, y.item AS b FROM f x JOIN f y ON x.id = y.id AND x.item < y.item), nab AS (SELECT a, b, count(*) AS n_ab FROM ab GROUP BY a, b), k AS MATERIALIZED (SELECT a, b, n_ab FROM nab, n WHERE n_ab >= 0.1::DOUBLE * n.n),
abc AS (SELECT a, b, z.item AS c, n_ab, count(*) AS n FROM ab JOIN k USING (a, b) JOIN f z ON ab.id = z.id AND ab.b < z.item GROUP BY a, b, z.item, n_ab)
SELECT a, b, c, abc.n, n_ab FROM abc, n WHERE abc.n::DOUBLE / n.n >= 0.1::DOUBLE AND abc.n::DOUBLE / n_ab >= 0.9::DOUBLE""")
def rules_double(spark, sf_dir):
    return rules.Baskets(_token_sets(spark, sf_dir)).double().select("a", "b", "c", "n", "n_ab")


_ROLES = "WITH s AS MATERIALIZED (SELECT DISTINCT conv_id AS id, role AS item FROM conversations), n AS (SELECT count(DISTINCT id) AS n FROM s), df AS (SELECT item, count(*) AS df FROM s GROUP BY item)"


@query("rule_violations", _ROLES + """, r AS (SELECT x.item AS a, y.item AS b FROM s x JOIN s y ON x.id = y.id AND x.item <> y.item JOIN df ON df.item = x.item, n
  GROUP BY x.item, y.item, df.df, n.n HAVING count(*)::DOUBLE / n.n >= 0.1::DOUBLE AND count(*)::DOUBLE / df.df >= 0.9::DOUBLE)
SELECT s.id, a, b FROM s JOIN r ON s.item = r.a WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.id = s.id AND t.item = r.b)""")
def rule_violations(spark, sf_dir):
    sets = rules.call_sets(read(spark, sf_dir, "conversations"), "conv_id", "role")
    return rules.violations(sets, rules.Baskets(sets).single())


_PRI = "WITH s AS MATERIALIZED (SELECT DISTINCT o_custkey AS id, o_orderpriority AS item FROM orders UNION SELECT DISTINCT o_custkey, o_orderpriority || ':' || o_orderstatus FROM orders WHERE o_totalprice > 400000), n AS (SELECT count(DISTINCT id) AS n FROM s), df AS (SELECT item, count(*) AS df FROM s GROUP BY item)"
_DISJ = _PRI + """, p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM s x JOIN s y ON x.id = y.id AND x.item <> y.item GROUP BY ALL),
o AS (SELECT a, b, c, df FROM p JOIN df ON df.item = a, n WHERE df >= ceil(0.1::DOUBLE * n.n) AND NOT (c::DOUBLE / n.n >= 0.1::DOUBLE AND c::DOUBLE / df >= 0.9::DOUBLE)),
r AS (SELECT x.a, x.b, y.b AS c, x.df AS df_a, (SELECT count(DISTINCT s.id) FROM s JOIN s t ON s.id = t.id AND t.item IN (x.b, y.b) WHERE s.item = x.a) AS m FROM o x JOIN o y ON x.a = y.a AND x.b < y.b),
d AS (SELECT a, b, c, m AS n, df_a FROM r, n WHERE m::DOUBLE / n.n >= 0.1::DOUBLE AND m::DOUBLE / df_a >= 0.9::DOUBLE)"""


def _priorities(spark, sf_dir):
    """Priorities, and those of costly orders with their status: frequent items and rare ones. Over the tokens of documents, as in the
    other rules, nearly every antecedent has millions of pairs of alternatives (9.5 million candidates in 200 documents)."""
    o = read(spark, sf_dir, "orders")
    both = o.select("o_custkey", F.col("o_orderpriority").alias("i")).union(o.filter("o_totalprice > 400000").select("o_custkey", F.concat_ws(":", "o_orderpriority", "o_orderstatus")))
    return rules.call_sets(both, "o_custkey", "i")


@query("rules_disjunctive", _DISJ + " SELECT a, b, c, n, df_a FROM d")
def rules_disjunctive(spark, sf_dir):
    return rules.Baskets(_priorities(spark, sf_dir)).disjunctive()


@query("disjunctive_violations", _DISJ + " SELECT s.id, a, b, c FROM s JOIN d ON s.item = a WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.id = s.id AND t.item IN (b, c))")
def disjunctive_violations(spark, sf_dir):
    sets = _priorities(spark, sf_dir)
    return rules.disjunctive_violations(sets, rules.Baskets(sets).disjunctive())


_BELIEF = "SELECT l_suppkey AS callee, count(*) AS sites, count(*) FILTER (l_discount > 0) AS checked, count(*) FILTER (l_discount > 0)::DOUBLE / count(*) AS fraction FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5 AND count(*) FILTER (l_discount > 0)::DOUBLE / count(*) >= 0.9::DOUBLE"


def _sites(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_discount") > 0).alias("ok"))


@query("beliefs", _BELIEF)
def beliefs(spark, sf_dir):
    return bl.beliefs(_sites(spark, sf_dir), "l_suppkey", "ok")


@query("belief_violations", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount > 0 AS ok, sites, checked, fraction FROM lineitem JOIN ({_BELIEF}) ON callee = l_suppkey WHERE NOT l_discount > 0")
def belief_violations(spark, sf_dir):
    return bl.belief_violations(_sites(spark, sf_dir), "l_suppkey", "ok")


@query("data_clumps", """
WITH f AS (SELECT DISTINCT o_custkey AS f, o_orderpriority || ':' || o_orderstatus AS item FROM orders),
s AS MATERIALIZED (SELECT f, list_sort(list(item)) AS items FROM f GROUP BY f HAVING count(*) >= 2),
k AS MATERIALIZED (SELECT items, list(f) AS fs, count(*) AS members FROM s GROUP BY items),
p AS (SELECT list_sort(list_intersect(x.items, y.items)) AS i, x.items AS xi, y.items AS yi FROM k x JOIN k y ON x.items < y.items),
met AS MATERIALIZED (SELECT DISTINCT i, m FROM (SELECT i, xi AS m FROM p WHERE len(i) >= 2 UNION ALL SELECT i, yi FROM p WHERE len(i) >= 2 UNION ALL SELECT items, items FROM k WHERE members > 1)),
c AS MATERIALIZED (SELECT i AS items, CAST(sum(members) AS BIGINT) AS functions FROM met JOIN k ON k.items = met.m GROUP BY i HAVING sum(members) >= 3)
SELECT array_to_string(items, '|') AS items, functions FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE len(y.items) > len(x.items) AND list_has_all(y.items, x.items))""")
def data_clumps(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("item"))
    return groups.data_clumps(rows, "o_custkey", "item").select(F.array_join("items", "|").alias("items"), "functions")


_COLOURS = ["red", "blue", "green", "small", "large", "steel", "widget", "gear", "bolt"]


@query("primitive_groups", f"""
SELECT concept, p_type AS type, count(DISTINCT p_partkey) AS functions FROM (
  SELECT p_partkey, p_type, [w FOR w IN regexp_split_to_array(lower(p_name), '[^a-z0-9]+') IF w IN ({", ".join(f"'{c}'" for c in _COLOURS)})][1] AS concept FROM part) WHERE concept IS NOT NULL GROUP BY concept, p_type HAVING count(DISTINCT p_partkey) >= 2""")
def primitive_groups(spark, sf_dir):
    return groups.primitive_groups(read(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type", _COLOURS)


@query("co_modified", """
WITH w AS (SELECT DISTINCT l_orderkey AS f, p_brand AS t FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.t AS a, y.t AS b, count(*) AS functions FROM w x JOIN w y ON x.f = y.f AND x.t < y.t GROUP BY ALL HAVING count(*) >= 2""")
def co_modified(spark, sf_dir):
    writes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return groups.co_modified(writes, "l_orderkey", "p_brand")


@query("repository_hits", "SELECT user_id, count(*) AS calls, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS texts FROM events GROUP BY user_id")
def repository_hits(spark, sf_dir):
    return groups.call_texts(read(spark, sf_dir, "events"), "user_id", "event_type").withColumn("texts", F.array_join("texts", ","))


@query("anti_services", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_services(spark, sf_dir):
    services = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return groups.without_services(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), services, "c_custkey")


@query("same_package", "SELECT o_orderkey, min(p_type) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey HAVING min(p_type) = max(p_type)")
def same_package(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return groups.same_value(rows.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")), "o_orderkey", "p_type")


# --- similarity --------------------------------------------------------------------------------------------------------------


@query("char_vector_cosine", """
WITH v AS (SELECT conv_id, [count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant'), count(*) FILTER (role = 'system')] AS v FROM conversations GROUP BY conv_id),
c AS (SELECT v, min(conv_id) AS id FROM v GROUP BY v)
SELECT c.id AS a, v.conv_id AS b, 1.0::DOUBLE AS cosine, true AS member FROM v JOIN c ON c.v = v.v AND c.id <> v.conv_id WHERE list_sum(v.v) > 0 UNION ALL
SELECT *, false FROM (SELECT x.id AS a, y.id AS b, list_inner_product(x.v::DOUBLE[], y.v::DOUBLE[]) / (sqrt(list_inner_product(x.v::DOUBLE[], x.v::DOUBLE[])) * sqrt(list_inner_product(y.v::DOUBLE[], y.v::DOUBLE[]))) AS cosine
FROM c x JOIN c y ON x.id < y.id WHERE list_inner_product(x.v::DOUBLE[], y.v::DOUBLE[]) > 0) WHERE cosine >= 0.9::DOUBLE""")
def char_vector_cosine(spark, sf_dir):
    return similarity.similar_vectors(similarity.char_vectors(read(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"]), 0.9)


@query("multiset_jaccard", """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), n AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL),
k AS MATERIALIZED (SELECT page_id, string_agg(tag || n, ' ' ORDER BY tag) AS key, CAST(sum(n) AS BIGINT) AS size FROM n GROUP BY page_id), c AS MATERIALIZED (SELECT min(page_id) AS id, key, size FROM k GROUP BY key, size),
m AS MATERIALIZED (SELECT id, tag, n, size FROM c JOIN n ON n.page_id = c.id),
p AS (SELECT x.id AS a, y.id AS b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS inter, CAST(any_value(x.size) + any_value(y.size) - sum(least(x.n, y.n)) AS BIGINT) AS uni FROM m x JOIN m y ON x.tag = y.tag AND x.id < y.id GROUP BY x.id, y.id)
SELECT a, b, inter, uni, inter::DOUBLE / uni AS jaccard, false AS member FROM p WHERE inter::DOUBLE / uni >= 0.8::DOUBLE UNION ALL
SELECT c.id, k.page_id, k.size, k.size, 1.0::DOUBLE, true FROM k JOIN c ON c.key = k.key AND c.id <> k.page_id""")
def multiset_jaccard(spark, sf_dir):
    tags = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return similarity.similar_multisets(similarity.multisets(tags, "page_id", "tag"), 0.8)


@query("name_similarity")
def name_similarity(spark, sf_dir):
    """Jaro-Winkler of all pairs of distinct part names; SQL engines round transpositions otherwise."""
    return similarity.similar_names(read(spark, sf_dir, "part"), "p_name", 0.5)


def _turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("node"), F.col("role").alias("label"))
    edges = turns.alias("x").join(turns.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.node") + 1 == F.col("y.node"))).select(F.col("x.g").alias("g"), F.col("x.node").alias("src"), F.col("y.node").alias("dst"), F.lit("data").alias("tag"))
    return turns, edges


def _colour(r: int) -> str:
    return f"c{r} AS MATERIALIZED (SELECT g, node, c || '<' || coalesce(lag(c) OVER w, '-') || '>' || coalesce(lead(c) OVER w, '-') AS c FROM c{r - 1} WINDOW w AS (PARTITION BY g ORDER BY node))"


_WL = f"""
WITH s AS (SELECT conv_id AS g, string_agg(role, ' ' ORDER BY turn, role) AS shape, count(*) AS n FROM conversations GROUP BY conv_id), reps AS MATERIALIZED (SELECT shape, min(g) AS g, any_value(n) AS n FROM s GROUP BY shape),
c0 AS MATERIALIZED (SELECT conv_id AS g, turn AS node, role AS c FROM conversations WHERE conv_id IN (SELECT g FROM reps)), {", ".join(_colour(r) for r in (1, 2, 3))},
h AS MATERIALIZED ({" UNION ALL ".join(f"SELECT g, {r} AS r, c, count(*) AS n FROM c{r} GROUP BY g, c" for r in range(4))}),
p AS (SELECT x.g AS a, y.g AS b, least(x.n, y.n, 4) AS h, greatest(x.n, y.n) AS big FROM reps x JOIN reps y ON x.g < y.g AND greatest(x.n, y.n) <= 2 * least(x.n, y.n)),
i AS (SELECT p.a, p.b, sum((p.h - x.r) * least(x.n, y.n)) AS common FROM p JOIN h x ON x.g = p.a AND x.r < p.h JOIN h y ON y.g = p.b AND y.r = x.r AND y.c = x.c GROUP BY p.a, p.b)
"""


def _shapes(spark, sf_dir):
    turns, edges = _turns(spark, sf_dir)
    shape = turns.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "label"))), lambda x: x["label"]), " ").alias("shape"))
    reps = shape.groupBy("shape").agg(F.min("g").alias("g"), F.size(F.split("shape", " ")).alias("n"))
    pairs = reps.alias("x").join(reps.alias("y"), (F.greatest("x.n", "y.n") <= 2 * F.least("x.n", "y.n")) & (F.col("x.g") < F.col("y.g"))).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"))
    own = reps.select("g")
    return shape, reps, pairs, turns.join(own, "g", "left_semi"), edges.join(own, "g", "left_semi")


@query("wl_similarity", _WL + """SELECT p.a, p.b, CAST(1000 * coalesce(common, 0) // (p.h * (p.h + 1) // 2 * p.big) AS BIGINT) AS similarity, false AS member FROM p LEFT JOIN i USING (a, b)
UNION ALL SELECT reps.g, s.g, 1000, true FROM s JOIN reps USING (shape) WHERE reps.g <> s.g""")
def wl_similarity(spark, sf_dir):
    """Graph kernel on conversations, one of each shape, of pairs whose sizes differ by at most a factor of 2; and, with member true,
    each of these with the others of its shape. The SQL's colours are strings."""
    shape, reps, pairs, turns, edges = _shapes(spark, sf_dir)
    members = shape.join(reps.select("shape", F.col("g").alias("a")), "shape").filter("a <> g").select("a", F.col("g").alias("b"), F.lit(1000).cast("long").alias("similarity"), F.lit(True).alias("member"))
    return similarity.wl_similarity(similarity.wl_histograms(turns, edges), pairs, similarity.graph_rounds(edges, turns)).withColumn("member", F.lit(False)).union(members)


@query("wl_at_least", _WL + "SELECT p.a, p.b FROM p JOIN i USING (a, b) WHERE 1000 * common // (p.h * (p.h + 1) // 2 * p.big) >= 600")
def wl_at_least(spark, sf_dir):
    _, _, pairs, turns, edges = _shapes(spark, sf_dir)
    return similarity.wl_at_least(similarity.wl_histograms(turns, edges), pairs, similarity.graph_rounds(edges, turns), 600)


@query("wl_colours", _WL + """, q AS (SELECT g, r, c, n FROM h) SELECT r AS round, CAST(count(*) AS BIGINT) AS colours, CAST(sum(m) AS BIGINT) AS nodes, max(k) AS graphs FROM (SELECT r, c, sum(n) AS m, count(*) AS k FROM q GROUP BY r, c) GROUP BY r""")
def wl_colours(spark, sf_dir):
    """Colours of each round, their nodes, and the most graphs that share one; independent of how colours are hashed."""
    _, _, _, turns, edges = _shapes(spark, sf_dir)
    h = similarity.wl_histograms(turns, edges).groupBy("round", "color").agg(F.sum("n").alias("m"), F.count("*").alias("k"))
    return h.groupBy("round").agg(F.count("*").alias("colours"), F.sum("m").cast("long").alias("nodes"), F.max("k").alias("graphs"))


@query("clone_groups")
def clone_groups(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity.clone_groups(vectors, 64, 0.4)


@query("exact_clones", r"SELECT min(doc_id) AS root, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')) HAVING count(*) >= 2")
def exact_clones(spark, sf_dir):
    return similarity.equal_texts(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("embedding_cosine", """
SELECT a.vec_id, CAST(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) * 1000000 AS BIGINT) AS micro
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", "embedding"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.rint(cosine(F.col("embedding"), F.col("other")) * 1000000).cast("long").alias("micro"))


# --- graphs --------------------------------------------------------------------------------------------------------------------

_FLOW = "(SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL HAVING count(*) * 60000 > {} * (SELECT count(*) FROM lineitem))"
_REACH = "e AS MATERIALIZED (SELECT * FROM {}), r(seed, node) AS (SELECT n_nationkey, n_nationkey FROM nation {} UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node {})"


def _flow(spark, sf_dir, least: int):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sup = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    n = li.count()
    flow = li.join(sup, "l_suppkey").groupBy("l_orderkey", "dst").count().join(orders, "l_orderkey").filter("src <> dst").groupBy("src", "dst").agg(F.sum("count").alias("w"))
    return flow.filter(F.col("w") * 60000 > F.lit(least * n).cast("long")).select(F.lit(0).alias("g"), "src", "dst")


def _nations(spark, sf_dir, where: str = "true"):
    return read(spark, sf_dir, "nation").filter(where).select(F.lit(0).alias("g"), F.col("n_nationkey").cast("long").alias("seed"))


@query("reachability", "WITH RECURSIVE " + _REACH.format(_FLOW.format(150), "", "") + " SELECT CAST(seed AS BIGINT) AS seed, CAST(node AS BIGINT) AS node FROM r")
def reachability(spark, sf_dir):
    return graphs.closure(_flow(spark, sf_dir, 150), _nations(spark, sf_dir)).select("seed", "node")


@query("barrier_slice", "WITH RECURSIVE " + _REACH.format(_FLOW.format(150), "", "WHERE e.dst % 5 <> 0") + " SELECT CAST(seed AS BIGINT) AS seed, count(*) AS size FROM r GROUP BY seed")
def barrier_slice(spark, sf_dir):
    blocked = _nations(spark, sf_dir, "n_nationkey % 5 = 0").withColumnRenamed("seed", "node")
    return graphs.closure(_flow(spark, sf_dir, 150), _nations(spark, sf_dir), blocked).groupBy("seed").agg(F.count("*").alias("size"))


@query("chop", "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM " + _FLOW.format(150) + "), f(node) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b(node) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT e.src FROM b JOIN e ON e.dst = b.node) SELECT CAST(node AS BIGINT) AS node FROM f JOIN b USING (node)")
def chop(spark, sf_dir):
    return graphs.chop(_flow(spark, sf_dir, 150), _nations(spark, sf_dir, "n_regionkey = 0"), _nations(spark, sf_dir, "n_regionkey = 2")).select("node")


@query("scc", "WITH RECURSIVE " + _REACH.format(_FLOW.format(150), "", "") + " SELECT CAST(x.seed AS BIGINT) AS node, CAST(min(x.node) AS BIGINT) AS root, count(*) AS size FROM r x JOIN r y ON x.seed = y.node AND x.node = y.seed WHERE x.seed IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY x.seed")
def scc(spark, sf_dir):
    return graphs.strong_components(_flow(spark, sf_dir, 150)).select("node", "root", "size")


@query("taint", "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM " + _FLOW.format(150) + "), r(seed, node, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_regionkey = 0 UNION SELECT r.seed, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE e.dst <> 7 AND r.hops < 25), h AS (SELECT e.dst AS sink, r.hops + 1 AS hops, r.seed FROM r JOIN e ON e.src = r.node JOIN nation ON n_nationkey = e.dst AND n_regionkey = 3 WHERE r.seed <> e.dst) SELECT CAST(sink AS BIGINT) AS sink, CAST(min(struct_pack(h := hops, s := seed)).s AS BIGINT) AS source, min(hops) AS hops FROM h GROUP BY sink")
def taint(spark, sf_dir):
    nodes = lambda where: _nations(spark, sf_dir, where).withColumnRenamed("seed", "node")
    return graphs.taint(_flow(spark, sf_dir, 150), _nations(spark, sf_dir, "n_regionkey = 0"), nodes("n_nationkey = 7"), nodes("n_regionkey = 3")).select("sink", "source", "hops")


@query("components", "WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM " + _FLOW.format(180) + "), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(seed, node) AS (SELECT src, src FROM u UNION SELECT r.seed, u.dst FROM r JOIN u ON u.src = r.node) SELECT CAST(seed AS BIGINT) AS node, CAST(min(node) AS BIGINT) AS root FROM r GROUP BY seed")
def components(spark, sf_dir):
    return graphs.components(_flow(spark, sf_dir, 180), "src", "dst")


@query("fix_groups", """
WITH RECURSIVE v AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal < 500 AS callers FROM supplier WHERE s_acctbal < 3000), p AS MATERIALIZED (SELECT DISTINCT o_custkey AS caller, l_suppkey AS callee FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
feet AS MATERIALIZED (SELECT id, id AS node FROM v UNION SELECT id, 1000000000 + caller FROM v JOIN p ON callee = id WHERE callers),
l AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM feet x JOIN feet y USING (node)), r(id, node) AS (SELECT id, id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.node)
SELECT id, min(node) AS root FROM r GROUP BY id""")
def fix_groups(spark, sf_dir):
    """Suppliers of a balance below 3,000 break a rule, below 500 one that concerns their callers, the customers of all their lines."""
    viol = read(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 500).alias("callers"))
    calls = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return callgraph.fix_groups(viol, calls.select((F.col("o_custkey") + 1000000000).alias("caller"), F.col("l_suppkey").alias("callee")).distinct())


# --- intervals and sequences ---------------------------------------------------------------------------------------------

_SPAN = "SELECT user_id, event_type, CAST(min(epoch_us(ts)) AS BIGINT) AS start, CAST(max(epoch_us(ts)) AS BIGINT) AS \"end\" FROM events GROUP BY ALL"
_WIDTH = 86_400_000_000


@query("interval_overlap", f"""
SELECT s.user_id, s.event_type, count(*) AS hits FROM ({_SPAN}) s JOIN (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error') r
  ON s.user_id = r.user_id AND s.start <= r.t + 3600000000 AND r.t <= s."end" GROUP BY ALL""")
def interval_overlap(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.groupBy("user_id", "event_type").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    ranges = e.filter("event_type = 'error'").select("user_id", F.col("us").alias("lo"), (F.col("us") + 3_600_000_000).alias("hi")).distinct().withColumn("r", F.col("lo"))
    hits = intervals.overlap_pairs(spans.withColumn("i", F.concat_ws("|", "user_id", "event_type")), ranges, "user_id", _WIDTH, "i", "r")
    return hits.groupBy("item").agg(F.count("*").alias("hits")).select(F.split("item", r"\|")[0].cast("long").alias("user_id"), F.split("item", r"\|")[1].alias("event_type"), "hits")


@query("point_in_interval", f"""
SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'error' AND r.user_id = e.user_id AND epoch_us(e.ts) BETWEEN epoch_us(r.ts) AND epoch_us(r.ts) + {_WIDTH})""")
def point_in_interval(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ranges = e.filter("event_type = 'error'").select("user_id", F.col("us").alias("lo"), (F.col("us") + _WIDTH).alias("hi"))
    return intervals.overlaps(e.select("event_id", "user_id", F.col("us").alias("start"), F.col("us").alias("end")), ranges, "user_id", _WIDTH).select("event_id")


@query("forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def forward_fill(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("own", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return intervals.forward_fill(e, ["user_id"], ["ts", "event_id"], "own", "last_purchase").select("event_id", "last_purchase")


@query("running_position", "SELECT event_id, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS position FROM events")
def running_position(spark, sf_dir):
    return intervals.running_total(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") != "error", 1).otherwise(0), "position").select("event_id", "position")


@query("adjacent_marks", """
SELECT event_id, coalesce(lag(event_id) OVER w, last_value(event_id) OVER f) AS previous, coalesce(lead(event_id) OVER w, first_value(event_id) OVER f) AS next FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def adjacent_marks(spark, sf_dir):
    return intervals.neighbours(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous", "next")


@query("relocate_unique", """
WITH n AS (SELECT source || ':' || n_chars AS k, count(*) AS c, min(doc_id) AS t FROM documents GROUP BY 1 HAVING count(*) = 1), x AS (SELECT text, count(*) AS c, min(doc_id) AS t FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) = 1)
SELECT d.doc_id AS anchor, coalesce(n.t, x.t) AS target FROM documents d LEFT JOIN n ON n.k = d.source || ':' || d.n_chars LEFT JOIN x ON x.text = d.text""")
def relocate_unique(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("source"), F.lit(":"), F.col("n_chars").cast("string")).alias("name"))
    return intervals.relocate(d.select(F.col("doc_id").alias("anchor"), "text", "name"), d, "name", "text", "doc_id")


@query("half_weight_cut", """
SELECT p_brand, min(struct_pack(o := abs(2 * run - total), c := rn)).c AS cut FROM (
  SELECT p_brand, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS total,
    CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS rn FROM part) GROUP BY p_brand""")
def half_weight_cut(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("neg", -F.col("p_size"))
    return intervals.half_point(part, ["p_brand"], ["neg", "p_partkey"], "p_size")


# --- reports ---------------------------------------------------------------------------------------------------------------------


@query("union_ranked", f"""
SELECT kind, observation, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY score DESC, kind, observation) AS INTEGER) AS rank FROM (
  SELECT 'belief' AS kind, 'supplier ' || callee AS observation, 800 AS score FROM ({_BELIEF}) UNION ALL
  SELECT 'density', 'user ' || user_id, least(density, 1000) FROM ({_DENSITY}) WHERE density > 500) ORDER BY rank LIMIT 100""")
def union_ranked(spark, sf_dir):
    a = beliefs(spark, sf_dir).select(F.concat(F.lit("supplier "), F.col("callee").cast("string")).alias("observation"), F.lit(800).cast("long").alias("score"))
    b = _densities(spark, sf_dir).filter("density > 500").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("observation"), F.least(F.col("density"), F.lit(1000)).cast("long").alias("score"))
    both = report.union_ranked({"belief": a, "density": b})
    return rollup.keep_top(both, "score", 0, 100, F.col("score").desc(), F.col("kind"), F.col("observation")).select("kind", "observation", "score", "rank")


@query("treemap")
def treemap(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("weight"))
    return reduction.treemaps(sizes, "p_brand", "p_type", "weight")


# --- streams -----------------------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, name, build):
    import uuid

    from ..operators.checkpoint import shared_dir
    from ..streaming import rates

    stream = rates.file_stream(spark, f"{sf_dir}/events.parque[t]", read(spark, sf_dir, "events").schema)
    return rates.run_available(build(stream), f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}")


@query("stream_density", f"SELECT user_id, weight, effects, complete FROM ({_DENSITY})")
def stream_density(spark, sf_dir):
    from ..streaming import rates

    kind = F.lit("none")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return _streamed(spark, sf_dir, "density", lambda s: rates.stream_density(s.withColumn("kind", kind), "user_id", "kind", quality.WEIGHTS))


@query("stream_beliefs", "SELECT user_id AS callee, count(*) AS sites, count(*) FILTER (event_type <> 'error') AS checked FROM events GROUP BY user_id")
def stream_beliefs(spark, sf_dir):
    from ..streaming import rates

    return _streamed(spark, sf_dir, "beliefs", lambda s: rates.stream_beliefs(s.withColumn("ok", F.col("event_type") != "error"), "user_id", "ok"))


from . import details, sources  # noqa: E402,F401  they put their queries into the same tables
