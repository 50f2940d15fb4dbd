"""Queries that go through sources and sinks, and the whole report from facts, with SQL on the tables they were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clones, graphs, groups, policy, quality, reduction, report, rollup, similarity
from ..operators.checkpoint import cut, shared_dir
from ..sources import facts
from .catalog import _FLOW, _flow, query, read


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PREFIXES = [("os.", "io"), ("net.", "network"), ("fmt.", "none")]


def _functions(spark, sf_dir):
    """Customers as functions: an order is a write, those of high totals effects, urgent ones calls."""
    o = read(spark, sf_dir, "orders")
    write = F.struct(F.col("o_orderpriority").alias("root"), F.col("o_orderstatus").alias("root_id"), F.lit("").alias("field_path"), F.col("o_orderkey").cast("int").alias("line"), F.when(F.col("o_orderstatus") == "F", "external").when(F.col("o_orderstatus") == "O", "local").otherwise("unknown").alias("provenance"))
    effect = F.struct(F.lit("time").alias("kind"), F.lit("d").alias("detail"), F.col("o_orderkey").cast("int").alias("line"), F.lit("").alias("via"))
    callee = F.when(F.col("o_orderpriority") == "1-URGENT", "os.Open").when(F.col("o_orderpriority") == "2-HIGH", "net.Dial").when(F.col("o_orderpriority") == "3-MEDIUM", "fmt.Sprint").otherwise("other")
    call = F.struct(callee.alias("callee"), F.col("o_orderkey").cast("int").alias("line"), F.lit(False).alias("dynamic"), F.lit(False).alias("local"), F.array().cast("array<struct<kind: string, param: int>>").alias("args"))
    hit = F.struct(F.when(F.col("o_orderstatus") == "F", "aggregate").otherwise("repository").alias("rule_id"), F.lit(1).alias("line"), F.col("o_orderpriority").alias("detail"))
    own = o.groupBy("o_custkey").agg(
        F.count("*").cast("int").alias("statements"), F.collect_list(write).alias("mutations"), F.collect_list(F.when(F.col("o_totalprice") > 200000, effect)).alias("effects"),
        F.collect_list(F.when(F.col("o_totalprice") > 150000, call)).alias("calls"), F.collect_list(F.when(F.col("o_totalprice") > 300000, hit)).alias("ddd"),
    )
    c = read(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"))
    note = F.when(F.col("c_acctbal") < 0, "// x-allow(mutated_targets, fn_length): old").when(F.col("c_acctbal") > 9000, "// x-allow(nothing): why").otherwise("")
    return c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_custkey").cast("int").alias("line"), F.lit(1).alias("column"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("params"), (F.col("c_acctbal") > 5000).alias("has_self"),
        "statements", (F.col("statements") * 10).alias("code_lines"), F.lit("").alias("source"), note.alias("preceding_line"), "mutations", "calls", "effects", F.array().cast("array<struct<name: string, type: string, uses: int>>").alias("param_list"), "ddd",
    )


_FACTS = """
WITH o AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 0 ELSE 1 END AS call_weight, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS call_unknown FROM orders),
m AS (SELECT o_custkey, count(*) AS statements, count(DISTINCT o_orderpriority || '@' || o_orderstatus) AS targets,
  CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN call_weight ELSE 0 END) AS BIGINT) AS weight,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR (o_totalprice > 150000 AND call_unknown)) AS unknown, count(*) FILTER (o_totalprice > 150000 AND call_unknown) AS unclassified,
  count(DISTINCT o_orderpriority) FILTER (o_totalprice > 300000 AND o_orderstatus = 'F') AS aggregate, count(*) FILTER (o_totalprice > 300000 AND o_orderstatus <> 'F') AS repository FROM o GROUP BY o_custkey),
f AS (SELECT 'n' || c_nationkey AS path, CAST(c_custkey AS INTEGER) AS line, c_name AS name, c_nationkey + CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS budget, c_acctbal < 0 AS spared, c_acctbal > 9000 AS invalid, o_custkey AS k, m.*, (1000 * weight) // greatest(statements, 1) AS density FROM customer JOIN m ON o_custkey = c_custkey)
"""


@query("facts_round_trip", "SELECT c_name AS name, count(*) AS writes, count(*) FILTER (o_totalprice > 200000) AS effects FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def facts_round_trip(spark, sf_dir):
    path = _folder(spark, "facts")
    facts.write_facts(_functions(spark, sf_dir), path)
    back = facts.read_facts(spark, path, lines=True)
    w = facts.exploded(back, "mutations").groupBy("name").agg(F.count("*").alias("writes"))
    e = facts.exploded(back, "effects").groupBy("name").agg(F.count("*").alias("effects"))
    return w.join(e, "name", "left").fillna(0, ["effects"])


@query("facts_effects", _FACTS + "SELECT name, weight, density, unknown = 0 AS complete, CAST(unclassified AS INTEGER) AS unclassified FROM f")
def facts_effects(spark, sf_dir):
    f = _functions(spark, sf_dir)
    done = quality.evaluate_facts(f, quality.Config(), _PREFIXES)
    return done.select("name", "weight", "density", "complete", "unclassified")


@query("facts_diagnostics", _FACTS + """, t AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
d AS (SELECT path, line, name, 'fn_length' AS rule, CAST(statements * 10 AS BIGINT) AS actual, 200 AS max FROM f WHERE NOT spared UNION ALL SELECT path, line, name, 'fn_params', budget, 4 FROM f UNION ALL SELECT path, line, name, 'mutated_targets', targets, 3 FROM f WHERE NOT spared
  UNION ALL SELECT path, line, name, 'mutation_per_target', n, 3 FROM f JOIN t ON t.o_custkey = f.k UNION ALL SELECT path, line, name, 'side_effect_density', density, 500 FROM f WHERE statements >= 3
  UNION ALL SELECT path, line, name, 'aggregate', aggregate, 1 FROM f UNION ALL SELECT path, line, name, 'repository', repository, 0 FROM f UNION ALL SELECT path, line, name, 'invalid_suppression', 1, 0 FROM f WHERE invalid)
SELECT path, line, name, rule, CAST(actual AS BIGINT) AS actual, CAST(max AS BIGINT) AS max FROM d WHERE actual > max""")
def facts_diagnostics(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return quality.diagnostics_of(quality.evaluate_facts(f, quality.Config(), _PREFIXES)).select("path", "line", "name", "rule", "actual", "max")


@query("facts_summary", _FACTS + "SELECT count(*) AS functions, count(*) FILTER (unknown > 0) AS incomplete, CAST(max(density) AS BIGINT) AS largest, CAST(sum(density) // count(*) AS BIGINT) AS mean FROM f")
def facts_summary(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return quality.summary_of(quality.evaluate_facts(f, quality.Config(), _PREFIXES)).select("functions", "incomplete", "largest", "mean")


@query("valid_paths", "SELECT page_id, NOT (url LIKE '/%' OR url = '' OR contains(url, '//') OR url LIKE '%/') AS ok FROM pages WHERE url IS NOT NULL")
def valid_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter("url is not null").select("page_id", facts.valid_paths(F.col("url")).alias("ok"))


@query("baseline_file", "SELECT l_returnflag AS rule, 1000.0::DOUBLE * sum(greatest(CAST(l_quantity AS INTEGER) - 40, 0)) / count(*) AS per_1000, 0.05::DOUBLE AS tolerance FROM lineitem GROUP BY l_returnflag")
def baseline_file(spark, sf_dir):
    from ..operators import gate

    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_quantity").cast("int").alias("actual"), F.lit(40).alias("max"))
    path = _folder(spark, "baseline")
    facts.write_baseline(gate.rule_totals(rows, rows.groupBy("rule").agg(F.count("*").alias("functions"))), path, 0.05)
    return facts.read_baseline(spark, path).select("rule", "per_1000", "tolerance")


@query("annotation_table", "SELECT 'r' || n_regionkey AS repository, n_name AS id FROM nation WHERE n_nationkey <> 6")
def annotation_table(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("repository"), F.col("n_name").alias("id"))
    table = facts.Annotations(spark, _folder(spark, "annotations"))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    table.insert(n.select("repository", "id", *[empty(c, "string") for c in ("path", "function_name")], *[empty(c, "int") for c in ("function_line", "start_line", "end_line")], *[empty(c, "string") for c in ("message", "text")]))
    table.delete(*read(spark, sf_dir, "nation").filter("n_nationkey = 6").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name").first())
    out = table.rows("r0").select("repository", "id")
    for r in range(1, 5):
        out = out.union(table.rows(f"r{r}").select("repository", "id"))
    return out


@query("cached_results", "SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def cached_results(spark, sf_dir):
    li, path = read(spark, sf_dir, "lineitem"), _folder(spark, "cache")
    count = lambda keys: li.withColumnRenamed("l_suppkey", "key").join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    keys = li.select(F.col("l_suppkey").alias("key")).distinct()
    facts.cached(count, keys.filter("key < 40"), path, 1)  # the first run; the second finds these
    return facts.cached(count, keys, path, 1)


@query("xml_titles", """
SELECT page_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '<title[^>]*>[^<]*</title>')) AS x FROM pages) GROUP BY page_id""")
def xml_titles(spark, sf_dir):
    spans = facts.xml_spans(read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content")), "title")
    return spans.groupBy(F.col("path").alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


# --- marks, candidates, obligations ---------------------------------------------------------------------------------------------


@query("marks_by_line", """
SELECT path, line, kind, -r.s AS score, r.o AS observation FROM (SELECT p_brand AS path, p_size AS line, CASE WHEN p_partkey > 100 THEN 'a' ELSE 'b' END AS kind, min(struct_pack(s := -CAST(p_retailprice AS BIGINT), o := p_name)) AS r FROM part GROUP BY 1, 2, 3)""")
def marks_by_line(spark, sf_dir):
    site = F.array(F.struct(F.col("p_brand").alias("path"), F.col("p_size").alias("line")))
    c = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") > 100, "a").otherwise("b").alias("kind"), F.rint("p_retailprice").cast("long").alias("score"), F.col("p_name").alias("observation"), site.alias("sites"))
    return report.marks_by_line(report.markers(c))


@query("hidden_implements", "SELECT p_partkey, NOT (contains(p_name, 'red') OR p_name LIKE 'bl%r') AS implements FROM part")
def hidden_implements(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", (~report.matches_any(F.col("p_name"), ["red", "bl*r"])).alias("implements"))


@query("boilerplate", "SELECT p_partkey FROM part WHERE p_size < 10 OR p_size = 50 OR p_type LIKE '%COPPER'")
def boilerplate(spark, sf_dir):
    name = F.concat(F.lit("pkg/"), F.when(F.col("p_size") < 10, "bindgen_x").when(F.col("p_size") == 50, "a.main").otherwise("main.f"))
    path = F.when(F.col("p_type").endswith("COPPER"), "a/tests/x.go").otherwise("a/testsx/x.go")
    return read(spark, sf_dir, "part").filter(report.is_boilerplate(name, path)).select("p_partkey")


@query("kind_suppression", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def kind_suppression(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("kinds", F.when(F.col("o_orderstatus") == "F", F.array(F.lit("nilerr"))))
    found = o.withColumn("rule", F.when(F.col("o_orderpriority") == "1-URGENT", "nilerr").otherwise("typednil"))
    return found.filter(~F.coalesce(F.array_contains("kinds", F.col("rule")), F.lit(False))).select("o_orderkey")


@query("deep_slices", "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM " + _FLOW.format(150) + "), r(seed, node, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT r.seed, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 2) SELECT CAST(seed AS BIGINT) AS seed, CAST(node AS BIGINT) AS node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY seed, node")
def deep_slices(spark, sf_dir):
    from .catalog import _nations

    return graphs.closure(_flow(spark, sf_dir, 150), _nations(spark, sf_dir), max_hops=2).select("seed", "node", "hops")


@query("obligations", """
WITH e AS (SELECT *, lead(event_type) OVER w AS n1, lead(event_type, 2) OVER w AS n2, lead(event_type, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM e WHERE event_type = 'signup' AND coalesce(n1, '') <> 'error' AND coalesce(n2, '') <> 'error' AND coalesce(n3, '') <> 'error'""")
def obligations(spark, sf_dir):
    """A sign-up opens a file; an error is a deferred Close of what flows into it; events of a user flow on, one to the next. A release
    counts within three steps: two to what it is given, and the last into it."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("node"), "event_type", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("after"))
    callee = F.when(F.col("event_type") == "signup", "os.Open").when(F.col("event_type") == "error", "(*os.File).Close").otherwise("x.Use")
    nodes = cut(e.select("g", "node", F.lit("call").alias("kind"), callee.alias("callee"), (F.col("event_type") == "error").alias("deferred")))
    edges = cut(e.filter("after is not null").select("g", F.col("node").alias("src"), F.col("after").alias("dst"), F.lit("data").alias("kind"), F.lit(0).alias("arg")))
    return graphs.obligations(nodes, edges, hops=2).select(F.col("node").alias("event_id"))


@query("template_profile", "SELECT user_id AS g, count(*) AS size FROM events GROUP BY user_id HAVING count(*) >= 30 AND count(*) FILTER (event_type = 'purchase') >= 2")
def template_profile(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "call").otherwise("op")
    return clones.mineable(read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), kind.alias("kind")), 30, 2)


@query("policy_kinds", "SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'io' ELSE 'unknown' END AS kind FROM part")
def policy_kinds(spark, sf_dir):
    callee = F.concat(F.replace("p_name", F.lit(" "), F.lit("[T].")), F.lit("<U>"))
    named = read(spark, sf_dir, "part").select("p_partkey", policy.normalized_callee(callee).alias("callee"))
    return policy.longest_prefix(named, "callee", [("red", "io"), ("red[", "time")], "unknown").select("p_partkey", "kind")


# --- fixes, reductions, clones ----------------------------------------------------------------------------------------------------


@query("applied_edits", "SELECT 'c' || c_custkey AS path, upper(c_name[1:4]) || '-' || c_name[9:] AS text, CAST(2 AS INTEGER) AS applied, CAST(1 AS INTEGER) AS skipped FROM customer")
def applied_edits(spark, sf_dir):
    """Three edits of each customer's name, bottom up: the last one overlaps what is done, and is skipped."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("text"))
    edit = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), new.alias("replacement"))
    edits = c.select("path", F.explode(F.array(edit(0, 4, F.upper(F.left("text", F.lit(4)))), edit(4, 8, F.lit("-")), edit(2, 6, F.lit("?")))).alias("e")).select("path", "e.*")
    return reduction.apply_edits(edits, c)


@query("reduced_lines", "SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation WHERE n_regionkey = 3")
def reduced_lines(spark, sf_dir):
    """The nations' names, reduced to what still has all of one region's."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the text of one reduction is the driver's
    wanted = {r.n_name for r in rows if r.n_regionkey == 3}
    text, _ = reduction.reduce_lines("".join(f"{r.n_name}\n" for r in rows), lambda t: wanted <= set(t.split("\n")))
    return spark.createDataFrame([(text,)], "text string")


@query("nested_report", "SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS functions FROM orders GROUP BY o_custkey")
def nested_report(spark, sf_dir):
    nested = rollup.nested_report(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", order=["o_orderkey"])
    return nested.withColumn("functions", F.array_join(F.transform("functions", lambda f: F.concat_ws(":", f["o_orderkey"].cast("string"), f["o_orderstatus"])), ","))


@query("common_root", "SELECT 'a' AS root")
def common_root(spark, sf_dir):
    paths = read(spark, sf_dir, "part").select(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/x.go")).alias("p"))
    return reduction.common_root(paths, "p")


@query("structure_changes", """
SELECT coalesce(x.k, y.k) AS id, CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' WHEN x.h = y.h THEN 'cosmetic' ELSE 'structural' END AS change
FROM (SELECT c_custkey AS k, c_nationkey AS h FROM customer WHERE c_acctbal > 0) x FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 99 ELSE c_nationkey END AS h FROM customer WHERE c_acctbal < 8000) y ON x.k = y.k""")
def structure_changes(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.filter("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("h"))
    new = c.filter("c_acctbal < 8000").select("c_custkey", F.when(F.col("c_acctbal") > 5000, 99).otherwise(F.col("c_nationkey")).alias("h"))
    return similarity.structure_changes(old, new, "c_custkey", "h")


@query("inconsistent_pairs", """
WITH RECURSIVE t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), n AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT page_id, string_agg(tag || n, ' ' ORDER BY tag) AS key, CAST(sum(n) AS BIGINT) AS size FROM n GROUP BY page_id), c AS MATERIALIZED (SELECT min(page_id) AS id, size FROM k GROUP BY key, size), m AS MATERIALIZED (SELECT id, tag, n, size FROM c JOIN n ON n.page_id = c.id),
p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, CAST(1000 * sum(least(x.n, y.n)) // (any_value(x.size) + any_value(y.size) - sum(least(x.n, y.n))) AS BIGINT) AS s FROM m x JOIN m y ON x.tag = y.tag AND x.id < y.id GROUP BY x.id, y.id),
e AS MATERIALIZED (SELECT a, b FROM p WHERE s >= 950 UNION SELECT b, a FROM p WHERE s >= 950), r(node, root) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.root), g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT DISTINCT x.root FROM p JOIN g x ON x.node = p.a JOIN g y ON y.node = p.b AND y.root = x.root WHERE s >= 950 AND s < 980""")
def inconsistent_pairs(spark, sf_dir):
    """Groups of pages whose tags are alike to 950 thousandths, in which some pair is not alike to 980."""
    tags = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    pairs = similarity.similar_multisets(similarity.multisets(tags, "page_id", "tag"), 0.95).filter("not member").select("a", "b", F.expr("1000 * inter div uni").alias("similarity"))
    pairs = cut(pairs.filter("similarity >= 950"))
    found = graphs.components(pairs).select(F.col("node").alias("g"), "root")
    return clones.inconsistent(found, pairs, 950, 980)


@query("comparable_pairs", """
WITH s AS (SELECT user_id AS g, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS calls FROM events GROUP BY user_id)
SELECT x.g AS a, y.g AS b FROM s x JOIN s y ON x.g + 1 = y.g WHERE x.n >= 4 AND y.n >= 4 AND x.calls >= 1 AND y.calls >= 1 AND greatest(x.n, y.n) <= 2 * least(x.n, y.n)""")
def comparable_pairs(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "call").otherwise("op")
    size = clones.mineable(read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), kind.alias("kind")))
    x, y = size.select(F.col("g").alias("a"), F.col("size").alias("sa")), size.select(F.col("g").alias("b"), F.col("size").alias("sb"))
    return clones.comparable(x.join(y, F.col("a") + 1 == F.col("b")), "sa", "sb").select("a", "b")


@query("placeholder_names", "SELECT p_partkey FROM part WHERE p_size >= 26")
def placeholder_names(spark, sf_dir):
    item = F.when(F.col("p_size") < 26, F.concat(F.lit("tmp:"), F.col("p_type"))).otherwise(F.concat(F.lit("street:"), F.col("p_type")))
    p = read(spark, sf_dir, "part").select("p_partkey", F.array(item, F.lit("x:int")).alias("items"))
    return groups.meaningful(p, "items").select("p_partkey")
