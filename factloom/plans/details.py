"""More queries over the driver's tables: the smaller operators, one or two each, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import beliefs, callgraph, clones, gate, graphs, groups, intervals, policy, quality, records, similarity
from ..operators.checkpoint import tasks_for
from .catalog import _BELIEF, _DENSITY, _FLOW, _RULES, _densities, _flow, _nations, _sites, query, read

# --- joins and counts of records -------------------------------------------------------------------------------------------


@query("cyclomatic", "SELECT user_id, count(*) FILTER (event_type IN ('click', 'error')) + 1 AS complexity FROM events GROUP BY user_id")
def cyclomatic(spark, sf_dir):
    return records.cyclomatic(read(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error"])


@query("joined_scores", """
SELECT o_orderkey, q AS complexity, n AS cognitive, lo, hi FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) b ON b.l_orderkey = o_orderkey JOIN (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) c ON c.l_orderkey = o_orderkey""")
def joined_scores(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    a = li.groupBy("o_orderkey").agg(F.sum("l_quantity").cast("long").alias("complexity"))
    b = li.filter("l_discount > 0.05").groupBy("o_orderkey").agg(F.count("*").alias("cognitive"))
    c = li.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    known = read(spark, sf_dir, "orders").select("o_orderkey")
    return records.joined_scores(a, b, c, ["o_orderkey"]).join(known, "o_orderkey", "left_semi")


@query("with_quality", "SELECT c_custkey, c_name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey")
def with_quality(spark, sf_dir):
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return records.with_quality(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query("last_of_key", "SELECT o_custkey, r.o AS o_orderkey, r.s AS o_orderstatus FROM (SELECT o_custkey, max(struct_pack(d := o_orderdate, o := o_orderkey, s := o_orderstatus)) AS r FROM orders GROUP BY o_custkey)")
def last_of_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return records.last_of_key(o, ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderstatus").drop("o_orderdate")


@query("first_edges", "SELECT src, dst, r.t AS tag FROM (SELECT l_suppkey AS src, l_linenumber AS dst, min(struct_pack(o := l_orderkey, p := l_partkey, q := l_extendedprice, t := l_returnflag)) AS r FROM lineitem GROUP BY 1, 2)")
def first_edges(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst"), F.col("l_returnflag").alias("tag"), "l_orderkey", "l_partkey", "l_extendedprice")
    return records.first_edges(e, ["src", "dst"], "l_orderkey", "l_partkey", "l_extendedprice", "tag").select("src", "dst", "tag")


@query("annotation_targets", """
WITH a AS (SELECT c_custkey, c_nationkey + 5 AS path, c_nationkey % 7 AS function FROM customer), f AS (SELECT n_nationkey AS path, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS file_index FROM nation),
g AS (SELECT n_nationkey AS path, n_regionkey AS function, CAST(n_nationkey * 10 AS BIGINT) AS function_index FROM nation)
SELECT a.path, a.function, c_custkey, coalesce(file_index, (SELECT count(*) FROM f)) AS file_index, coalesce(function_index, -1) AS function_index FROM a LEFT JOIN f USING (path) LEFT JOIN g ON g.path = a.path AND g.function = a.function""")
def annotation_targets(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    notes = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 5).alias("path"), (F.col("c_nationkey") % 7).alias("function"))
    files = n.select(F.col("n_nationkey").alias("path"), (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long").alias("file_index"))
    return records.annotation_targets(notes, files, n.select(F.col("n_nationkey").alias("path"), F.col("n_regionkey").alias("function"), (F.col("n_nationkey") * 10).cast("long").alias("function_index")))


_NOTES = "SELECT doc_id, source AS path, lang AS function, n_chars AS start_line, length(text) + 3 AS end_line FROM documents"


def _notes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("function"), F.col("n_chars").alias("start_line"), (F.length("text") + 3).alias("end_line"))


@query("visible_annotations", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY path, function ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, doc_id) AS INTEGER) AS position FROM ({_NOTES})")
def visible_annotations(spark, sf_dir):
    return records.visible_annotations(_notes(spark, sf_dir), ["path", "function"], "doc_id").select("doc_id", "position")


@query("annotation_counts", f"SELECT path, function, count(*) AS n, false AS whole FROM ({_NOTES}) GROUP BY path, function UNION ALL SELECT path, NULL, count(*), true FROM ({_NOTES}) GROUP BY path")
def annotation_counts(spark, sf_dir):
    return records.annotation_counts(_notes(spark, sf_dir))


@query("diff_counts", "SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'R') AS deleted FROM lineitem GROUP BY l_linenumber")
def diff_counts(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted")
    return records.diff_counts(read(spark, sf_dir, "lineitem").withColumn("kind", kind), "l_linenumber", "kind")


@query("rule_sets", "SELECT user_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (" + " UNION ".join(f"SELECT user_id, '{r}' AS rule FROM ({_DENSITY}) WHERE {c} > {n}" for r, (c, n) in _RULES.items()) + ") GROUP BY user_id")
def rule_sets(spark, sf_dir):
    d = quality.diagnostics(_densities(spark, sf_dir), ["user_id"], {r: c for r, (c, _) in _RULES.items()}, {r: n for r, (_, n) in _RULES.items()})
    return records.rule_sets(d, ["user_id"], "rule").withColumn("rules", F.array_join("rules", ","))


@query("hole_ordinals", """
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_extendedprice, CAST(o AS INTEGER) AS ordinal, upper(l_returnflag[1]) || o AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS o FROM lineitem)""")
def hole_ordinals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return records.hole_ordinals(rows, ["l_orderkey"], "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").drop("l_suppkey")


@query("compacted_history", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 64 OR i % 2 = 0 OR i = n - 1""")
def compacted_history(spark, sf_dir):
    return records.compacted(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 64).select("event_id")


@query("mean_coverage", "SELECT p_brand, count(*) AS support, CAST(sum(p_size) // count(*) AS BIGINT) AS coverage FROM part GROUP BY p_brand")
def mean_coverage(spark, sf_dir):
    return records.mean_coverage(read(spark, sf_dir, "part"), "p_brand", "p_size")


@query("ranked_candidates", """
SELECT p_brand, score, CAST(row_number() OVER (ORDER BY score DESC, sites) AS INTEGER) AS rank FROM (
  SELECT p_brand, CAST(count(*) // 10 AS BIGINT) AS score, list(struct_pack(path := p_type, line := p_size, id := p_partkey, name := p_name) ORDER BY p_type, p_size, p_partkey, p_name) AS sites FROM part GROUP BY p_brand)""")
def ranked_candidates(spark, sf_dir):
    sites = F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))))
    c = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.expr("count(*) div 10").alias("score"), sites.alias("sites"))
    return records.ranked_candidates(c, "score", "sites").drop("sites")


@query("ordered_effects", """
SELECT o_custkey, string_agg(d || ':' || o_orderpriority || ':' || o_orderkey, ',' ORDER BY d, o_orderpriority, o_orderkey) AS effects FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS d FROM orders) GROUP BY o_custkey""")
def ordered_effects(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("line"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("detail"))
    each = F.transform("effects", lambda x: F.concat_ws(":", x["line"].cast("string"), x["kind"], x["detail"].cast("string")))
    return records.ordered_effects(e, ["o_custkey"]).withColumn("effects", F.array_join(each, ","))


@query("top_templates", """
WITH w AS (SELECT DISTINCT o_orderpriority AS g, l_orderkey AS f, p_brand AS t FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT x.g, x.t AS a, y.t AS b, count(*) AS s FROM w x JOIN w y ON x.f = y.f AND x.t < y.t GROUP BY ALL), m AS (SELECT g, a AS member, s FROM p UNION ALL SELECT g, b, s FROM p)
SELECT * FROM (SELECT g, member, CAST(sum(s) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY g ORDER BY sum(s) DESC, member) AS INTEGER) AS rank FROM m GROUP BY g, member) WHERE rank <= 3""")
def top_templates(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = tasks_for(li.count())
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("t"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct(F.col("o_orderpriority").alias("g")).alias("g"))
    ts = li.repartition(n, "l_partkey").join(part, "l_partkey").select("l_orderkey", "t").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    gs = orders.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    return records.top_templates(records.pairs_of_sets(ts.join(gs, "l_orderkey"), "ts", "gs"), "g")


@query("usable_graphs", "SELECT user_id, count(*) FILTER (event_type = 'error') AS nodes FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 0")
def usable_graphs(spark, sf_dir):
    return records.usable_graphs(read(spark, sf_dir, "events").withColumn("node", F.when(F.col("event_type") == "error", F.col("event_id"))), "user_id", "node")


@query("canonical_order", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal, s_suppkey) AS INTEGER) AS position FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def canonical_order(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("path"), F.col("s_acctbal").alias("line"))
    return records.canonical_order(s, read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey").select("s_suppkey", "position")


@query("parameterizable", "SELECT p_name, count(DISTINCT p_type) AS holes FROM part GROUP BY p_name HAVING NOT bool_and(p_size > 25) AND NOT bool_or(p_size = 50) AND count(DISTINCT p_type) <= 6")
def parameterizable(spark, sf_dir):
    return records.parameterizable(read(spark, sf_dir, "part"), "p_name", F.col("p_size") > 25, F.col("p_size") == 50, F.col("p_type"), 6)


_DAYS = "SELECT user_id, event_type, CAST(min(epoch_us(ts)) // 86400000000 AS BIGINT) AS s, CAST(max(epoch_us(ts)) // 86400000000 AS BIGINT) AS e FROM events WHERE event_type IN ('view', 'signup') GROUP BY ALL"


@query("diff_in_functions", f"""
SELECT f.user_id, f.event_type, count(*) AS lines FROM ({_DAYS}) f JOIN events l ON l.user_id = f.user_id AND l.event_type IN ('click', 'error')
  AND f.s <= epoch_us(l.ts) // 86400000000 AND epoch_us(l.ts) // 86400000000 <= f.e + CASE l.event_type WHEN 'error' THEN 1 ELSE 0 END GROUP BY ALL""")
def diff_in_functions(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.expr("unix_micros(cast(ts as timestamp)) div 86400000000"))
    f = e.filter("event_type in ('view', 'signup')").groupBy("user_id", "event_type").agg(F.min("day").alias("start"), F.max("day").alias("end")).withColumn("item", F.concat_ws("|", "user_id", "event_type"))
    lines = e.filter("event_type in ('click', 'error')").select("user_id", F.col("event_id").alias("line"), F.when(F.col("event_type") == "error", "deleted").otherwise("added").alias("kind"), F.col("day").alias("at"))
    hits = records.diff_in_functions(f, lines, "user_id", 8).groupBy("item").agg(F.count("*").alias("lines"))
    return hits.select(F.split("item", r"\|")[0].cast("long").alias("user_id"), F.split("item", r"\|")[1].alias("event_type"), "lines")


@query("fixes_of_kind", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def fixes_of_kind(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("fix", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return records.fixes_of_kind(o, "1-URGENT", "o_orderpriority", "fix").select("o_orderkey", "o_orderpriority")


@query("changed_diagnostics", "SELECT d.user_id AS path, 'f' AS name, d.rule FROM (" + " UNION ALL ".join(f"SELECT user_id, '{r}' AS rule FROM ({_DENSITY}) WHERE {c} > {n}" for r, (c, n) in _RULES.items()) + ") d WHERE d.user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND hour(ts) < 3)")
def changed_diagnostics(spark, sf_dir):
    d = quality.diagnostics(_densities(spark, sf_dir), ["user_id"], {r: c for r, (c, _) in _RULES.items()}, {r: n for r, (_, n) in _RULES.items()})
    touched = read(spark, sf_dir, "events").filter("event_type = 'error' and hour(ts) < 3").select(F.col("user_id").alias("path"), F.lit("f").alias("name"))
    return quality.changed_only(d.select(F.col("user_id").alias("path"), F.lit("f").alias("name"), "rule"), touched)


# --- labels, texts, paths -----------------------------------------------------------------------------------------------------


@query("node_labels", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'call:' || 'local' || ':' || user_id WHEN 'view' THEN 'lit:' || user_id WHEN 'error' THEN 'op:' || 'add' WHEN 'signup' THEN 'param:' ELSE event_type END AS label FROM events""")
def node_labels(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "lit").when(F.col("event_type") == "error", "op").when(F.col("event_type") == "signup", "param").otherwise(F.col("event_type"))
    own = F.col("user_id").cast("string")
    return read(spark, sf_dir, "events").select("event_id", labels.node_label(kind, F.lit("local"), own, own, F.lit("add:int"), F.lit(None).cast("string")).alias("label"))


@query("signature_keys", "SELECT conv_id, 'fn(' || string_agg(role, ',' ORDER BY turn, role) || ')' AS key FROM conversations GROUP BY conv_id")
def signature_keys(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(labels.signature_key(F.transform(ordered, lambda x: x["role"])).alias("key"))


@query("ramp_colours", """
WITH c AS (SELECT p_partkey, p_size, CAST(least(p_size, 30) AS INTEGER) AS s FROM part), i AS (SELECT *, least(s // 10, 2) AS i FROM c), f AS (SELECT *, (s - i * 10) / 10.0::DOUBLE AS f FROM i)
SELECT p_partkey, """ + ", ".join(f"CAST(floor([{', '.join(str(x[k]) for x in labels.RAMP)}][i + 1] + f * ([{', '.join(str(x[k]) for x in labels.RAMP)}][i + 2] - [{', '.join(str(x[k]) for x in labels.RAMP)}][i + 1])) AS INTEGER) AS {n}" for k, n in enumerate("rgb")) + " FROM f")
def ramp_colours(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", labels.ramp_colour(F.col("p_size")).alias("c")).select("p_partkey", "c.*")


@query("code_lines", "SELECT doc_id, len([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, ' ') <> '' AND NOT starts_with(ltrim(x, ' '), 'The')]) AS lines FROM documents")
def code_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", labels.code_lines(F.col("text"), "The").cast("long").alias("lines"))


@query("unique_lines", """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[3] AS n FROM documents), p AS (SELECT doc_id, n, chr(10) || text || chr(10) AS t, chr(10) || n || chr(10) AS m FROM d),
i AS (SELECT *, instr(t, m) AS pos FROM p)
SELECT doc_id, CASE WHEN trim(n, ' ') <> '' AND pos > 0 AND instr(substr(t, pos + 1), m) = 0 THEN CAST(10 + length(substr(t, 1, pos - 1)) - length(replace(substr(t, 1, pos - 1), chr(10), '')) AS INTEGER) END AS line FROM i""")
def unique_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.try_element_at(F.split("text", "\n"), F.lit(3)).alias("n"))
    return d.select("doc_id", labels.unique_line(F.col("text"), F.col("n"), F.lit(10)).alias("line"))


@query("within_limits", "SELECT conv_id, turn, coalesce(length(trim(text, ' ')) >= 1 AND length(text) <= 160, false) AS ok, CASE WHEN length(text) * 100 BETWEEN 0 AND 60000 THEN length(text) * 100 END AS wait FROM conversations")
def within_limits(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", labels.within(F.col("text")).alias("ok"), labels.clamped_wait(F.length("text").cast("long") * 100).alias("wait"))


_PATHS = "SELECT p_partkey, 'src/' || lower(replace(p_name, ' ', '_')) || CASE WHEN p_size < 10 THEN '/user_repo/x.go' WHEN p_size < 20 THEN '/store.go' WHEN p_size < 30 THEN '/storefront/a.go' ELSE '/main.go' END AS path FROM part"


def _paths(spark, sf_dir):
    tail = F.when(F.col("p_size") < 10, "/user_repo/x.go").when(F.col("p_size") < 20, "/store.go").when(F.col("p_size") < 30, "/storefront/a.go").otherwise("/main.go")
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.concat(F.lit("src/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), tail).alias("path"))


@query("repository_paths", f"SELECT p_partkey FROM ({_PATHS}) WHERE path LIKE '%/user_repo/%' OR path LIKE '%/store.go'")
def repository_paths(spark, sf_dir):
    return _paths(spark, sf_dir).filter(labels.is_repository_path(F.col("path"))).select("p_partkey")


@query("damped_scores", "SELECT p_partkey, CAST(CASE p_brand WHEN 'Brand#11' THEN p_size // 2 WHEN 'Brand#12' THEN p_size // 3 ELSE p_size END AS BIGINT) AS score FROM part")
def damped_scores(spark, sf_dir):
    kind = F.when(F.col("p_brand") == "Brand#11", "generic_fn").when(F.col("p_brand") == "Brand#12", "parameterize").otherwise("trait_method")
    return read(spark, sf_dir, "part").select("p_partkey", labels.damped(F.col("p_size"), kind).alias("score"))


@query("short_names", """
SELECT p_partkey, list_last(string_split(d, '.')) AS short, array_to_string(string_split(d, '.')[-2:], '.') AS two, list_last(string_split(path, '/')) AS file FROM (SELECT p_partkey, path, replace(p_name, ' ', '.') || '.' || p_size AS d FROM part JOIN (""" + _PATHS + """) USING (p_partkey))""")
def short_names(spark, sf_dir):
    d = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_size").cast("string"))
    return _paths(spark, sf_dir).select("p_partkey", text.short_name(d).alias("short"), text.last_two(d).alias("two"), text.after_slash(F.col("path")).alias("file"))


@query("bit_names", """
SELECT o_orderkey, CASE WHEN o_custkey & 7 = 0 THEN 'pure' ELSE array_to_string([x FOR x IN [CASE WHEN o_custkey & 1 > 0 THEN 'io' END, CASE WHEN o_custkey & 2 > 0 THEN 'net' END, CASE WHEN o_custkey & 4 > 0 THEN 'global' END] IF x IS NOT NULL], '|') END AS names FROM orders""")
def bit_names(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.bit_names(F.col("o_custkey").cast("int"), ["io", "net", "global"]).alias("names"))


@query("candidate_scores", """
SELECT p_partkey, CAST(round((1000.0::DOUBLE * ln(greatest(p_size, 1)::DOUBLE) + 300) * 900 / 1000.0::DOUBLE * CASE WHEN p_partkey & 7 > 3 THEN 3.0::DOUBLE / (p_partkey & 7) ELSE 1.0::DOUBLE END * CASE WHEN p_size > 40 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS score, printf('%.2f', p_size / 1000.0::DOUBLE) AS shown FROM part""")
def candidate_scores(spark, sf_dir):
    holes = F.col("p_partkey").cast("int").bitwiseAND(F.lit(7))
    return read(spark, sf_dir, "part").select("p_partkey", text.candidate_score(F.col("p_size"), F.lit(300), F.lit(900), holes, F.col("p_size") > 40).alias("score"), text.milli(F.col("p_size")).alias("shown"))


@query("next_sequence", "SELECT coalesce(max(CAST(substr(c_name, 10) AS BIGINT)), 0) + 1 AS next FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]+$')")
def next_sequence(spark, sf_dir):
    return read(spark, sf_dir, "customer").agg(text.next_sequence(F.col("c_name"), "Customer#").alias("next"))


@query("plain_callees", r"SELECT p_partkey, replace(regexp_replace(p_name, ' .*', ''), '::::', '::') || '::f' AS callee FROM part")
def plain_callees(spark, sf_dir):
    words = F.split("p_name", " ")
    raw = F.concat(words[0], F.lit("<"), F.coalesce(words[1], F.lit("")), F.lit("[a<b>]>::f[[x]y]"))
    return read(spark, sf_dir, "part").select("p_partkey", policy.normalized_callee(raw).alias("callee"))


_COMMENTS = {"F": "// x-allow(fn_length, fn_params): old code", "O": "//lint:ignore fn_length Legacy code", "P": "// x-allow(nothing): why"}


@query("suppressed_rules", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fn_length,fn_params' WHEN 'O' THEN 'fn_length' ELSE '' END AS rules, o_orderstatus = 'P' AS invalid FROM orders")
def suppressed_rules(spark, sf_dir):
    note = F.lit("")
    for k, v in _COMMENTS.items():
        note = F.when(F.col("o_orderstatus") == k, v).otherwise(note)
    found = policy.suppressions(read(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")), "note", ["fn_length", "fn_params", "invalid_suppression"])
    return found.select("o_orderkey", F.array_join("suppressed", ",").alias("rules"), "invalid")


# --- groups, clones, callers ------------------------------------------------------------------------------------------------


@query("mineable", "SELECT user_id AS g, count(*) AS size FROM events GROUP BY user_id HAVING count(*) >= 4 AND count(*) FILTER (event_type = 'signup') >= 1")
def mineable(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "call").otherwise("op")
    return clones.mineable(read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), kind.alias("kind")))


@query("rarest_blocks", """
WITH o AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), df AS (SELECT item, count(*) AS df FROM o GROUP BY item),
r AS (SELECT id, item FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY df, item) AS r FROM o JOIN df USING (item)) WHERE r <= 2), f AS (SELECT item FROM r GROUP BY item HAVING count(*) <= 1000), k AS (SELECT * FROM r JOIN f USING (item))
SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.item = y.item AND x.id < y.id""")
def rarest_blocks(spark, sf_dir):
    return similarity.rarest_blocks(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("effect_union", """
WITH m AS (SELECT o_custkey, o_orderpriority, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END) AS b FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(min(b) AS INTEGER) AS bits FROM m GROUP BY o_custkey HAVING min(b) = max(b)""")
def effect_union(spark, sf_dir):
    bit = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return groups.effect_union(read(spark, sf_dir, "orders").withColumn("b", bit), "o_custkey", "o_orderpriority", "b")


@query("site_counts", """
SELECT coalesce(i.k, o.k) AS id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) i FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) o ON i.k = o.k""")
def site_counts(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.lit(None).cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    b = read(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    return callgraph.site_counts(a.union(b)).filter("id is not null")


@query("backward_sizes", "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM " + _FLOW.format(150) + "), r(seed, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.seed, e.src FROM r JOIN e ON e.dst = r.node) SELECT CAST(seed AS BIGINT) AS seed, count(*) AS size, CAST(least(400 + 10 * count(*), 800) AS BIGINT) AS score FROM r GROUP BY seed")
def backward_sizes(spark, sf_dir):
    return graphs.backward_sizes(_flow(spark, sf_dir, 150), _nations(spark, sf_dir)).select("seed", "size", graphs.slice_score(F.col("size")).cast("long").alias("score"))


@query("thin_slices", "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM " + _FLOW.format(150) + " WHERE src < dst), r(seed, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.seed, e.src FROM r JOIN e ON e.dst = r.node) SELECT CAST(seed AS BIGINT) AS seed, count(*) AS size FROM r GROUP BY seed")
def thin_slices(spark, sf_dir):
    e = _flow(spark, sf_dir, 150).withColumn("kind", F.when(F.col("src") < F.col("dst"), "data").otherwise("ctrl"))
    return graphs.backward_sizes(graphs.thin_edges(e), _nations(spark, sf_dir)).select("seed", "size")


@query("helper_effects", """
WITH RECURSIVE c AS MATERIALIZED (SELECT src AS caller, dst AS callee FROM """ + _FLOW.format(150) + """ WHERE src < dst),
x AS MATERIALIZED (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'io' ELSE 'time' END AS kind FROM nation),
r(root, node, path) AS (SELECT n_nationkey, n_nationkey, [n_nationkey] FROM nation UNION ALL SELECT r.root, c.callee, list_append(r.path, c.callee) FROM r JOIN c ON c.caller = r.node)
SELECT CAST(root AS BIGINT) AS id, kind, count(*) AS n FROM r JOIN x ON x.id = r.node GROUP BY root, kind""")
def helper_effects(spark, sf_dir):
    """Effects along the paths of an acyclic graph of calls; cycles and limits are tested in Python."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_regionkey") < 2, "io").otherwise("time").alias("kind"))
    calls = _flow(spark, sf_dir, 150).filter("src < dst").select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return callgraph.helper_effects(n.select("id"), n, calls)


_SETS = "(SELECT o_custkey AS s, list_sort(list(DISTINCT o_orderpriority)) AS items FROM orders GROUP BY o_custkey)"


@query("bundles", f"""
WITH c AS MATERIALIZED (SELECT items, count(*) AS n FROM {_SETS} GROUP BY items), m AS (SELECT list_sort(list_intersect(x.items, y.items)) AS items FROM c x JOIN c y ON x.items < y.items UNION SELECT items FROM c),
k AS MATERIALIZED (SELECT m.items, CAST(sum(c.n) AS BIGINT) AS sites FROM (SELECT DISTINCT items FROM m WHERE len(items) >= 2) m JOIN c ON list_has_all(c.items, m.items) GROUP BY m.items)
SELECT array_to_string(items, '|') AS items, sites FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.sites = x.sites AND len(y.items) > len(x.items) AND list_has_all(y.items, x.items))""")
def bundles(spark, sf_dir):
    found = callgraph.bundles(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return found.select(F.array_join("items", "|").alias("items"), "sites")


@query("first_of_key", "SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey")
def first_of_key(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    return records.first_edges(li, ["l_suppkey"], "l_orderkey")


@query("overridden", "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT DISTINCT l_orderkey, 'x' FROM lineitem WHERE l_quantity > 45")
def overridden(spark, sf_dir):
    over = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.lit("x").alias("v")).distinct()
    return intervals.override(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), over, "k")


@query("ranked_groups", """
SELECT l_suppkey AS key, sites AS score, CAST(row_number() OVER (ORDER BY sites DESC, callee) AS INTEGER) AS rank FROM (""" + _BELIEF + """) JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey = callee""")
def ranked_groups(spark, sf_dir):
    b = beliefs.beliefs(_sites(spark, sf_dir), "l_suppkey", "ok")
    return records.ranked_groups(b.select(F.col("callee").alias("key"), F.col("sites").alias("score")))


# --- diffs --------------------------------------------------------------------------------------------------------------------

_HUNKS = """(SELECT o_orderkey AS diff, 'a/' || o_orderstatus || '.go' AS path, CAST(o_custkey % 97 + 1 AS INTEGER) AS first, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _diff(spark, sf_dir):
    """A diff for each order: a header, one hunk, and for each of its lines an added one, then a deleted one."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    tasks = tasks_for(li.count())
    n = li.repartition(tasks, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").repartition(tasks, "o_orderkey").join(n, "o_orderkey").withColumn("at", (F.col("o_custkey") % 97 + 1).cast("int"))
    lines = F.concat(
        F.array(F.lit("--- a/x"), F.concat(F.lit("+++ b/a/"), F.col("o_orderstatus"), F.lit(".go")), F.format_string("@@ -%d,%d +%d,%d @@", F.col("at"), F.col("n"), F.col("at"), F.col("n"))),
        F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.array(F.concat(F.lit("+new "), i.cast("string")), F.concat(F.lit("-old "), i.cast("string"))))),
    )
    return o.select(F.col("o_orderkey").alias("diff"), F.posexplode(lines).alias("seq", "line"))


@query("diff_lines", f"""
SELECT diff, path, k AS kind, CAST(first + i - 1 AS BIGINT) AS old_line, CAST(first + i - CASE k WHEN 'added' THEN 1 ELSE 0 END AS BIGINT) AS new_line, CASE k WHEN 'added' THEN 'new ' ELSE 'old ' END || i AS text
FROM {_HUNKS}, (SELECT unnest(range(1, 200)) AS i), (VALUES ('added'), ('deleted')) v(k) WHERE i <= n""")
def diff_lines(spark, sf_dir):
    got = intervals.diff_lines(_diff(spark, sf_dir))
    return got.select("diff", "path", "kind", F.col("old_line").cast("long").alias("old_line"), F.col("new_line").cast("long").alias("new_line"), "text")


@query("diff_ranges", f"SELECT diff, path, first AS lo, CAST(first + n - 1 AS INTEGER) AS hi FROM {_HUNKS}")
def diff_ranges(spark, sf_dir):
    return intervals.diff_ranges(_diff(spark, sf_dir))


# --- gates and reports ----------------------------------------------------------------------------------------------------------


@query("rule_totals", "SELECT l_returnflag AS rule, CAST(40 AS BIGINT) AS \"limit\", CAST(sum(greatest(CAST(l_quantity AS INTEGER) - 40, 0)) AS BIGINT) AS excess, count(*) AS functions, 1000.0::DOUBLE * sum(greatest(CAST(l_quantity AS INTEGER) - 40, 0)) / count(*) AS per_1000 FROM lineitem GROUP BY l_returnflag")
def rule_totals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_quantity").cast("int").alias("actual"), F.lit(40).alias("max"))
    return gate.rule_totals(rows, rows.groupBy("rule").agg(F.count("*").alias("functions"))).select("rule", F.col("limit").cast("long").alias("limit"), "excess", "functions", "per_1000")
