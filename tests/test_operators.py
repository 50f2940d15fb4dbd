"""Operators that no SQL states: against small answers worked out by hand or by a plain version."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import beliefs, callgraph, gate, graphs, groups, intervals, policy, quality, reduction, report, rollup, rules, similarity


def rows(df, *order):
    return sorted(map(tuple, df.collect()))


def test_jaro_winkler(spark):
    assert tx.jaro_winkler("", "") == 1 and tx.jaro_winkler("a", "") == 0
    assert tx.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611111)
    assert tx.jaro_winkler("red widget", "large gear") == pytest.approx(0.5667, abs=1e-4)
    df = spark.createDataFrame([("abcdef", "abcxyz"), ("abcdefgh", "abcdezzz"), ("x", "y"), (None, "a")], "a string, b string")
    assert [r.a for r in tx.names_at_least(df, "a", "b", 0.4).orderBy("a").collect()] == ["abcdef", "abcdefgh"]


def test_names(spark):
    df = spark.createDataFrame([("a/b.c/pkg.Type.Method",), ("os.Open",)], "c string")
    got = [tuple(r) for r in df.select(tx.short_name(F.col("c")), tx.last_two(F.col("c")), tx.has_receiver(F.col("c")), tx.owner_package(F.col("c"))).collect()]
    assert got == [("Method", "Type.Method", True, "a/b.c/pkg"), ("Open", "os.Open", False, "os")]
    assert spark.range(1).select(tx.bit_names(F.lit(5), ["io", "net", "time"])).first()[0] == "io|time"
    assert spark.range(1).select(tx.bit_names(F.lit(0), ["io"])).first()[0] == "pure"
    scopes = spark.createDataFrame([("fmt.Println",), ("len",), ("",), ("example.com/x.F",)], "c string")
    assert [r[0] for r in scopes.select(tx.call_scope(F.col("c"), ["fmt", "os"])).collect()] == ["std", "builtin", "unknown", "local"]
    one = spark.range(1)
    assert one.select(tx.candidate_score(F.lit(10), F.lit(500), F.lit(900), F.lit(2), F.lit(False))).first()[0] == round((1000 * 2.302585093 + 500) * 0.9)
    ids = spark.createDataFrame([("annotation-3",), ("annotation-12",), ("x",)], "id string")
    assert ids.agg(tx.next_sequence(F.col("id"), "annotation-")).first()[0] == 13


def test_policy(spark):
    df = spark.createDataFrame([("os.Open",), ("os.Other",), ("x",), (None,)], "c string")
    got = {r.c: r.kind for r in policy.longest_prefix(df, "c", [("os.", "io"), ("os.O", "time"), ("os.O", "global")], "unknown").collect()}
    assert got == {"os.Open": "global", "os.Other": "global", "x": "unknown", None: "unknown"}
    names = spark.createDataFrame([("a.F[map[int]string]",), ("a::::b<T>",)], "c string")
    assert [r[0] for r in names.select(policy.normalized_callee(F.col("c"))).collect()] == ["a.F", "a::b"]
    lines = spark.createDataFrame([("// qa-allow(fn_length): long table",), ("// qa-allow(fn_length)",), ("// qa-allow(nope): x",), ("//lint:ignore fn_params Generated code",), ("x = 1",), (None,)], "l string")
    got = [(r.suppressed, r.invalid) for r in policy.suppressions(lines, "l", ["fn_length", "fn_params"]).collect()]
    assert got == [(["fn_length"], False), ([], True), ([], True), (["fn_params"], False), ([], False), ([], False)]


def test_quality(spark):
    m = spark.createDataFrame([("f", "r", "1", "a", "external")] * 4 + [("f", "l", "2", "", "local"), ("g", "r", "1", "", "unknown")], "f string, root string, root_id string, field_path string, provenance string")
    effects = quality.mutation_effects(m)
    st = spark.createDataFrame([("f", 4), ("g", 0), ("h", 9)], "f string, statements int")
    got = {r.f: (r.density, r.complete) for r in quality.effect_density(effects, "f", "kind", st, "statements", quality.WEIGHTS).collect()}
    assert got == {"f": (1000, True), "g": (1000, False), "h": (0, True)}
    facts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(quality.canonical(facts, ["k"])) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="differ"):
        quality.canonical(facts.union(spark.createDataFrame([("a", 9)], "k string, v int")), ["k"]).collect()
    with pytest.raises(ValueError):
        quality.Config(limits={"nope": 1})


def test_gate_statuses(spark):
    now = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0), ("c", 1, 10.0), ("d", 1, 0.0)], "rule string, limit long, per_1000 double")
    base = spark.createDataFrame([("a", 1, 10.2), ("b", 1, 8.0), ("c", 1, 20.0), ("z", 1, 5.0)], "rule string, limit long, per_1000 double")
    assert {r.rule: r.status for r in gate.check(now, base, 0.05).collect()} == {"a": "ok", "b": "regression", "c": "improvement", "d": "ok"}
    with pytest.raises(Exception, match="limit"):
        gate.check(now, base.withColumn("limit", F.lit(2).cast("long")), 0.05).collect()


def random_edges(seed, n=12, m=20):
    rng = random.Random(seed)
    return sorted({(0, rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def reach(edges, start, blocked=()):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for _, a, b in edges:
            if a == x and b not in seen and b not in blocked:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "g int, src long, dst long")
    seeds = spark.createDataFrame([(0, i) for i in range(12)], "g int, seed long")
    got = {(r.seed, r.node) for r in graphs.closure(df, seeds).collect()}
    assert got == {(i, j) for i in range(12) for j in reach(edges, i)}
    blocked = spark.createDataFrame([(0, 3), (0, 5)], "g int, node long")
    got = {(r.seed, r.node) for r in graphs.closure(df, seeds, blocked).collect()}
    assert got == {(i, j) for i in range(12) for j in reach(edges, i, (3, 5))}
    scc = {r.node: r.root for r in graphs.strong_components(df).collect()}
    nodes = {x for _, a, b in edges for x in (a, b)}
    assert scc == {i: min(j for j in reach(edges, i) if i in reach(edges, j)) for i in nodes}
    both = edges + [(0, b, a) for _, a, b in edges]
    comp = {r.node: r.root for r in graphs.components(df, "src", "dst").collect()}
    linked = {x for _, a, b in edges if a != b for x in (a, b)}
    assert comp == {i: min(reach(both, i)) for i in linked}


def test_long_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in graphs.components(links).collect()} == {0, 100}


def test_chop_taint_clusters(spark):
    e = spark.createDataFrame([(0, 1, 2, 1), (0, 2, 3, 1), (0, 1, 4, 0), (0, 4, 5, 1), (0, 9, 3, 2)], "g int, src long, dst long, arg int")
    at = lambda *x: spark.createDataFrame([(0, i) for i in x], "g int, seed long")
    assert {r.node for r in graphs.chop(e, at(1), at(3)).collect()} == {1, 2, 3}
    nodes = lambda *x: at(*x).withColumnRenamed("seed", "node")
    sinks = spark.createDataFrame([(0, 3, 1), (0, 5, None)], "g int, node long, arg int")
    assert rows(graphs.taint(e, at(1), nodes(4), sinks)) == [(0, 3, 1, 2)]
    assert rows(graphs.taint(e, at(1, 9), nodes(), sinks.limit(2))) == [(0, 3, 1, 2), (0, 5, 1, 2)]
    ring = spark.createDataFrame([(0, i, (i + 1) % 3) for i in range(3)], "g int, src long, dst long")
    n = spark.createDataFrame([(0, 8)], "g int, nodes int")
    assert graphs.dependence_clusters(ring, n).count() == 1 and graphs.dependence_clusters(ring, n.withColumn("nodes", F.lit(30))).count() == 0


def test_obligations(spark):
    n = spark.createDataFrame(
        [("a", 1, "call", "os.Open", False), ("a", 2, "call", "f.Close", True), ("b", 1, "call", "os.Open", False), ("b", 2, "call", "x.Close", True), ("c", 0, "param", None, False), ("c", 1, "call", "(*sync.Mutex).Lock", False), ("c", 2, "call", "(*sync.Mutex).Unlock", True)],
        "g string, node long, kind string, callee string, deferred boolean",
    )
    e = spark.createDataFrame([("a", 1, 2, "data", 0), ("b", 9, 2, "data", 0), ("c", 0, 1, "data", 0), ("c", 0, 2, "data", 0)], "g string, src long, dst long, kind string, arg int")
    assert rows(graphs.obligations(n, e)) == [("b", 1, "file")]


def test_call_graph(spark):
    members = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2), (9, 9, 5)], "root long, id long, position int")
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "caller long, callee long")
    assert [r.id for r in callgraph.callees_first(calls.filter("caller <> 3"), members).orderBy("root", "ordinal").collect()] == [3, 2, 1, 9]
    assert [r.id for r in callgraph.callees_first(calls, members).orderBy("root", "ordinal").collect()] == [1, 3, 2, 9]
    viol = spark.createDataFrame([(2, True), (3, True), (5, False)], "id long, callers boolean")
    pairs = spark.createDataFrame([(7, 2), (7, 3), (7, 5)], "caller long, callee long")
    assert rows(callgraph.fix_groups(viol, pairs)) == [(2, 2), (3, 2), (5, 5)]
    f = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    fx = spark.createDataFrame([(3, "io"), (2, "time")], "id long, kind string")
    up = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3)], "caller long, callee long")
    assert rows(callgraph.helper_effects(f, fx, up)) == [(1, "io", 3), (1, "time", 2), (2, "io", 1), (2, "time", 1), (3, "io", 1)]
    deep = callgraph.helper_effects(f, fx, up, max_effects=2)
    assert (1, "unknown", 1) in rows(deep)
    sites = spark.createDataFrame([(s, i) for s, items in enumerate(["abc", "abc", "abd", "xy"]) for i in items], "s int, i string")
    assert sorted(("".join(r.items), r.sites) for r in callgraph.bundles(sites, "s", "i").collect()) == [("ab", 3), ("abc", 2), ("abd", 1), ("xy", 1)]
    assert rows(callgraph.site_counts(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))) == [(1, 0, 2), (2, 1, 0), (3, 1, 0)]


def test_rules_by_brute_force(spark):
    rng = random.Random(4)
    data = {b: {i for i in "abcdef" if rng.random() < 0.8} for b in range(20)}
    sets = rules.call_sets(spark.createDataFrame([(b, i) for b, s in data.items() for i in s] + [(0, ""), (1, None)], "id int, item string"), "id", "item")
    r = rules.Baskets(sets)
    n = lambda *x: sum(all(i in s for i in x) for s in data.values())
    one = {(a, b) for a, b in itertools.permutations("abcdef", 2) if n(a, b) / 20 >= 0.1 and n(a, b) / n(a) >= 0.9}
    assert {(x.a, x.b) for x in r.single().collect()} == one
    two = {(a, b, c) for a, b, c in itertools.combinations("abcdef", 3) if n(a, b, c) / 20 >= 0.1 and n(a, b, c) / n(a, b) >= 0.9}
    assert {(x.a, x.b, x.c) for x in r.double().collect()} == two
    either = lambda a, b, c: sum(a in s and (b in s or c in s) for s in data.values())
    dis = {(a, b, c) for a in "abcdef" for b, c in itertools.combinations("abcdef", 2) if a not in (b, c) and (a, b) not in one and (a, c) not in one and either(a, b, c) / 20 >= 0.1 and either(a, b, c) / n(a) >= 0.9}
    assert {(x.a, x.b, x.c) for x in r.disjunctive().collect()} == dis
    assert {(x.id, x.a, x.b) for x in rules.violations(sets, r.single()).collect()} == {(k, a, b) for k, s in data.items() for a, b in one if a in s and b not in s}
    assert {tuple(x) for x in rules.double_violations(sets, r.double()).collect()} == {(k, a, b, c) for k, s in data.items() for a, b, c in two if a in s and b in s and c not in s}
    assert {tuple(x) for x in rules.disjunctive_violations(sets, r.disjunctive()).collect()} == {(k, a, b, c) for k, s in data.items() for a, b, c in dis if a in s and b not in s and c not in s}


def test_beliefs(spark):
    df = spark.createDataFrame([("f", True)] * 9 + [("f", False)] + [("g", True)] * 4 + [("h", False)] * 6, "c string, ok boolean")
    assert [r.callee for r in beliefs.beliefs(df, "c", "ok").collect()] == ["f"]
    assert [(r.c, r.ok) for r in beliefs.belief_violations(df, "c", "ok").collect()] == [("f", False)]


def test_clumps(spark):
    own = {1: "ab", 2: "ab", 3: "ab", 4: "abc", 5: "abc", 6: "q", 7: "xy", 8: "xy", 9: "xy"}
    df = spark.createDataFrame([(f, f"{i}:int") for f, s in own.items() for i in s], "f int, item string")
    got = {("".join(x[0] for x in r.items), r.functions) for r in groups.data_clumps(df, "f", "item").collect()}
    assert got == {("ab", 5), ("xy", 3)}
    named = {("".join(x[0] for x in r.items), r.functions) for r in groups.data_clumps(df.replace("a:int", "total:int"), "f", "item", placeholders=groups.PLACEHOLDERS).collect()}
    assert named == {("bt", 5)}


def test_groups(spark):
    df = spark.createDataFrame([(1, "userEmail", "string"), (2, "email_of", "string"), (3, "valid", "int")], "f int, name string, type string")
    assert rows(groups.primitive_groups(df, "f", "name", "type", groups.CONCEPTS)) == [("email", "string", 2)]
    e = spark.createDataFrame([("x", 1, 1), ("x", 1, 4), ("x", 2, 5), ("y", 1, 1), ("y", 2, 2)], "g string, m int, bits int")
    assert rows(groups.effect_union(e, "g", "m", "bits")) == [("x", 5)]
    assert rows(groups.all_match(e, "g", F.col("bits") < 5)) == [("y", 2)]


def test_similar_multisets_by_brute_force(spark):
    rng = random.Random(6)
    data = {i: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for i in range(60)}
    bags = similarity.multisets(spark.createDataFrame([(i, c) for i, s in data.items() for c in s], "id int, item string"), "id", "item")
    got = {(r.a, r.b): (r.inter, r.uni) for r in similarity.similar_multisets(bags, 0.7).filter("not member").collect()}
    first = {}
    for i in sorted(data):
        first.setdefault("".join(sorted(data[i])), i)
    want = {}
    for (x, a), (y, b) in itertools.permutations(first.items(), 2):
        inter = sum(min(x.count(c), y.count(c)) for c in "abc")
        uni = len(x) + len(y) - inter
        if a < b and inter / uni >= 0.7:
            want[a, b] = (inter, uni)
    assert got == want


def wl_plain(a, b, h):
    def colors(labels, edges):
        c, out = dict(labels), []
        for _ in range(h):
            out.append(sorted(map(str, c.values())))
            c = {v: (c[v], tuple(sorted(str(c[s]) for s, d in edges if d == v)), tuple(sorted(str(c[d]) for s, d in edges if s == v))) for v in c}
        return out

    x, y, top, bottom = colors(*a), colors(*b), 0, 0
    for i in range(h):
        top += (h - i) * sum(min(x[i].count(k), y[i].count(k)) for k in set(x[i]))
        bottom += (h - i) * max(len(x[i]), len(y[i]))
    return 1000 * top // bottom


def test_wl_similarity(spark):
    graphs_ = {0: ("uaua", 4), 1: ("uauu", 4), 2: ("uaua", 4), 3: ("suaua", 5)}
    n = spark.createDataFrame([(g, i, c) for g, (s, _) in graphs_.items() for i, c in enumerate(s)], "g long, node long, label string")
    e = spark.createDataFrame([(g, i, i + 1, "data") for g, (s, _) in graphs_.items() for i in range(len(s) - 1)], "g long, src long, dst long, tag string")
    r = similarity.graph_rounds(e, n)
    assert {x.rounds for x in r.collect()} == {4}
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    got = {(x.a, x.b): x.similarity for x in similarity.wl_similarity(similarity.wl_histograms(n, e), pairs, r).collect()}
    plain = lambda g: (list(enumerate(graphs_[g][0])), [(i, i + 1) for i in range(len(graphs_[g][0]) - 1)])
    assert got == {(a, b): wl_plain(plain(a), plain(b), 4) for a, b in ((0, 1), (0, 2), (0, 3))} and got[0, 2] == 1000


def test_clone_groups_recall(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(15)]
    data = [(i, v) for i, v in enumerate(base)] + [(100 + i, [x + rng.gauss(0, 0.01) for x in v]) for i, v in enumerate(base)]
    got = {r.id: r.root for r in similarity.clone_groups(spark.createDataFrame(data, "id long, v array<double>"), 8, 0.99).collect()}
    assert all(got.get(i) == got.get(100 + i) == i for i in range(15))


def test_diff(spark):
    text = ["--- a/x.go", "+++ b/x.go", "@@ -1,3 +1,4 @@", " a", "-b", "+B", "+C", " c", "--- a/y.go", "+++ b/y.go", "@@ -5,2 +4,0 @@", "-p", "-q"]
    df = spark.createDataFrame(list(enumerate(text)), "seq int, line string")
    got = [(r.path, r.kind, r.old_line, r.new_line, r.text) for r in intervals.diff_lines(df).orderBy("seq").collect()]
    assert got == [("x.go", "deleted", 2, 2, "b"), ("x.go", "added", 3, 2, "B"), ("x.go", "added", 3, 3, "C"), ("y.go", "deleted", 5, 4, "p"), ("y.go", "deleted", 6, 4, "q")]
    assert rows(intervals.diff_ranges(df)) == [("x.go", 1, 4), ("y.go", 4, 4)]
    files = spark.createDataFrame([("n.go", "a\nb\n"), ("e.go", "")], "path string, content string")
    whole = intervals.untracked_ranges(files)
    assert rows(whole) == [("n.go", 1, 3)]
    assert rows(intervals.override(intervals.diff_ranges(df), whole.withColumn("path", F.lit("x.go")), "path")) == [("x.go", 1, 3), ("y.go", 4, 4)]


def test_overlaps_by_brute_force(spark):
    rng = random.Random(2)
    items = [(i, rng.randint(0, 2), s, s + rng.randint(0, 40)) for i in range(60) for s in [rng.randint(0, 100)]]
    ranges = [(i, rng.randint(0, 2), s, s + rng.randint(0, 20)) for i in range(20) for s in [rng.randint(0, 100)]]
    x = spark.createDataFrame(items, "id int, k int, start int, end int")
    y = spark.createDataFrame(ranges, "r int, k int, lo int, hi int")
    want = {(i[0], r[0]) for i in items for r in ranges if i[1] == r[1] and i[2] <= r[3] and r[2] <= i[3]}
    got = intervals.overlap_pairs(x, y, "k", 16, "id", "r").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sorted(r.id for r in intervals.overlaps(x, y, "k", 16).collect()) == sorted({i for i, _ in want})


def test_covers(spark):
    df = spark.createDataFrame([("a/b.go", "b.go", 5, 3, 7), ("b.go", "a/b.go", 3, 3, 0), ("ab.go", "b.go", 3, 3, 0), ("b.go", "b.go", 9, 3, 7)], "p string, q string, l int, s int, e int")
    c = F.col
    assert [r[0] for r in df.select(intervals.covers(c("p"), c("q"), c("l"), c("s"), c("e"))).collect()] == [True, True, False, False]


def test_reports(spark):
    kind = "score long, observation string, sites array<struct<path:string,line:int>>"
    a = spark.createDataFrame([(5, "x", [("a", 2)]), (9, "y", [("a", 1)])], kind)
    b = spark.createDataFrame([(5, "w", [("a", 2), ("b", 1)]), (5, "x", [("a", 2)])], kind)
    got = [(r.score, r.kind, r.observation) for r in report.best_first(report.union_ranked({"k2": a, "k1": b})).collect()]
    assert got == [(9, "k2", "y"), (5, "k1", "x"), (5, "k2", "x"), (5, "k1", "w")]
    specs = spark.createDataFrame([("entity_identity", "a", 1), ("guard_clause", "a", 1), ("guard_clause", "a", 9)], "kind string, path string, line int")
    assert [(r.kind, r.line) for r in report.fix_order(specs).collect()] == [("guard_clause", 9), ("guard_clause", 1), ("entity_identity", 1)]
    ids = spark.createDataFrame([("x/tests/a",), ("bindgen_x.go",), ("core.latest",)], "p string")
    assert [r[0] for r in ids.select(report.is_boilerplate(F.col("p"), F.lit("a.go"))).collect()] == [True, True, False]
    assert spark.range(1).select(report.is_boilerplate(F.lit("a.main.F"), F.lit("a.go")), report.is_boilerplate(F.lit("a.main"), F.lit("a.go")), report.is_boilerplate(F.lit("a.F"), F.lit("x/tests/a.go"))).first()[:] == (False, True, True)
    assert [r[0] for r in ids.select(report.matches_any(F.col("p"), ["x/*a", "core"])).collect()] == [True, False, True]
    assert [r.id for r in report.first_by_id(spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "id int, v int"), "id", F.col("v")).orderBy("id").collect()] == [1, 2]


def test_rollup_edges(spark):
    df = spark.createDataFrame([], "f string, a int, b int")
    assert rollup.rollup(df, "f", "a", "b").count() == 0
    assert tuple(rollup.report_summary(df, "a").first()) == (0, 0, 0, 0)
    assert rollup.overall_score(spark.createDataFrame([(750,), (99,)], "s long"), "s").first()[0] == 93
    nested = rollup.nested_report(spark.createDataFrame([("f", 2, "y"), ("f", 1, "x")], "f string, line int, name string"), "f", "name", order=["line"]).first()
    assert [x.name for x in nested.functions] == ["x", "y"]


def test_reducers():
    text = "".join(f"line {i}\n" for i in range(40))
    small, checks = reduction.reduce_lines(text, lambda t: "line 7\n" in t and "line 31\n" in t)
    assert small == "line 7\nline 31\n" and checks < 200
    assert reduction.reduce_lines("x\n", lambda t: False) == ("x\n", 1)
    spans = lambda t: [(i, i + 1) for i in range(len(t))] + ([(0, len(t))] if t else [])
    assert reduction.reduce_spans("aXbYc", spans, lambda t: "X" in t)[0] == "X"
    assert reduction.deletion_groups([(0, 1), (2, 3), (4, 5)])[0] == (0, 5)


def test_edits(spark):
    files = spark.createDataFrame([("a", "hello world"), ("b", "same")], "path string, text string")
    edits = spark.createDataFrame([("a", 0, 5, "HI"), ("a", 6, 11, "ALL"), ("a", 4, 7, "-"), ("a", 90, 99, "-")], "path string, start int, end int, replacement string")
    assert rows(reduction.apply_edits(edits, files)) == [("a", "HI ALL", 2, 2), ("b", "same", 0, 0)]
    assert "+b" in reduction.dry_run("a\n", "b\n", "f")


def test_treemap_and_patterns(spark):
    rects = reduction.treemap([("a", 6), ("b", 3), ("c", 3)], 0, 0, 12, 6)
    assert [(n, w * h) for n, _, _, w, h in rects] == [("a", 36), ("b", 18), ("c", 18)]
    x, y = ("f", [("a", []), ("g", [("a", [])])]), ("f", [("b", []), ("g", [("b", [])])])
    assert reduction.anti_unify(x, y) == ("f", [("?", 0), ("g", [("?", 0)])])
    paths = spark.createDataFrame([("/a/b/c/x.go",), ("/a/b/d.go",)], "p string")
    assert reduction.common_root(paths, "p").first()[0] == "/a/b"
    assert reduction.common_root(paths.limit(1), "p").first()[0] == "/a/b/c"
    assert reduction.common_root(spark.createDataFrame([("x.go",)], "p string"), "p").first()[0] == ""


def test_evaluate(spark):
    f = spark.createDataFrame([("f", 300, 4, True, 4, []), ("g", 10, 2, False, 2, ["fn_length"]), ("h", 300, 2, False, 9, ["fn_length"])], "k string, code_lines int, params int, has_self boolean, statements int, suppressed array<string>")
    e = spark.createDataFrame([("f", "io")] * 2 + [("g", "unsafe")], "k string, kind string")
    t = spark.createDataFrame([("f", "r", 4), ("g", "r", 3)], "k string, target string, n int")
    got = [(r.k, r.rule, r.actual) for r in quality.evaluate(f, e, t, ["k"], quality.Config()).orderBy("k", "position").collect()]
    assert got == [("f", "fn_length", 300), ("f", "fn_params", 5), ("f", "mutation_per_target", 4), ("f", "side_effect_density", 1500)]
    hits = spark.createDataFrame([("f", "aggregate", "A"), ("f", "aggregate", "A"), ("f", "aggregate", "B"), ("f", "repository", "q")], "k string, rule_id string, detail string")
    assert rows(quality.ddd_metrics(hits, "k")) == [("f", 2, 1, 0)]


def test_marks(spark):
    c = spark.createDataFrame([("k", 5, "x", [("p", 1), ("p", 2)]), ("k", 9, "y", [("p", 1)]), ("z", 1, "y", [("p", 1)])], "kind string, score long, observation string, sites array<struct<path:string,line:int>>")
    assert rows(report.marks_by_line(report.markers(c))) == [("p", 1, "k", 9, "y"), ("p", 1, "z", 1, "y"), ("p", 2, "k", 5, "x")]
    assert intervals.diff_base(None, "", "m", "h") == "m" and intervals.diff_base(None, None, None, "") is None


def test_phases(spark):
    todo, seen = {"guard_clause": ["a", "b"], "parameterize": ["b"]}, []

    def mine(kinds, files):
        seen.append((kinds[0], None if files is None else sorted(files)))
        return spark.createDataFrame([(k, f, 1) for k in kinds for f in todo.get(k, []) if files is None or f in files], "kind string, path string, line int")

    def apply(specs):
        done = {r.path for r in specs.collect()}
        for k in {r.kind for r in specs.collect()}:
            todo[k] = []
        return done

    assert report.run_phases(mine, apply) == (2, {"a", "b"})
    assert seen[0] == ("guard_clause", None) and seen[4] == ("guard_clause", ["a", "b"]) and len(seen) == 8
