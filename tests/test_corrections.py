"""Nothing is lost: infrequent alternatives, equal elements, equal rows, members of classes, cut-off names, limits of call chains."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import labels, text
from factloom.operators import callgraph, clones, graphs, intervals, policy, quality, records, rules, similarity, stacking
from factloom.sources import facts


def disjunctions(baskets, support=0.1, confidence=0.9):
    n, df = len(baskets), Counter(i for b in baskets for i in b)
    out = set()
    for a, k in df.items():
        own = [b for b in baskets if a in b]
        if k < -(-n // 10):
            continue
        with_a = Counter(i for b in own for i in b if i != a)
        free = sorted(b for b, m in with_a.items() if not (m / n >= support and m / k >= confidence))
        for b, c in itertools.combinations(free, 2):
            m = sum(b in x or c in x for x in own)
            if m / n >= support and m / k >= confidence:
                out.add((a, b, c, m, k))
    return out


def test_infrequent_alternatives(spark):
    baskets = [{"A", "B"}] * 9 + [{"A", "C"}] * 11 + [{"D"}] * 80
    sets = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "id int, item string")
    got = {tuple(r) for r in rules.Baskets(sets).disjunctive().collect()}
    assert ("A", "B", "C", 20, 20) in got and got == disjunctions(baskets)


@pytest.mark.parametrize("seed", range(6))
def test_disjunctions_by_brute_force(spark, seed):
    rng = random.Random(seed)
    weight = {c: rng.choice([0.03, 0.06, 0.15, 0.5, 0.85]) for c in "abcdefghij"}
    baskets = [b for b in ({c for c, w in weight.items() if rng.random() < w} for _ in range(70)) if b]
    sets = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "id int, item string")
    assert {tuple(r) for r in rules.Baskets(sets).disjunctive().collect()} == disjunctions(baskets)


def test_equal_elements(spark):
    df = spark.createDataFrame([("p", "<a>x</a> <a>x</a> <a>y</a>"), ("q", "no"), ("r", None)], "path string, content string")
    assert sorted(map(tuple, facts.xml_spans(df, "a").collect())) == [("p", 0, 8), ("p", 9, 17), ("p", 18, 26)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_equal_rows_overlap_each(spark, width):
    rng = random.Random(width)
    items = [(rng.randint(0, 2), s, s + rng.choice([0, 3, 40])) for _ in range(40) for s in [rng.randint(-20, 100)]]
    items += items[:7] + [(0, 5, 5), (0, 5, 5), (None, 1, 2)]
    ranges = [(rng.randint(0, 2), s, s + rng.choice([-1, 0, 2, 30])) for _ in range(12) for s in [rng.randint(-20, 100)]] + [(0, 5, 5), (None, 0, 9)]
    x, y = spark.createDataFrame(items, "k int, start int, end int"), spark.createDataFrame(ranges, "k int, lo int, hi int")
    want = Counter(i for i in items if any(i[0] is not None and i[0] == k and lo <= hi and i[1] <= hi and lo <= i[2] for k, lo, hi in ranges))
    assert Counter(map(tuple, intervals.overlaps(x, y, "k", width).collect())) == want


def test_members_of_classes(spark):
    rng = random.Random(3)
    bags = {i: Counter(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for i in range(40)}
    rows = spark.createDataFrame([(i, x) for i, b in bags.items() for x in b.elements()], "i int, x string")
    got = similarity.similar_multisets(similarity.multisets(rows, "i", "x"), 0.5).collect()
    root = {r.b: r.a for r in got if r.member}
    between = {(r.a, r.b) for r in got if not r.member}
    links = {(a, b) for a, b in itertools.combinations(bags, 2) if 2 * sum((bags[a] & bags[b]).values()) >= sum((bags[a] | bags[b]).values())}
    top = lambda i: root.get(i, i)
    assert {(a, b) for a, b in itertools.combinations(bags, 2) if top(a) == top(b) or (min(top(a), top(b)), max(top(a), top(b))) in between} == links


def test_vectors_by_brute_force(spark):
    rng = random.Random(4)
    data = {i: [rng.choice([0, 0, 1, 2, 5]) for _ in range(4)] for i in range(50)}
    got = similarity.similar_vectors(spark.createDataFrame(list(data.items()), "id int, v array<int>"), 0.9).collect()
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    like = lambda x, y: dot(x, x) and dot(y, y) and dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 >= 0.9 - 1e-12
    root = {r.b: r.a for r in got if r.member}
    between, top = {(r.a, r.b) for r in got if not r.member}, lambda i: root.get(i, i)
    for a, b in itertools.combinations(data, 2):
        same = top(a) == top(b) if any(data[a]) and any(data[b]) else False
        assert bool(like(data[a], data[b])) == (same or tuple(sorted((top(a), top(b)))) in between), (data[a], data[b])


def test_plain_callees(spark):
    cases = {"f[" + "[" * 9 + "]" * 9 + "]": "f", "a]b": "ab", "a<b]c": "ac", "a[b": "a", "x::<T>::y": "x::y", "M[K]<V>.F": "M.F", "é[ü].ß": "é.ß", "": ""}
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string")
    assert {r[0]: r[1] for r in df.select("c", policy.normalized_callee(F.col("c"))).collect()} == cases | {None: None}


def test_malformed_suppressions(spark):
    known = ["fn_length", "fn_params", "invalid_suppression"]
    cases = {
        "//x-allow(fn_length): why": ([], True), "// see x-allow": ([], True), "// x-allow(fn_length) why": ([], True), "// x-allow(fn_length):  ": ([], True),
        "// x-allow(invalid_suppression): why": ([], True), "// x-allow(): why": ([], True), "// x-allow(fn_length , fn_params): why): so": (["fn_length", "fn_params"], False),
        "//lint:ignore": ([], True), "//lint:ignore fn_length": ([], True), "//lint:ignore fn_length, fn_params Old code": (["fn_length", "fn_params"], False), "//lint:ignore fn_length old code": ([], True),
        "//lint:ignore Old": ([], True), "// nothing": ([], False), "  // x-allow(fn_params): y ": (["fn_params"], False),
    }
    got = policy.suppressions(spark.createDataFrame([(c,) for c in cases], "c string"), "c", known).collect()
    assert {r.c: (r.suppressed, r.invalid) for r in got} == cases


def test_settled_pairs_skip_python(spark):
    names = ["alpha", "alphabet", "alps", "beta", "be", "b", "", "gamma", "alphabets"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for least in (0.2, 0.5, 0.7, 0.9):
        got = Counter(map(tuple, text.names_at_least(pairs, "a", "b", least).collect()))
        assert got == Counter((a, b) for a in names for b in names if text.jaro_winkler(a, b) >= least)
    plan = text.names_at_least(pairs, "a", "b", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("jaro_winkler_udf") <= 2
    sure = text.names_at_least(pairs.filter("a = 'alpha' and b = 'alps'"), "a", "b", 0.1)
    assert sure.count() == 1


def test_sinks():
    assert len(graphs.TAINT_SINKS) == 13 and len(graphs.TAINT_SOURCES) == 6 and len(graphs.TAINT_SANITIZERS) == 8


def call(name, line=1, local=True, dynamic=False):
    return {"callee": name, "line": line, "local": local, "dynamic": dynamic, "args": []}


def effect(kind, line=1):
    return {"kind": kind, "detail": "d", "line": line, "via": ""}


def function(name, calls=(), effects=(), helpers=(), **more):
    base = {"path": "a.go", "line": 1, "column": 1, "name": name, "params": 0, "has_self": False, "statements": 4, "code_lines": 3, "source": "", "preceding_line": "", "mutations": [], "calls": list(calls), "effects": list(effects), "param_list": [], "ddd": []}
    return base | {"helpers": list(helpers)} | more


def helper(name, calls=(), effects=(), mutations=()):
    return {"name": name, "calls": list(calls), "effects": list(effects), "mutations": list(mutations)}


def frame(spark, tmp_path, functions, name="facts"):
    import json

    (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": 2, "functions": functions}))
    return facts.read_facts(spark, str(tmp_path / f"{name}.json"))


def kinds(row):
    return Counter(e["kind"] for e in row["resolved"])


def test_local_effects(spark, tmp_path):
    write = {"root": "g", "root_id": "1", "field_path": "x", "line": 2, "provenance": "external"}
    rows = [
        function("p.f", [call("p.g[int]"), call("p.g"), call("os.Open", local=False), call("fmt.Sprint", local=False)], [effect("io")], [helper("p.g", [call("p.h")], [effect("time")]), helper("p.h", [], [effect("panic")], [write])]),
        function("p.a", [call("p.b")], (), [helper("p.b", [call("p.a")], [effect("io")])], line=2),  # a cycle
        function("p.m", [call("p.none"), call("p.x", dynamic=True)], line=3),  # no body; dynamic
        function("p.r", [call("p.r")], [effect("io")], line=4),
    ]
    got = {r.name: r for r in callgraph.local_effects(frame(spark, tmp_path, rows), [("os.", "io"), ("fmt.", "none"), ("os.Op", "network"), ("os.Op", "global")]).collect()}
    assert kinds(got["p.f"]) == {"io": 1, "time": 2, "panic": 2, "mutation": 2, "global": 1} and got["p.f"].unclassified == 0
    assert {e["via"] for e in got["p.f"].resolved if e["kind"] == "time"} == {"p.g"}
    assert kinds(got["p.a"]) == {"io": 1, "unknown": 1}
    assert kinds(got["p.m"]) == {"unknown": 2} and got["p.m"].unclassified == 2
    assert kinds(got["p.r"]) == {"io": 2, "unknown": 1}
    assert [e["line"] for e in got["p.f"].resolved] == sorted(e["line"] for e in got["p.f"].resolved)


def test_limits_of_call_chains(spark, tmp_path):
    chain = [helper(f"p.h{i}", [call(f"p.h{i + 1}")], [effect("io")]) for i in range(40)]
    wide = [helper("p.w0", [], [effect("io")] * 50)] + [helper(f"p.w{i}", [call(f"p.w{i - 1}")] * 10) for i in (1, 2, 3)]
    rows = [function("p.f", [call("p.h0")], (), chain), function("p.g", [call("p.w3")], (), wide, line=2)]
    got = {r.name: kinds(r) for r in callgraph.local_effects(frame(spark, tmp_path, rows), []).collect()}
    assert got["p.f"] == {"io": 32, "unknown": 1}
    assert got["p.g"] == {"io": 4000, "unknown": 2}  # a body that is cut, called by one that is


def test_cycles_between_functions(spark):
    f = spark.createDataFrame([("f",), ("g",)], "id string")
    fx, calls = spark.createDataFrame([("g", "io")], "id string, kind string"), spark.createDataFrame([("f", "g"), ("g", "f")], "caller string, callee string")
    got = {(r.id, r.kind): r.n for r in callgraph.helper_effects(f, fx, calls).collect()}
    assert got[("f", "io")] == 1 and got[("f", "unknown")] == 1


def test_whole_report(spark, tmp_path):
    write = lambda root, line: {"root": root, "root_id": "1", "field_path": f"f{line}", "line": line, "provenance": "external"}
    hit = lambda rule, detail: {"rule_id": rule, "line": 1, "detail": detail}
    rows = [
        function("p.four", mutations=[write("r", k) for k in range(4)]),
        function("p.long", code_lines=300, params=5, has_self=True, line=5, preceding_line="// x-allow(fn_length): table"),
        function("p.bad", line=9, preceding_line="// x-allow(what): x", ddd=[hit("aggregate", "A"), hit("aggregate", "B"), hit("aggregate", "A"), hit("repository", "q")]),
        function("p.caller", [call("p.long"), call("p.four")], line=20),
        function("p.few", effects=[effect("io")] * 9, statements=2, line=30),
    ]
    config = quality.Config()
    done = quality.evaluate_facts(frame(spark, tmp_path, rows), config).cache()
    got = [(r.name, r.rule, r.actual, r.max, r.message) for r in quality.diagnostics_of(done).orderBy("path", "position").collect()]
    assert got == [
        ("p.four", "mutation_per_target", 4, 3, "mutation_per_target: 4 exceeds 3"),
        ("p.four", "side_effect_density", 1000, 500, "side_effect_density 1000 > 500: weight 4 over 4 statements (mutation 4)"),
        ("p.long", "fn_params", 6, 4, "fn_params: 6 exceeds 4"),
        ("p.bad", "aggregate", 2, 1, "aggregate: 2 exceeds 1"),
        ("p.bad", "invalid_suppression", 1, 0, "invalid suppression: unknown rule"),
        ("p.bad", "repository", 1, 0, "repository: 1 exceeds 0"),
    ]
    fields = quality.evaluate_facts(frame(spark, tmp_path, rows), quality.Config(field_granularity=True))
    assert ("p.four", "mutated_targets", 4) in {(r.name, r.rule, r.actual) for r in quality.diagnostics_of(fields).collect()}
    s = quality.summary_of(done).first()
    assert s.functions == 5 and s.n_mutation == 4 and s.n_io == 9 and s.n_unknown == 2 and s.largest == 13500 and s["mean"] == 3000
    groups = quality.fix_groups_of(done, config).orderBy("root", "ordinal").collect()
    assert {r.id.rsplit(" ", 1)[1] for r in groups} == {r.name for r in done.filter(F.size("findings") > 0).collect()}
    kept = quality.changed_only(quality.diagnostics_of(done), spark.createDataFrame([("a.go", "p.bad")], "path string, name string"))
    assert {r.name for r in kept.collect()} == {"p.bad"}


def test_stack_plans(spark):
    args = lambda *ks: [{"kind": "param" if k is not None else "const", "param": k or 0} for k in ks]
    sites = spark.createDataFrame([(1, "b", "a", args(0, 1)), (2, "b", "a", args(0, None)), (3, "c", "a", args(0, 1, 0)), (4, "a", "a", args(0)), (5, "b", "c", args(1))], "site int, caller string, callee string, args array<struct<kind: string, param: int>>")
    params = spark.createDataFrame([("a", 0, "x", "int", 1), ("a", 1, "y", "int", 1), ("b", 0, "p", "int", 2), ("b", 1, "q", "int", 3), ("c", 0, "z", "int", 9)], "id string, position int, name string, type string, uses int")
    changed = spark.createDataFrame([("a",)], "id string")
    got = [tuple(r) for r in stacking.plans(sites, params, changed).orderBy("plan", "step").collect()]
    assert got == [("a", 1, "a", True, 3, 0, []), ("a", 2, "b", False, 0, 2, ["p"]), ("a", 3, "c", False, 1, 1, [])]
    found = stacking.plan_bundles(sites, params, changed).collect()
    assert [(r["items"], r["sites"], r["functions"]) for r in found] == [(["x int", "y int"], 1, ["a", "b"])]


def test_labels(spark):
    one = spark.range(1)
    line = lambda s, n: one.select(labels.unique_line(F.lit(s), F.lit(n), F.lit(7))).first()[0]
    assert (line("a\nb\nc", "b"), line("a\nb\nb", "b"), line("a\nbb", "b"), line("a", " "), line("x\ny\nz", "y\nz")) == (8, None, None, None, 8)
    assert [r[0] for r in spark.createDataFrame([("a/Repo.go",), ("x/user_repo/y.go",), ("repository_x",), ("a/reports/b.go",), ("adapters/z.go",)], "p string").select(labels.is_repository_path(F.col("p"))).collect()] == [True, True, True, False, True]
    assert one.select(labels.clamped_wait(F.lit(None).cast("int"))).first()[0] == 30000 and one.select(labels.clamped_wait(F.lit(60001))).first()[0] is None


def test_graph_profiles(spark):
    kinds_of = {"a": {"x": 4}, "b": {"x": 4, "y": 1}, "c": {"q": 9}}
    rows = spark.createDataFrame([(g, sum(k.values()), k, [4, 1] if g != "c" else [0, 9], n) for (g, k), n in zip(kinds_of.items(), ["alpha", "alphas", "zz"])], "g string, size long, kinds map<string, int>, v array<int>, name string")
    blocks = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    assert sorted(map(tuple, clones.candidate_pairs(rows, blocks).collect())) == [("a", "b")]


def test_deletion_after_the_end(spark):
    f = spark.createDataFrame([("k", "f", 10, 20)], "p string, item string, start int, end int")
    lines = spark.createDataFrame([("k", i, kind, at) for i, (kind, at) in enumerate([("added", 20), ("added", 21), ("deleted", 21), ("deleted", 22), ("context", 15), ("deleted", 10), ("added", 9)])], "p string, line int, kind string, at int")
    assert sorted(r.range for r in records.diff_in_functions(f, lines, "p", 4).collect()) == [0, 2, 5]


@pytest.mark.parametrize("universe", [6, 70])
def test_clumps_by_brute_force(spark, universe, monkeypatch):
    from factloom.operators import groups

    rng = random.Random(universe)
    common = [f"i{k:03d}" for k in range(6)]
    functions = {f: frozenset(x for x in common if rng.random() < 0.6) | {f"i{rng.randrange(universe):03d}"} for f in range(40)}
    functions |= {100: functions[0], 101: functions[0]}
    if universe > 64:
        functions |= {200 + k: frozenset({f"i{k:03d}", f"j{k:03d}", "z"}) for k in range(70)}
    sets = {f: s for f, s in functions.items() if len(s) >= 2}
    support = {}
    for f, g in itertools.combinations(sets, 2):
        if len(sets[f] & sets[g]) >= 2:
            support.setdefault(sets[f] & sets[g], set()).update((f, g))
    enough = {s: len(v) for s, v in support.items() if len(v) >= 3}
    want = {("|".join(sorted(s)), n) for s, n in enough.items() if not any(s < t for t in enough)}
    rows = spark.createDataFrame([(f, x) for f, s in functions.items() for x in s], "f int, x string")
    for block, dense in ((4096, 1024), (16, 1024), (4096, 0)):
        monkeypatch.setattr(groups, "BLOCK", block)
        monkeypatch.setattr(groups, "DENSE", dense)
        got = {("|".join(r["items"]), r.functions) for r in groups.data_clumps(rows, "f", "x").collect()}
        assert got == want and want


def test_progress_and_tail():
    from factloom.operators import reduction

    seen = []
    text, checks = reduction.reduce_lines("a\nb\nc\nd\n", lambda t: "c" in t, lambda event, size: seen.append((event, size)))
    assert text == "c\n" and seen[0] == ("seed", 8) and sum(e == "checking" for e, _ in seen) == checks - 1
    assert [s for e, s in seen if e == "accepted"] == sorted((s for e, s in seen if e == "accepted"), reverse=True)
    tail = reduction.Tail(5)
    assert tail.write(b"abc") == 3 and tail.write(b"defg") == 4 and tail.held == b"cdefg"

