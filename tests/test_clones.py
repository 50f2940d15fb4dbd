import math

from pyspark.sql import functions as F

from factloom.operators import candidates, clones, report


def chain(g, labels, extra=()):
    n = [(g, i, c, "call" if c == "c" else "op", f"{g}{i}") for i, c in enumerate(labels)]
    e = [(g, i, i + 1, "t", "data") for i in range(len(labels) - 1)] + [(g, a, b, "u", "ctrl") for a, b in extra]
    return n, e


def tables(spark, *graphs):
    n = spark.createDataFrame([x for a, _ in graphs for x in a], "g long, node long, label string, kind string, detail string")
    e = spark.createDataFrame([x for _, b in graphs for x in b], "g long, src long, dst long, tag string, kind string")
    return n, e


def test_kernels_and_groups(spark):
    n, e = tables(spark, chain(0, "pcolr"), chain(1, "pcolr"), chain(2, "pcoxr"), chain(3, "ccccc", [(0, 4)]))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    h = clones.neighbourhood_histograms(n, e)
    s = {(r.a, r.b): r.similarity for r in clones.neighbourhood_similarity(h, pairs).collect()}
    assert s[0, 1] == 1000 and 1000 > s[0, 2] > s[0, 3]
    w = {(r.a, r.b): r.similarity for r in clones.weighted_similarity(n, e, pairs).collect()}
    assert w[0, 1] == 1000 and w[0, 3] < w[0, 2] < 1000
    assert sorted((r.g, r.root) for r in clones.clone_report(n, e, pairs).collect()) == [(0, 0), (1, 0)]
    v = clones.folded_vectors(h).collect()
    assert all(len(r.v) == 512 for r in v)
    assert {r.g for r in clones.mineable(n).collect()} == {0, 1, 2, 3} and {r.g for r in clones.mineable(n, 4, 2).collect()} == {3}


def test_candidate_pairs(spark):
    p = spark.createDataFrame([(0, 5, {"if": 2}, [1, 2], "load"), (1, 5, {"if": 2}, [9, 0], "zzz"), (2, 5, {"for": 9}, [2, 4], "lord"), (3, 5, {"for": 9}, [3, 6], "qqq"), (4, 50, {"if": 2}, [1, 2], "load"), (5, 5, {}, [1, 2], "")], "g long, size int, kinds map<string,int>, v array<int>, name string")
    blocks = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    assert sorted(map(tuple, clones.candidate_pairs(p, blocks).collect())) == [(0, 1), (0, 2), (0, 5)]


def test_inconsistent_and_templates(spark):
    groups = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 5)], "g long, root long")
    sims = spark.createDataFrame([(0, 1, 930), (5, 6, 990), (1, 5, 940)], "a long, b long, similarity long")
    assert [r.root for r in clones.inconsistent(groups, sims).collect()] == [0]
    pairs = spark.createDataFrame([(1, 2, 700), (1, 3, 700), (3, 4, 700), (4, 5, 700), (8, 9, 500)], "a long, b long, similarity long")
    order = spark.createDataFrame([(i, i) for i in range(10)], "g long, position int")
    n, e = tables(spark, *[chain(g, "pcolr") for g in range(1, 6)])
    assert sorted((r.template, r.g, r.coverage) for r in clones.template_clusters(pairs, order, n, e).collect()) == [(1, 1, 1000), (1, 2, 1000), (1, 3, 1000), (4, 4, 1000), (4, 5, 1000)]
    n, e = tables(spark, chain(1, "pcolr"), chain(2, "xyzzy"), chain(3, "pcolr"), chain(4, "pcoo"), chain(5, "xyzzy"))
    # 1 and 3 join, 2 does not; of what is left, 4 and 5 don't align, so 4 retires alone
    assert sorted((r.template, r.g) for r in clones.template_clusters(pairs, order, n, e).collect()) == [(1, 1), (1, 3)]


def test_holes_and_columns(spark):
    rows = [
        (1, 0, "param", "", "", "T1", 0), (1, 1, "call", "m/p.A.Run", "", "", 2), (1, 2, "lit", "", "5", "int", 0), (1, 3, "op", "", "cmp:<", "", 0), (1, 4, "field", "", "x", "", 0), (1, 5, "call", "p.f", "", "", 0), (1, 6, "lit", "", "5", "int", 0),
        (2, 0, "param", "", "", "T2", 0), (2, 1, "call", "m/p.B.Run", "", "", 1), (2, 2, "lit", "", "7", "int", 0), (2, 3, "op", "", "cmp:>", "", 0), (2, 4, "field", "", "y", "", 0), (2, 5, "call", "p.g", "", "", 0), (2, 6, "lit", "", "7", "int", 0),
        (3, 0, "param", "", "", "T1", 0), (3, 1, "call", "m/p.A.Run", "", "", 2), (3, 2, "lit", "", "9", "int", 0), (3, 3, "op", "", "add", "", 0), (3, 4, "field", "", "x", "", 0), (3, 5, "call", "", "", "", 0), (3, 6, "lit", "", "5", "int", 0),
    ]
    nodes = spark.createDataFrame(rows, "g long, node int, kind string, callee string, detail string, type_class string, effects int")
    matched = spark.createDataFrame([(1, b, v, v) for b in (2, 3) for v in range(7)], "a long, b long, node_a int, node_b int")
    found = clones.holes(matched, nodes).cache()
    got = {(r.b, r["var"], r.x, r.y, r.site, len(r.sites)) for r in found.collect()}
    assert got == {
        (2, "T0", "T1", "T2", 0, 1), (2, "M0", "m/p.A.Run", "m/p.B.Run", 1, 1), (2, "X0", "io", "mutates", 1, 1), (2, "L0", "5", "7", 2, 2), (2, "O0", "<", ">", 3, 1), (2, "D0", "x", "y", 4, 1), (2, "F0", "p.f", "p.g", 5, 1), (3, "L0", "5", "9", 2, 1),
    }
    clusters = spark.createDataFrame([(1, 1, 1000), (1, 2, 1000), (1, 3, 1000)], "template long, g long, coverage long")
    columns = {(r["var"], r.g): r.value for r in clones.template_columns(clusters, found).collect()}
    assert [columns["L0", g] for g in (1, 2, 3)] == ["5", "7", "9"] and [columns["M0", g] for g in (1, 2, 3)] == ["m/p.A.Run", "m/p.B.Run", "m/p.A.Run"] and len(columns) == 21


def test_proposals(spark):
    from factloom.operators import proposals

    facts = spark.createDataFrame([(f"f{i}", "", None, i == 6, 0, True, i == 7) for i in range(1, 9)] + [("p.A.Run", "p.A", "k1", False, 1, True, False), ("p.B.Run", "p.B", "k1", False, 2, True, False)], "id string, type string, key string, implements boolean, effects int, substance boolean, boilerplate boolean")
    groups, own = spark.createDataFrame([("k1", 400)], "key string, score long"), spark.createDataFrame([("Dog",), ("Cat",)], "type string")
    members = spark.createDataFrame([("t", "f1", 1000), ("t", "f2", 900), ("g", "f3", 1000), ("g", "f4", 1000), ("q", "f5", 1000), ("q", "f8", 800), ("n", "f7", 1000), ("n", "f5", 1000)], "cluster string, id string, coverage long")
    columns = [("t", "M0", "method", "p.A.Run"), ("t", "M0", "method", "p.B.Run"), ("g", "T0", "type", "Dog"), ("g", "T0", "type", "Cat"), ("g", "M0", "method", "ext.X.F"), ("g", "M0", "method", "ext.Y.F"), ("q", "L0", "literal", "1"), ("q", "L0", "literal", "2"), ("n", "L0", "literal", "1")]
    got = {r.cluster: r for r in proposals.proposals(members, spark.createDataFrame(columns, "cluster string, var string, kind string, value string"), facts, groups, own).collect()}
    assert {k: r.kind for k, r in got.items()} == {"t": "trait_method", "g": "generic_fn", "q": "parameterize"}
    full = lambda support, lift, coverage, scale: int((1000 * math.log(support) + lift) * coverage / 1000 * scale + 0.5)
    assert got["t"].score == full(2, 400, 950, 0.5) and got["t"].common and got["g"].score == full(2, 0, 1000, 1) // 2 and got["q"].score == full(2, 0, 900, 1) // 3


def test_alignment(spark):
    n, e = tables(spark, chain(0, "pcolr"), chain(1, "pcolr"), chain(2, "pcoolr"))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    got = {(r.a, r.b): (r.matched, r.coverage) for r in clones.alignments(n, e, pairs).collect()}
    assert got == {(0, 1): (5, 1000), (0, 2): (5, 833)}
    m = dict(clones.align_pair(dict(enumerate("aab")), {(0, 1, "x"), (1, 2, "x")}, dict(enumerate("aab")), {(0, 1, "x"), (1, 2, "x")}))
    assert m == {0: 0, 1: 1, 2: 2}


def test_candidates(spark):
    hits = spark.createDataFrame([("p", 2, "f", "f", "d", ["nilerr"]), ("p", 3, "g", "g", "d", []), ("p", 4, "h", "h", "d", None)], "path string, line int, id string, name string, detail string, suppressed array<string>")
    got = report.best_first(candidates.static_findings("nilerr", hits)).collect()
    assert [(r.score, r.sites[0].id) for r in got] == [(800, "g"), (800, "h")]
    assert candidates.static_findings("guard_clause", hits).count() == 3
    f = spark.createDataFrame([(i, f"n{i}", "p", i, "T", 5) for i in range(4)] + [(9, "n9", "p", 9, "U", 3), (9, "n9", "p", 9, "T", 3)], "id long, name string, path string, line int, type string, fields int")
    services = spark.createDataFrame([(0,), (9,)], "id long")
    a = candidates.anemic_models(f, services).collect()
    assert [(r.observation, len(r.sites)) for r in a] == [("type T", 3)]
    assert [r.observation for r in candidates.domain_services(f).collect()] == ["function n9"]
    assert candidates.factories(f).count() == 0 and candidates.factories(f, 5, 9).count() == 1
    s = f.withColumn("rule", F.lit("positive"))
    assert [r.observation for r in candidates.specifications(s).collect()] == ["positive T"]
    facts = f.select(F.col("id"), "path", "line", "name").distinct()
    assert candidates.located(spark.createDataFrame([(1,), (77,)], "id long"), facts).count() == 1


def test_judge(spark):
    facts = spark.createDataFrame(
        [("a.T.m", "a.T", "k", False, "pure"), ("a.U.m", "a.U", "k", False, "io"), ("b.V.m", "b.V", "k", False, "pure"), ("a.W.n", "a.W", "z", False, "pure"), ("a.X.i", "a.X", "k", True, "pure"), ("a.Y.i", "a.Y", "k", True, "pure")],
        "id string, type string, key string, implements boolean, effects string",
    )
    groups = spark.createDataFrame([("k", 300)], "key string, score long")
    columns = {0: ["a.T.m", "a.U.m"], 1: ["a.T.m", "b.V.m"], 2: ["a.T.m", "a.W.n"], 3: ["a.X.i", "a.Y.i"], 4: ["a.T.m", "gone"], 5: ["a.T.m", "a.T.m"]}
    values = spark.createDataFrame([(c, "M0", v) for c, vs in columns.items() for v in vs], "cluster int, var string, value string")
    judged = candidates.judge_columns(values, facts, groups)
    assert {r.cluster: r.verdict for r in judged.collect()} == {0: "trait", 1: "skip", 2: "skip", 3: "suppressed", 4: "skip", 5: "skip"}
    assert [tuple(r) for r in candidates.trait_evidence(judged).collect()] == [(0, 300, True, True)]


def test_substance(spark):
    n = spark.createDataFrame([(0, 0, "param"), (0, 1, "call"), (1, 0, "op"), (1, 1, "call"), (2, 0, "call"), (2, 1, "call"), (3, 0, "op")], "g long, node long, kind string")
    e = spark.createDataFrame([(0, 0, 1, "data"), (1, 0, 1, "data")], "g long, src long, dst long, kind string")
    assert {r.g for r in candidates.substantial(n, e).collect()} == {1, 2}
    assert {r.g for r in candidates.substantial(n, e, guard=False).collect()} == {2}


def test_clone_clusters(spark):
    n, e = tables(spark, *[chain(g, "pcolr") for g in (1, 2, 5, 6)], chain(3, "zzzzz"))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)], "g long, root long")
    effects = spark.createDataFrame([(1, 3), (2, 1), (2, 2), (3, 3), (5, 1), (6, 2)], "g long, bits int")
    assert sorted(map(tuple, clones.clone_clusters(groups, effects, n, e).collect())) == [(1, 1, 1000), (1, 2, 1000)]


def test_all_miners(spark):
    from factloom.operators import miners

    facts = spark.createDataFrame([(f"f{i}", f"p{i % 3}.go", i, f"f{i}") for i in range(12)], "id string, path string, line int, name string")
    calls = spark.createDataFrame([(f"f{i}", c) for i in range(12) for c in (("open", "close") if i else ("open",))], "id string, callee string")
    sites = spark.createDataFrame([(f"f{i}", i, "read", i > 0) for i in range(12)], "id string, line int, callee string, checked boolean")
    params = spark.createDataFrame([(f"f{i}", n, "string") for i in range(4) for n in ("street", "city")], "id string, name string, type string")
    writes = spark.createDataFrame([(f"f{i}", t) for i in range(2) for t in ("A", "B")], "id string, type string")
    hits = spark.createDataFrame([("f1", "nilerr", 4, "d", ["nilerr"]), ("f2", "nilerr", 5, "d", None), ("f3", "guard_clause", 6, "g", None)], "id string, kind string, line int, detail string, suppressed array<string>")
    nodes = [("f1", 0, "call", "os.Getenv", False), ("f1", 1, "call", "exec.Command", False), ("f1", 2, "call", "os.Open", False), ("f1", 3, "return", None, False)] + [("f2", i, "param" if i == 0 else "return" if i == 24 else "op", None, False) for i in range(25)]
    edges = [("f1", 0, 1, "data", 0), ("f1", 2, 3, "data", 0)] + [("f2", i, i + 1, "data", 0) for i in range(24)] + [("f2", 5, 3, "ctrl", 0), ("f2", 20, 3, "data", 0)]
    tables_ = {
        "facts": facts, "calls": calls, "sites": sites, "params": params, "writes": writes, "hits": hits,
        "graph_nodes": spark.createDataFrame(nodes, "g string, node int, kind string, callee string, deferred boolean"), "graph_edges": spark.createDataFrame(edges, "g string, src int, dst int, kind string, arg int"),
    }
    got = miners.mine(tables_).collect()
    kinds = {r.kind for r in got}
    assert kinds == {"mined_rule", "deviant_behavior", "obligation", "taint_flow", "dependence_cluster", "barrier_slice", "thin_slice", "chop", "value_object", "primitive_obsession", "aggregate", "nilerr", "guard_clause"}
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and got[0].kind == "taint_flow"
    assert {r.observation for r in got if r.kind == "mined_rule"} == {"calls open without close"}
    assert [len(r.sites) for r in got if r.kind == "value_object"] == [4] and [r.sites[0].id for r in got if r.kind == "nilerr"] == ["f2"]
    few = {k: tables_[k] for k in ("facts", "hits", "writes")}
    assert [r.kind for r in miners.mine(few, least=450, top=2).collect()] == ["nilerr", "guard_clause"]
    assert {r.kind for r in miners.mine({"facts": facts, "hits": hits}).collect()} == {"nilerr", "guard_clause"}
