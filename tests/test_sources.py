import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import facts
from factloom.streaming import rates


def function(name, **more):
    return {"path": "a.go", "line": 1, "column": 1, "name": name, "params": 2, "has_self": False, "statements": 3, "code_lines": 9, "source": "", "preceding_line": "", "mutations": [], "calls": [], "effects": [{"kind": "io", "detail": "d", "line": 4, "via": ""}], "param_list": [], "ddd": [], **more}


def test_facts(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"schema_version": 2, "functions": [function("f"), function("g")]}, indent=1))
    df = facts.read_facts(spark, str(tmp_path / "x.json"))
    assert sorted(r.name for r in df.collect()) == ["f", "g"]
    assert [(r.name, r.kind, r.at_line) for r in facts.exploded(df, "effects").orderBy("name").collect()] == [("f", "io", 4), ("g", "io", 4)]
    facts.write_facts(df, str(tmp_path / "out"))
    assert facts.read_facts(spark, str(tmp_path / "out"), lines=True).count() == 2
    (tmp_path / "y.json").write_text(json.dumps({"schema_version": 9, "functions": [function("f")]}))
    with pytest.raises(Exception, match="schema version"):
        facts.read_facts(spark, str(tmp_path / "y.json")).collect()
    (tmp_path / "z.json").write_text("{broken")
    with pytest.raises(Exception):
        facts.read_facts(spark, str(tmp_path / "z.json")).collect()


def test_paths(spark):
    df = spark.createDataFrame([("a/b.go",), ("/a",), ("a/../b",), ("a\\b",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(facts.valid_paths(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_policy():
    config, prefixes = facts.read_policy('min_statements = 5\n[limits]\nfn_length = 9\n[[prefixes]]\nprefix = "os."\nkind = "io"\n')
    assert config.limits["fn_length"] == 9 and config.limits["fn_params"] == 4 and config.min_statements == 5 and prefixes == [("os.", "io")]
    for bad in ("nope = 1", "[limits]\nnope = 1", "min_statements = -1"):
        with pytest.raises(ValueError):
            facts.read_policy(bad)


def test_baseline(spark, tmp_path):
    rows = spark.createDataFrame([("r", 4, 9, 100, 90.0)], "rule string, limit long, excess long, functions long, per_1000 double")
    facts.write_baseline(rows, str(tmp_path / "b"), 0.05)
    r = facts.read_baseline(spark, str(tmp_path / "b")).first()
    assert (r.rule, r.per_1000, r.tolerance) == ("r", 90.0, 0.05)


def test_files(spark, tmp_path):
    for name in ("a.go", "vendor/b.go", ".git/c.go", "_x/d.go", "sub/e.go", "sub/f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = sorted(r.content for r in facts.source_files(spark, str(tmp_path)).collect())
    assert got == ["a.go", "sub/e.go"]


def test_annotations(spark, tmp_path):
    table = facts.Annotations(spark, str(tmp_path / "notes"))
    rows = spark.createDataFrame([("r", f"n{i}", "p", "f", 1, 1, 2, "m", "t") for i in range(3)], facts.Annotations.SCHEMA.rsplit(",", 1)[0])
    table.insert(rows)
    with pytest.raises(ValueError):
        table.insert(rows.limit(1))
    table.delete("r", "n1")
    with pytest.raises(KeyError):
        table.delete("r", "n1")
    table.insert(rows.filter("id = 'n1'"))
    assert [r.id for r in table.rows("r").collect()] == ["n0", "n2", "n1"] and table.rows("other").count() == 0


def test_cache(spark, tmp_path):
    asked = []

    def results(missing):
        asked.append(missing.count())
        return missing.withColumn("v", F.length("key"))

    keys = spark.createDataFrame([("a",), ("bb",)], "key string")
    for version in (1, 1, 2):
        assert facts.cached(results, keys, str(tmp_path / "c"), version).count() == 2
    assert asked == [2, 0, 2]


def test_xml(spark):
    df = spark.createDataFrame([("p", "<a><s>1</s><s x='2'>3</s></a>")], "path string, content string")
    assert sorted((r.start, r.end) for r in facts.xml_spans(df, "s").collect()) == [(3, 11), (11, 25)]


def test_streams_equal_batches(spark, tmp_path):
    data = [(i % 5, "io" if i % 3 else "unknown", i % 4 > 0) for i in range(100)]
    for part in range(4):
        spark.createDataFrame(data[part::4], "f long, kind string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    schema = "f long, kind string, ok boolean"
    stream = lambda: rates.file_stream(spark, str(tmp_path / "in" / "*"), schema, 1)
    batch = spark.read.parquet(str(tmp_path / "in" / "*"))
    a = rates.run_available(rates.stream_density(stream(), "f", "kind", {"io": 3, "unknown": 1}), str(tmp_path / "c1"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, rates.stream_density(batch, "f", "kind", {"io": 3, "unknown": 1}).collect()))
    b = rates.run_available(rates.stream_beliefs(stream(), "f", "ok"), str(tmp_path / "c2"))
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, rates.stream_beliefs(batch, "f", "ok").collect()))
    seen = []
    rates.change_feed(rates.stream_beliefs(stream(), "f", "ok"), lambda n, df: seen.append((n, df.count())), str(tmp_path / "c3")).awaitTermination()
    assert [n for n, _ in seen] == sorted({n for n, _ in seen}) and seen[0][0] == 1


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:05:00", 1), ("2024-01-01 00:55:00", 1), ("2024-01-01 02:00:00", 1)], "ts string, k int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in rates.windowed_rates(df, "ts", "k").collect()) == [1, 2]
    assert sorted(r.n for r in rates.sessions(df, "ts", "k", "1 hour").collect()) == [1, 2]


def test_new_work(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("x", 1)], "key string, v int")
    assert [r.key for r in rates.new_work(a, b, "key").collect()] == ["y"]
