"""Facts, policies, baselines, annotations, cached results and files as tables."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import cut
from ..operators.quality import LIMITS, WEIGHTS, Config

FACTS = """schema_version int, functions array<struct<path: string, line: int, column: int, name: string, params: int, has_self: boolean, statements: int, code_lines: int, source: string, preceding_line: string,
 mutations: array<struct<root: string, root_id: string, field_path: string, line: int, provenance: string>>,
 calls: array<struct<callee: string, line: int, dynamic: boolean, local: boolean, args: array<struct<kind: string, param: int>>>>,
 effects: array<struct<kind: string, detail: string, line: int, via: string>>,
 param_list: array<struct<name: string, type: string, uses: int>>, ddd: array<struct<rule_id: string, line: int, detail: string>>,
 helpers: array<struct<name: string,
  mutations: array<struct<root: string, root_id: string, field_path: string, line: int, provenance: string>>,
  calls: array<struct<callee: string, line: int, dynamic: boolean, local: boolean, args: array<struct<kind: string, param: int>>>>,
  effects: array<struct<kind: string, detail: string, line: int, via: string>>>>>>"""


def read_facts(spark: SparkSession, path: str, versions: tuple[int, ...] = (1, 2), lines: bool = False) -> DataFrame:
    """One row a function, from documents of one file each or, with lines, one line each. A file that isn't such JSON fails the read; another schema version fails when it is read."""
    docs = spark.read.schema(FACTS).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("schema_version").isin(*versions), F.col("functions")).otherwise(F.raise_error(F.lit("this schema version can't be read")).cast(docs.schema["functions"].dataType))
    return docs.select(F.explode(checked).alias("f")).select("f.*")


def write_facts(functions: DataFrame, path: str, version: int = 2) -> None:
    """JSON lines with a function each, under the same schema; read_facts reads them with lines=True."""
    functions.select(F.lit(version).alias("schema_version"), F.array(F.struct(*functions.columns)).alias("functions")).write.mode("overwrite").json(path)


def exploded(functions: DataFrame, column: str) -> DataFrame:
    """`path, line, column, name` with the fields of each element of an array column; its own line becomes at_line."""
    own = [F.col(c).alias(c) for c in ("path", "line", "column", "name")]
    names = functions.schema[column].dataType.elementType.fieldNames()
    return functions.select(*own, F.explode(column).alias("__x")).select("path", "line", "column", "name", *[F.col(f"__x.{n}").alias(n if n not in ("line", "name") else f"at_{n}") for n in names])


def valid_paths(path):
    """Relative, with forward slashes, and no part that is empty, `.` or `..`."""
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), F.lit(False))


def read_policy(text: str) -> tuple[Config, list[tuple[str, str]]]:
    """A TOML policy: [limits], [weights], min_statements, granularity, [[prefixes]] with prefix and kind. What is not named
    keeps its default; unknown names are errors."""
    raw = tomllib.loads(text)
    unknown = set(raw) - {"limits", "weights", "min_statements", "granularity", "prefixes"}
    if unknown:
        raise ValueError(f"policy: unknown {sorted(unknown)}")
    config = Config(limits={**LIMITS, **raw.get("limits", {})}, weights={**WEIGHTS, **raw.get("weights", {})}, min_statements=raw.get("min_statements", 3), field_granularity=raw.get("granularity", "root") == "field")
    return config, [(p["prefix"], p["kind"]) for p in raw.get("prefixes", [])]


def write_baseline(totals: DataFrame, path: str, tolerance: float) -> None:
    totals.withColumn("tolerance", F.lit(tolerance)).withColumn("version", F.lit(1)).coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version int, tolerance double, rule string, limit long, excess long, functions long, per_1000 double").json(path).filter("version = 1")


def source_files(spark: SparkSession, path: str, suffix: str = ".go", skip: tuple[str, ...] = ("vendor", "testdata")) -> DataFrame:
    """`path, content` of files with the suffix, once each; folders that are skipped or begin with `.` or `_` are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").format("binaryFile").load(path)
    inner = F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/")
    hidden = F.exists(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda s: s.isin(*skip) | s.startswith(".") | s.startswith("_"))
    return files.filter(~hidden).select("path", F.col("content").cast("string").alias("content")).dropDuplicates(["path"])


class Annotations:
    """A table of annotations in a folder: repository and id are the key, rows stand in the order they were put in."""

    SCHEMA = "repository string, id string, path string, function_name string, function_line int, start_line int, end_line int, message string, text string, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            spark.read.schema(self.SCHEMA).parquet(path).limit(0).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.createDataFrame([], self.SCHEMA).write.parquet(path)

    def rows(self, repository: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("repository") == repository).orderBy("seq")

    def insert(self, rows: DataFrame) -> None:
        """Appends rows without seq; a key that is there already, or comes twice, is an error."""
        old = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        twice = rows.select("repository", "id").union(old.select("repository", "id")).groupBy("repository", "id").count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError("an annotation of this repository and id is there already")
        last = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows.withColumn("seq", F.lit(last + 1) + F.monotonically_increasing_id()).select(*old.columns).write.mode("append").parquet(self.path)

    def delete(self, repository: str, id_: str) -> None:
        """An error if there is no such row."""
        old = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        gone = (F.col("repository") == repository) & (F.col("id") == id_)
        if old.filter(gone).isEmpty():
            raise KeyError(id_)
        kept = cut(old.filter(~gone))  # whole before the folder is written anew; stays if that fails
        kept.write.mode("overwrite").parquet(self.path)


def cached(results, keys: DataFrame, path: str, version: int, key: str = "key") -> DataFrame:
    """Results by content key from the cache at path, and `results(missing keys)` for the others, which are put there. A missing
    folder or another version is a cold cache."""
    spark, own = keys.sparkSession, f"{path}/version={version}"
    try:
        old = spark.read.parquet(own)
        missing = keys.join(old.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old, missing = None, keys
    new = results(missing)
    new.write.mode("append").parquet(own)
    return spark.read.parquet(own).join(keys.select(key).distinct(), key, "left_semi")


def xml_spans(files: DataFrame, row_tag: str) -> DataFrame:
    """`path, start, end`: where elements of a tag stand in each text (`path, content`), innermost only, equal ones each."""
    pattern = re.compile(rf"<{re.escape(row_tag)}\b[^>]*>(?:(?!<{re.escape(row_tag)}\b).)*?</{re.escape(row_tag)}>", re.S)

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [m.span() for m in pattern.finditer(t or "")])

    return files.filter(F.contains("content", F.lit(f"</{row_tag}>"))).select("path", F.explode(places("content")).alias("x")).select("path", "x.start", "x.end")
