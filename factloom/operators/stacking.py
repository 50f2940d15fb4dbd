"""Plans for parameters that are passed along: forwarded arguments, bundles in order, steps (J24, Q14, O6, G29, G30, P17's counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .callgraph import bundles


def forwards(sites: DataFrame, params: DataFrame) -> DataFrame:
    """`site, caller, callee, from, to, name, type`: arguments that are bare parameters of the caller, with the callee's parameter at
    their place. sites: `site, caller, callee, args array<struct<kind, param>>`; params: `id, position, name, type`. Places that
    callee or caller do not have are left out."""
    args = sites.select("site", "caller", "callee", F.posexplode("args").alias("to", "a")).filter("a.kind = 'param'").select("site", "caller", "callee", F.col("a.param").alias("from"), "to")
    own = params.select(F.col("id").alias("callee"), F.col("position").alias("to"), "name", "type")
    has = params.select(F.col("id").alias("caller"), F.col("position").alias("from"))
    return args.join(own, ["callee", "to"]).join(has, ["caller", "from"], "left_semi").select("site", "caller", "callee", "from", "to", "name", "type")


def feeding(sites: DataFrame, changed: DataFrame) -> DataFrame:
    """`plan` and the site: calls of a function that gets a new signature (`id`); a function's calls of itself are none."""
    return sites.filter("caller <> callee").join(changed.select(F.col("id").alias("plan")), F.col("callee") == F.col("plan"))


def plan_bundles(sites: DataFrame, params: DataFrame, changed: DataFrame) -> DataFrame:
    """`items, sites, functions, position`: the closed sets of what feeding sites pass along, the largest first, then of most sites, then
    by the functions that carry them."""
    passed = forwards(feeding(sites, changed), params).withColumn("item", F.concat_ws(" ", "name", "type"))
    found = bundles(passed, "site", "item")
    own = passed.groupBy("site", "caller", "callee").agg(F.collect_set("item").alias("has"))
    by_item = own.withColumn("i", F.explode("has"))
    held = found.withColumn("i", F.element_at("items", 1)).join(by_item, "i").filter(F.size(F.array_except("items", "has")) == 0)
    carried = held.select("items", "sites", F.explode(F.array("caller", "callee")).alias("f")).groupBy("items", "sites").agg(F.array_sort(F.collect_set("f")).alias("functions"))
    return carried.withColumn("position", F.row_number().over(Window.orderBy(F.size("items").desc(), F.desc("sites"), "functions", "items")))


def plans(sites: DataFrame, params: DataFrame, changed: DataFrame) -> DataFrame:
    """`plan, step, id, signature, incoming, outgoing, pass_through`: one plan a changed function (`id`): itself, then its callers by id.

    incoming counts all calls of the function, outgoing its calls of the changed one; pass_through has its parameters that are used
    only to be passed to it. params: `id, position, name, type, uses`.
    """
    own = sites.filter("caller <> callee")
    into = own.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("incoming"))
    fed = feeding(sites, changed)
    out = fed.groupBy("plan", F.col("caller").alias("id")).agg(F.count("*").alias("outgoing"))
    rows = changed.select(F.col("id").alias("plan"), "id", F.lit(True).alias("signature")).union(out.select("plan", "id", F.lit(False)))
    given = forwards(fed, params).groupBy(F.col("callee").alias("plan"), F.col("caller").alias("id"), F.col("from").alias("position")).agg(F.count("*").alias("n"))
    spare = given.join(params.select("id", "position", F.col("name").alias("own"), "uses"), ["id", "position"]).filter("uses > 0 and n >= uses")
    spare = spare.groupBy("plan", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "own"))), lambda x: x["own"]).alias("pass_through"))
    full = rows.join(into, "id", "left").join(out, ["plan", "id"], "left").join(spare, ["plan", "id"], "left")
    step = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("signature"), "id"))
    return full.select("plan", step.alias("step"), "id", "signature", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("pass_through", F.array().cast("array<string>")).alias("pass_through"))
