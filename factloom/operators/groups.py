"""Groups of like things: signatures, clumps, concepts, pairs changed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def signature_groups(methods: DataFrame, key_col: str, type_col: str, name_col: str, implements_col: str | None = None) -> DataFrame:
    """`key, members, types, shared, specificity, score`: keys that methods of two types or more have in common.

    specificity is 1000 ln(total / members), rounded, total being all methods with a key and a type; shared is the most types
    that one short name has; from two on it adds (specificity div 2) x shared div types. Best score first when ordered by
    (score desc, key).
    """
    m = methods.filter(F.col(key_col).isNotNull() & (F.col(key_col).cast("string") != "") & F.col(type_col).isNotNull() & (F.col(type_col) != ""))
    total = m.count()
    m = m.withColumn("short", F.substring_index(name_col, ".", -1)).withColumn("own", F.when(~F.coalesce(F.col(implements_col), F.lit(False)) if implements_col else F.lit(True), F.col(type_col)))
    by_type = m.groupBy(F.col(key_col).alias("key"), "short", "own").agg(F.count("*").alias("n"))
    by_name = by_type.groupBy("key", "short").agg(F.sum("n").alias("n"), F.count("own").alias("named"))
    types = by_type.filter("own is not null").groupBy("key", "own").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("types"))
    out = by_name.groupBy("key").agg(F.sum("n").cast("long").alias("members"), F.max("named").cast("long").alias("shared")).join(types, "key")
    out = out.select("key", "members", "types", "shared")
    out = out.filter("types >= 2").withColumn("specificity", F.greatest(F.round(F.lit(1000.0) * F.log(F.lit(float(total)) / F.col("members"))), F.lit(0.0)).cast("long"))
    return out.withColumn("score", F.col("specificity") + F.when(F.col("shared") >= 2, F.expr("(specificity div 2) * shared div types")).otherwise(0))


def without_subsets(sets: DataFrame, set_col: str, same: str | None = None) -> DataFrame:
    """Drops each set that is a strict subset of another one; with `same`, only of one with an equal value there.

    A set can only lie within one that holds its first item, so sets meet by an item, not all with all.
    """
    keyed = sets.withColumn("__id", F.xxhash64(set_col, *([same] if same else [])))
    small = keyed.select("__id", F.col(set_col).alias("small"), *([F.col(same).alias("__s")] if same else []), F.element_at(set_col, 1).alias("item"))
    large = keyed.select(F.col(set_col).alias("large"), *([F.col(same).alias("__l")] if same else []), F.explode(set_col).alias("item"))
    inside = small.join(large, "item").filter((F.size("small") < F.size("large")) & (F.size(F.array_except("small", "large")) == 0))
    if same:
        inside = inside.filter("__s <=> __l")
    return keyed.join(inside.select("__id").distinct(), "__id", "left_anti").drop("__id")


#: Names that say nothing of what a parameter is.
PLACEHOLDERS = [
    "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "x", "y", "z",
    "foo", "bar", "baz", "qux", "tmp", "temp", "val", "var", "arg", "args", "param", "params", "obj", "item", "elem", "el",
    "p1", "p2", "p3", "a1", "a2", "a3", "v1", "v2", "x1", "x2", "y1", "y2",
]
#: Words that name a concept.
CONCEPTS = [
    "email", "phone", "url", "uri", "uuid", "guid", "id", "name", "address", "street", "city", "state", "zip", "postal", "country", "currency",
    "price", "amount", "quantity", "ssn", "passport", "license", "username", "password", "token", "apikey", "secret", "creditcard", "iban", "isbn", "sku", "serial",
]


#: Items up to which sets are compared as bits, in blocks of this many sets.
DENSE, BLOCK = 1024, 4096
#: Numbers of a run of results that a task gives at once.
EMIT = 1 << 18


def data_clumps(params: DataFrame, function_col: str, item_col: str, least_items: int = 2, least_functions: int = 3, placeholders: list[str] | None = None) -> DataFrame:
    """`items, functions`: sets of items that are exactly the intersection of two functions', in enough functions, maximal.

    A function's items are its distinct ones. Functions with equal item sets meet as one. Only pairs whose intersection is exactly the
    set support it. Items are name:type; with placeholders, sets of none but such names are dropped.

    Where there are few items, most sets share some, so all are compared, as bits, in pairs of blocks: a task gives each set's distinct
    intersections, not its pairs. Where there are many, sets meet by a shared item.
    """
    own = params.select(F.col(function_col).alias("f"), F.col(item_col).alias("item")).filter("item is not null").distinct()
    names = [r.item for r in own.select("item").distinct().orderBy("item").limit(DENSE + 1).collect()]
    sets = own.groupBy("f").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") >= least_items)
    classes = cut(sets.groupBy("items").agg(F.count("*").alias("members")).withColumn("k", F.monotonically_increasing_id()))
    out = _dense_clumps(classes, names, least_items, least_functions) if len(names) <= DENSE else _sparse_clumps(classes, least_items, least_functions)
    return out if placeholders is None else meaningful(out, "items", placeholders)


def _sparse_clumps(classes: DataFrame, least_items: int, least_functions: int) -> DataFrame:
    by_item = classes.select("k", "items", F.explode("items").alias("item"))
    pairs = by_item.alias("x").join(by_item.alias("y"), F.col("x.item") == F.col("y.item")).filter("x.k < y.k").groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.array_sort(F.collect_list("x.item")).alias("items"))
    met = pairs.filter(F.size("items") >= least_items).select("items", F.explode(F.array("a", "b")).alias("k")).union(classes.filter("members > 1").select("items", "k")).distinct()
    found = met.join(classes.select("k", "members"), "k").groupBy("items").agg(F.sum("members").cast("long").alias("functions")).filter(F.col("functions") >= least_functions)
    return without_subsets(cut(found), "items")


def _in_blocks(rows: DataFrame, key: str, words: int, solve) -> DataFrame:
    """`k, mask`: rows (`k, mask`) in parts of about BLOCK, of which each pair is a task. solve(left, right, same) of two parts, left
    before or the same as right, gives runs of `k` and masks; parts and runs are arrays, masks of `words` numbers a row."""
    parts = max(1, -(-rows.count() // BLOCK))
    dealt = rows.select("k", "mask", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).drop("j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        lo, hi, i, k = held["lo"][0].as_py(), held["hi"][0].as_py(), held["i"].to_numpy(), held["k"].to_numpy()
        masks = np.concatenate([np.asarray(c.flatten()) for c in held["mask"].chunks]).reshape(-1, words).view(np.uint64)
        of = lambda p: (k[i == p], masks[i == p])
        for own, found in _runs(solve(of(lo), of(hi), lo == hi)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * words, pa.int32()), pa.array(np.ascontiguousarray(found).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), lists], ["k", "mask"])

    # More parts than groups, so that few groups meet in one.
    return dealt.repartition(min(1000, 2 * parts * (parts + 1)), "lo", "hi").groupBy("lo", "hi").applyInArrow(run, "k long, mask array<long>")


def _runs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Short runs joined to ones of at least EMIT numbers: a task holds no more of its result."""
    held, size = [], 0
    for run in found:
        held.append(run)
        size += run[1].size
        if size >= EMIT:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _dense_clumps(classes: DataFrame, names: list[str], least_items: int, least_functions: int) -> DataFrame:
    words = max(1, -(-len(names) // 64))
    places = F.create_map(*[F.lit(v) for kv in zip(names, range(len(names))) for v in kv]) if names else F.lit(None).cast("map<string, int>")
    word = lambda w: F.aggregate(F.filter(F.transform("items", lambda x: places[x]), lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)))
    coded = cut(classes.select("k", "members", F.array(*[word(w) for w in range(words)]).alias("mask")))

    def met(left: tuple, right: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for (k, x), (others, y) in ((left, right), *(() if same else ((right, left),))):
            for i, own in enumerate(k):
                both = (x[i] & y)[others != own]
                both = both[np.bitwise_count(both).sum(axis=1) >= least_items]
                if len(both):
                    both = np.unique(both[:, 0])[:, None] if words == 1 else np.unique(both, axis=0)
                    yield np.full(len(both), own), both

    pairs = _in_blocks(coded.drop("members"), "k", words, met)
    every = pairs.union(coded.filter("members > 1").select("k", "mask")).distinct()
    found = cut(every.join(coded.select("k", "members"), "k").groupBy("mask").agg(F.sum("members").cast("long").alias("functions")).filter(F.col("functions") >= least_functions))

    def inside(left: tuple, right: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for (k, x), (_, y) in ((left, right), *(() if same else ((right, left),))):
            size = np.bitwise_count(y).sum(axis=1)
            for i in range(len(x)):
                if ((x[i] & y == x[i]).all(axis=1) & (size > np.bitwise_count(x[i]).sum())).any():
                    yield k[i : i + 1], x[i : i + 1]

    most = found.join(_in_blocks(found.select(F.lit(0).cast("long").alias("k"), "mask"), "mask", words, inside).select("mask").distinct(), "mask", "left_anti")
    set_bit = lambda i: F.call_function("shiftright", F.col("mask")[i // 64], F.lit(i % 64)).bitwiseAND(F.lit(1).cast("long")) == 1
    items = F.array_compact(F.array(*[F.when(set_bit(i), F.lit(n)) for i, n in enumerate(names)])) if names else F.array().cast("array<string>")
    return most.select(items.alias("items"), "functions")


def meaningful(sets: DataFrame, set_col: str, placeholders: list[str] = PLACEHOLDERS) -> DataFrame:
    """Sets of name:type with a name that is no placeholder."""
    return sets.filter(F.exists(set_col, lambda x: ~F.lower(F.substring_index(x, ":", 1)).isin(placeholders)))


def split_words(name):
    """Camel and snake case words of a name, lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def primitive_groups(params: DataFrame, function_col: str, name_col: str, type_col: str, keywords: list[str], least: int = 2) -> DataFrame:
    """`concept, type, functions`: the first keyword among a name's words, by type, in enough functions."""
    words = F.filter(split_words(F.col(name_col)), lambda w: w.isin(keywords))
    hits = params.select(F.col(function_col).alias("f"), F.try_element_at(words, F.lit(1)).alias("concept"), F.col(type_col).alias("type")).filter("concept is not null").distinct()
    return hits.groupBy("concept", "type").agg(F.count("*").alias("functions")).filter(F.col("functions") >= least)


def co_modified(writes: DataFrame, function_col: str, type_col: str, least: int = 2) -> DataFrame:
    """`a, b, functions`: pairs of types that enough functions both write, a < b."""
    own = writes.select(F.col(function_col).alias("f"), F.col(type_col).alias("t")).distinct()
    sets = own.groupBy("f").agg(F.array_sort(F.collect_list("t")).alias("ts")).filter(F.size("ts") >= 2)
    pairs = sets.select(F.explode(F.expr("flatten(transform(sequence(1, size(ts) - 1), i -> transform(slice(ts, i + 1, size(ts)), y -> struct(ts[i - 1] as a, y as b))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("functions")).filter(F.col("functions") >= least)


def call_texts(calls: DataFrame, function_col: str, text_col: str) -> DataFrame:
    """`function, calls, texts`: all calls, and the distinct texts in order."""
    return calls.groupBy(function_col).agg(F.count("*").alias("calls"), F.array_sort(F.collect_set(text_col)).alias("texts"))


def all_match(rows: DataFrame, group_col: str, flag) -> DataFrame:
    """`group, n`: groups in which the flag holds for every row."""
    return rows.groupBy(group_col).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(flag, F.lit(False))).alias("__ok")).filter("__ok").drop("__ok")


def same_value(rows: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """`group, value`: groups whose non-empty values are all equal."""
    kept = rows.filter(F.col(value_col).isNotNull() & (F.col(value_col) != ""))
    return kept.groupBy(group_col).agg(F.min(value_col).alias("value"), F.max(value_col).alias("__b")).filter("value = __b").drop("__b")


def effect_union(effects: DataFrame, group_col: str, member_col: str, bits_col: str) -> DataFrame:
    """`group, bits`: groups whose members all have the same union of effect bits."""
    own = effects.groupBy(group_col, member_col).agg(F.bit_or(bits_col).alias("bits"))
    return own.groupBy(group_col).agg(F.min("bits").alias("bits"), F.max("bits").alias("__b")).filter("bits = __b").drop("__b")


def without_services(functions: DataFrame, services: DataFrame, key: str) -> DataFrame:
    """Rows whose key is no service's."""
    return functions.join(services.select(key).distinct(), key, "left_anti")
