"""Near-duplicates by the Jaccard similarity of word shingles: SimHash proposes, exact sets decide.

A text is the set of its runs of five words. Its fingerprint has 128 bits, one SimHash over the distinct shingles, in BLOCKS blocks
of 32. Each block has the covering tables of `simhash` for RADIUS bits. Of two fingerprints within REACH bits some block differs in
at most RADIUS, so they share a key by construction; those farther apart share one where the differing bits happen to be covered.
At Jaccard 0.8 about 15 % of the bits differ. Fingerprints of few shingles differ more; texts of up to SHORT shingles also meet by
their smallest shingles, of which a pair at 0.8 must share one. What meets within 36 bits is a candidate, unless one text has under
0.8 of the other's shingles, as no pair at 0.8 has; the texts of each group of candidates are compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, fresh, ragged, slices, store, trimmed
from .components import components
from .simhash import BUCKET, covering_masks

BLOCKS, RADIUS, DISTANCE, SHORT = 4, 4, 36, 50
EACH = (1 << (RADIUS + 1)) - 1
TABLES, REACH = BLOCKS * EACH, BLOCKS * (RADIUS + 1) - 1
#: The tables that name components before the others are built: one of each block.
FIRST = [b * EACH for b in range(BLOCKS)]
#: Shingles in a task that compares sets; a larger group of candidates is dealt out as pairs of parts.
GROUP = 1 << 22
#: Keys of up to so many texts are compared row against row for many keys at once, larger ones text by text.
SCAN = 256


def text_shingles(column: pa.Array, shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each text's words in lower case; where its distinct shingles begin (n + 1 long); their hashes, sorted by text.

    A text of fewer words is one shingle, one without words none.
    """
    block = Block(column)
    starts, ends, first, solid = block.words()
    buf, digest = block.buf, xxhash.xxh64_intdigest
    keep = solid.copy()
    keep[ends[ends < len(buf)]] = True  # one space after each word
    plain = np.where(solid, buf, 32).astype(np.uint8)
    plain[(plain >= 65) & (plain <= 90)] += 32
    at = np.cumsum(keep) - 1
    data = plain[keep].tobytes()
    begin, end = (at[starts], at[ends - 1] + 1) if len(starts) else (starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, n_words > 0).astype(np.int64)
    doc = np.repeat(np.arange(block.n), n)
    word = ragged(first[:-1], n)
    last = np.minimum(word + shingle, first[1:][doc]) - 1
    h = np.fromiter((digest(data[s:e], seed) for s, e in zip(begin[word].tolist(), end[last].tolist())), np.uint64, len(word))
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    texts = [digest(data[begin[a] : end[b - 1]], seed) if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return np.array(texts, np.uint64), np.searchsorted(doc, np.arange(block.n + 1)), h


def mixed(x: np.ndarray) -> np.ndarray:
    """64 other bits of each hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhashes(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The 128 bits of each text as two unsigned longs."""
    n = np.diff(off)
    counts = np.zeros((len(n), 128), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(h), 1 << 15):
        part, d = h[a : a + (1 << 15)], doc[a : a + (1 << 15)]
        bits = np.unpackbits(np.stack([part, mixed(part)], axis=1).view(np.uint8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        counts[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def table_keys(fps: np.ndarray, tables: list[int]) -> np.ndarray:
    """The key of each fingerprint (two longs) in each of the tables: the table, and what its mask keeps of its block."""
    masks = np.array(covering_masks(RADIUS, 32), np.uint64)
    block, mask = np.divmod(np.array(tables, np.int64), len(masks))
    return (np.array(tables, np.uint64) << np.uint64(32)) | (np.ascontiguousarray(fps).view(np.uint32)[:, block].astype(np.uint64) & masks[mask])


def least_shared(n: int) -> int:
    """So many of a text's smallest shingles contain one that it shares with any text at 0.8: all but what may differ, and one."""
    return n - (4 * n + 4) // 5 + 1 if 0 < n <= SHORT else 0


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            node, off, h = text_shingles(part.column(1))
            fp = simhashes(off, h)
            few = np.array([least_shared(k) for k in np.diff(off).tolist()], np.int64)
            ends = np.append(0, np.cumsum(few)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[ragged(off[:-1], few)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), pa.array(fp[:, 0].copy().view(np.int64)), pa.array(fp[:, 1].copy().view(np.int64)), keys, pa.array(np.diff(off), pa.int32())], ["id", "node", "fa", "fb", "keys", "n"])


def _keyed(tables: list[int], short: bool):
    """The rows of each text: one for each of the tables and, if `short`, one for each of a short text's smallest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                node, fa, fb = (np.asarray(part.column(i)) for i in range(3))
                key = table_keys(np.stack([fa, fb], axis=1).view(np.uint64), tables).ravel().view(np.int64)
                at = np.repeat(np.arange(len(node)), len(tables))
                if short:
                    lists = part.column(3)
                    at = np.concatenate([at, np.repeat(np.arange(len(node)), np.asarray(lists.value_lengths()))])
                    key = np.concatenate([key, np.asarray(lists.flatten())])
                n = np.asarray(part.column(4))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[at]), pa.array(fa[at]), pa.array(fb[at]), pa.array(n[at])], ["key", "node", "fa", "fb", "n"])

    return run


def alike(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether fingerprints x of n shingles and y of m may be near-duplicates."""
    return (np.bitwise_count(x ^ y).sum(axis=-1) <= DISTANCE) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def close(node: np.ndarray, fps: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph that links what is alike; never all pairs."""
    left, right = [], []
    while len(node) > 1:
        queue, node, fps, n = [(int(node[0]), fps[0], n[0])], node[1:], fps[1:], n[1:]
        while queue and len(node):
            one, fp, m = queue.pop()
            near = alike(fps, n, fp, m)
            if near.any():
                found = node[near].tolist()
                left += [one] * len(found)
                right += found
                queue += list(zip(found, fps[near], n[near]))
                node, fps, n = node[~near], fps[~near], n[~near]
    return left, right


def scanned(ends: np.ndarray, node: np.ndarray, fps: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one key that are alike and bear different names, a step for each distance between two rows. ends: where
    the key of each row ends, or 0 for a row that is left out."""
    live, step, left, right = np.flatnonzero(ends), 1, [], []
    while len(live := live[live + step < ends[live]]):
        other = live + step
        near = live[alike(fps[live], n[live], fps[other], n[other]) & (node[live] != node[other])]
        left.append(near)
        right.append(near + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (live, live)


def _candidates(most: int):
    """Rows sorted by key to links (a, b), or, of keys with more than `most` texts, to their rows, with b null."""

    def out(key, a, b, fa, fb, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), b, pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(n, pa.int64())], ["key", "a", "b", "fa", "fb", "n"])

    def solve(key, node, fps, n):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        few = size <= min(SCAN, most)
        i, j = scanned(np.repeat((cut + size) * few, size), node, fps, n)
        of = np.repeat(np.arange(len(cut)), size)
        one = np.bincount(of[i], minlength=len(cut)) == 1
        left, right = node[i[one[of[i]]]].tolist(), node[j[one[of[i]]]].tolist()
        met = np.unique(np.concatenate([i, j]))
        met = met[~one[of[met]]]  # the rows of keys with several pairs; all others of these keys are alone
        for rows in [*np.split(met, np.flatnonzero(np.diff(of[met])) + 1), *(np.arange(c, c + k) for c, k in zip(cut[~few].tolist(), size[~few].tolist()) if k <= most)]:
            a, b = close(node[rows], fps[rows], n[rows])
            left += a
            right += b
        zero = np.zeros(len(left), np.int64)
        yield out(zero, left, pa.array(right, pa.int64()), zero, zero, zero)
        for c, k in zip(cut[size > most].tolist(), size[size > most].tolist()):
            yield large(key[c : c + k], node[c : c + k], fps[c : c + k], n[c : c + k])

    def large(key, node, fps, n) -> pa.RecordBatch:
        signed = fps.view(np.int64)
        return out(key, node, pa.nulls(len(key), pa.int64()), signed[:, 0].copy(), signed[:, 1].copy(), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spilled = None, None  # the rows of a key that may go on; the key that has been given up as too large
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fps = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))], axis=1).view(np.uint64)
            n = np.asarray(batch.column(4)).astype(np.int64)
            if spilled is not None:
                same = key == spilled
                if same.any():
                    yield large(key[same], node[same], fps[same], n[same])
                    key, node, fps, n = key[~same], node[~same], fps[~same], n[~same]
                if not len(key):
                    continue
                spilled = None
            if held is not None:
                key, node, fps, n = (np.concatenate(x) for x in zip(held, (key, node, fps, n)))
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield from solve(key[:done], node[:done], fps[:done], n[:done])
            held = key[done:], node[done:], fps[done:], n[done:]
            if len(held[0]) > most:
                spilled = held[0][0]
                yield large(*held)
                held = None
        if held is not None:
            yield from solve(*held)

    return run


def candidate_links(nodes: DataFrame, most: int = BUCKET) -> DataFrame:
    """`a, b`: links that connect what shares a key and is alike. nodes: one row a text, `node, fa, fb, keys,
    n`, n the number of its shingles.

    The tables of FIRST come first. Each text then bears the name of its component so far, and the other tables only link
    different components: a text of a large group has about as many links as FIRST has tables, not one for each table.
    """
    first = _met(nodes.select("node", "fa", "fb", "keys", "n"), FIRST, False, most)
    so_far = components(first)
    named = nodes.join(so_far, "node", "left").select(F.coalesce("root", "node").alias("node"), "fa", "fb", "keys", "n")
    rest = _met(named, [t for t in range(TABLES) if t not in FIRST], True, most)
    return so_far.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest).filter("a != b")


def _met(nodes: DataFrame, tables: list[int], short: bool, most: int) -> DataFrame:
    """`a, b`: links that connect the names of what shares a key of these tables and is alike.

    Texts of a key come in order, so the hub of what is alike is its least name, in all tables that hold it: the same link found in
    many tables is one. Keys with more than `most` texts are dealt into parts of about most / 2, and each pair of parts is a task.
    """
    rows = nodes.mapInArrow(trimmed(_keyed(tables, short)), "key long, node long, fa long, fb long, n int")
    schema = "key long, a long, b long, fa long, fb long, n long"
    found = store(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_candidates(most)), schema), "shingled-links")
    links, large = found.filter("b is not null and a != b").select("a", "b"), found.filter("b is null").drop("b")
    if large.isEmpty():
        return links.distinct()
    sizes = large.groupBy("key").count().withColumn("parts", F.ceil(F.col("count") * 2 / F.lit(most)).cast("int"))
    dealt = large.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)"))).select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "a", "fa", "fb", "n")

    def solve(pdf):
        pdf = pdf.sort_values("a", kind="stable")
        left, right = close(pdf["a"].to_numpy(), pdf[["fa", "fb"]].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy())
        return pdf.iloc[:0][["a"]].assign(b=[]) if not left else type(pdf)({"a": left, "b": right})

    return links.distinct().union(dealt.groupBy("key", "lo", "hi").applyInPandas(solve, "a long, b long"))


def sharing(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which sets may be similar to another: of the rarest members, all but those that may differ and one, one is in those of another."""
    rare = np.bincount(flat)[flat]
    order = np.lexsort((flat, rare, at))
    begin = np.cumsum(size) - size
    kept = order[np.arange(len(flat)) - begin[at] <= (size - (4 * size + 4) // 5)[at]]
    common = np.bincount(flat[kept])[flat[kept]] > 1
    out = np.zeros(len(size), bool)
    out[at[kept[common]]] = True
    return out


def similar(node: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph that links sets of Jaccard similarity 0.8 or more, counted exactly."""
    left, right = [], []
    size = np.array([len(s) for s in sets], np.int64)
    vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.repeat(np.arange(len(node)), size)
    some = sharing(flat, at, size)
    if not some.all():  # the others are similar to none
        node, size, flat = node[some], size[some], flat[some[at]]
        at = np.repeat(np.arange(len(node)), size)
    own = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(vocab), bool)
    rest = np.ones(len(node), bool)
    for seed in range(len(node)):
        if not rest[seed]:
            continue
        rest[seed] = False
        queue = [seed]
        while queue and rest.any():
            one = queue.pop()
            held = rest[at]
            flat, at = flat[held], at[held]
            mark[own[one]] = True
            shared = np.bincount(at[mark[flat]], minlength=len(node))
            mark[own[one]] = False
            near = np.flatnonzero(rest & (5 * shared >= 4 * (size + size[one] - shared)))
            left += [int(node[one])] * len(near)
            right += node[near].tolist()
            rest[near] = False
            queue += near.tolist()
    return left, right


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, lo, hi, node, shingles) sorted by the first three to the links of each group."""

    def solve(node, sets):
        left, right = similar(np.array(node, np.int64), sets) if len(node) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    now, node, sets = None, [], []
    for batch in batches:
        root, lo, hi, ids = (batch.column(i).to_pylist() for i in range(4))
        for i, group in enumerate(zip(root, lo, hi)):
            if group != now:
                if len(node) > 1:
                    yield solve(node, sets)
                now, node, sets = group, [], []
            node.append(ids[i])
            sets.append(np.array(batch.column(4)[i].values))
    if len(node) > 1:
        yield solve(node, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, node, root) to (root, node, shingles); a row that only repeats the id of the node's text goes."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            own, off, h = text_shingles(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))
            node = np.asarray(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(2), lists], ["root", "node", "shingles"]).filter(pa.array(own.view(np.int64) == node))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BUCKET, group: int = GROUP) -> DataFrame:
    """`id, node, component_id`: each row of non-null id, its text's hash, and the smallest id reachable by links of Jaccard
    similarity 0.8 or more. Texts of equal words are one before any table is built; so are all texts without words."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    kind = source.schema["id"].dataType.simpleString()
    prints = store(source.mapInArrow(trimmed(_prints), f"id {kind}, node long, fa long, fb long, keys array<long>, n int"), "shingled-prints")
    nodes = store(prints.groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct("fa", "fb", "keys", "n")).alias("p")).select("node", "rep", "p.*"), "shingled-nodes")
    met = components(candidate_links(nodes, most))
    wanted = nodes.join(met, "node").select("rep", "node", "root")
    texts = source.join(wanted, F.col("id") == F.col("rep")).select("id", "text", "node", "root")
    sets = store(texts.mapInArrow(trimmed(_sets), "root long, node long, shingles array<long>").dropDuplicates(["node"]), "shingled-sets")
    parts = sets.groupBy("root").agg(F.ceil(F.sum(F.size("shingles")) * 2 / F.lit(group)).cast("int").alias("parts"))
    whole = parts.filter("parts <= 2").select("root")
    plain = sets.join(whole, "root", "left_semi").select("root", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", "shingles")
    dealt = sets.join(parts.filter("parts > 2"), "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = plain.union(dealt.select("root", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "node", "shingles"))
    rows = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    links = rows.mapInArrow(trimmed(_compare), "a long, b long")
    rooted = store(nodes.select("node", "rep").join(components(links).withColumnRenamed("root", "top"), "node", "left").select("node", "rep", F.coalesce("top", "node").alias("top")), "shingled-roots")
    least = rooted.groupBy("top").agg(F.min("rep").alias("component_id"))
    return prints.select("id", "node").join(rooted.join(least, "top").select("node", "component_id"), "node").select("id", "node", "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that have a near-duplicate of smaller id; of rows that repeat an id one stays. Rows of null id stay."""
    found = store(near_duplicates(docs, id_col, text_col, **options), "shingled-found")
    name = fresh("__gone", docs.columns)
    gone = found.filter("id != component_id").select(F.col("id").alias(name)).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    if found.groupBy("id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.filter(F.col(id_col).isNull()))
