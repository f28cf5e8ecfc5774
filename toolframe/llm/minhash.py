"""Near-duplicate documents by bottom-k sketches.

One hash function per shingle. A document's sketch is its k smallest hashes.

1. Documents with equal shingle sets become one class, kept by its smallest id.
2. Inverted lists: of a sketch's values, ordered from rare to common, only the
   first k - m + 1 are posted. Two sketches that share m values share one of
   those, so very common values (passages, boilerplate) rarely make a list.
3. In a list every member is compared with the list's smallest id: the overlap
   of both sketches estimates the likeness from the union's smallest values,
   and pairs far below the threshold fall out. In the few lists where some
   member fails, all members are compared in blocks, and a block hands on a
   spanning forest of its close pairs, never all of them.
4. The close pairs' components bound where links can lie. The full shingle
   sets of a component's members are compared exactly, again in blocks that
   hand on a spanning forest of true links; their components are the result.

Every row count is linear in the documents times k, and no group has to fit
into one task. At the threshold itself a link is lost with a chance of about
1e-9 (all of k = 48 values must fall unluckily); above it far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolframe.llm.common import mix64, ship, slices, text_words, written
from toolframe.llm.graph import components

WORDS, THRESHOLD = 5, 0.85
SKETCH, SHARED = 48, 20  # k, and the values that two linked sketches share at least
CLOSE = 0.5  # estimates below this are no links
BLOCK = 512  # members of one side of a block of full sets; sketches are compared in blocks twice as wide


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole sequence where there are fewer, none without words."""
    h = text_words(text)
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    size = min(n, words)
    with np.errstate(over="ignore"):
        out = h[: n - size + 1].copy()
        for j in range(1, size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j: n - size + 1 + j])
    out = mix64(out ^ np.uint64(size))
    return np.unique(out.view(np.int64))


def sketches(docs: DataFrame, words: int = WORDS, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, sketch): c1 and c2 identify the shingle set, sketch is its k smallest hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t or "", words) for t in b.column(1).to_pylist()]
            with np.errstate(over="ignore"):
                c1 = [int(mix64(s.view(np.uint64)).sum().astype(np.int64)) for s in sets]
                c2 = [int(mix64(s.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                                              pa.array([s[:k] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "c1", "c2", "sketch"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, sketch array<long>")


def overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[value] > 1
    who, value = who[shared], value[shared]
    out = np.zeros((n, n), np.float32)
    if len(value):
        dense = np.cumsum(counts > 1) - 1  # only values that two sets hold take part
        value = dense[value]
        order = np.argsort(value, kind="stable")
        who, value = who[order], value[order]
        for first in range(0, int(value[-1]) + 1, columns):
            a, b = np.searchsorted(value, [first, first + columns])
            part = np.zeros((n, columns), np.float32)
            part[who[a:b], value[a:b] - first] = 1
            out += part @ part.T
    return out


def _forest(ids: np.ndarray, labels: np.ndarray, good: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the good pairs that joins different labels.

    A row looks for neighbours of other trees, not at every pair, and a tree
    is relabelled at most once per edge: families of copies, whose pairs are
    nearly all good, cost no more than others.
    """
    tree, out = np.unique(labels, return_inverse=True)[1], []
    for i in range(1, len(ids)):
        near = np.flatnonzero(good[i, :i])
        while len(near := near[tree[near] != tree[i]]):
            j = near[0]
            tree[tree == tree[j]] = tree[i]
            out.append((int(ids[i]), int(ids[j])))
    return out


def _close(members: list[np.ndarray], sizes: np.ndarray, threshold: float, close: float) -> np.ndarray:
    """Pairs of sketches whose estimate reaches ``close`` and whose sizes allow a link."""
    both = overlaps(members)
    last, full = np.array([m[-1] for m in members]), np.array([len(m) for m in members], np.int32)
    below = np.stack([np.searchsorted(m, last, side="right") for m in members]).astype(np.int32)  # values of row's sketch up to column's last
    low = np.where(last[:, None] <= last[None, :], full[:, None] + below.T, below + full[None, :])
    ratio = np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    return (both >= close * (low - both)) & ratio


def _blocks(rows: DataFrame, key: str, size: int, id_col: str) -> DataFrame:
    """Deal each key's rows into chunks of about ``size`` and give every pair of chunks (and each chunk alone) a block: key, x, y."""
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
    dealt = rows.join(counts, key).withColumn("c", F.pmod(F.xxhash64(id_col), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("x"), F.greatest("c", o).alias("y")))
    return dealt.withColumn("p", F.explode(pair)).select("*", F.col("p.x").alias("x"), F.col("p.y").alias("y")).drop("p", "c", "chunks")


def _listed(table: pa.Table, name: str) -> list[np.ndarray]:
    col = table.column(name).combine_chunks()
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


EDGE = "a long, b long"
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}, schema=_EDGE)


def candidates(classes: DataFrame, threshold: float, k: int, shared: int, close: float, block: int) -> DataFrame:
    """Close pairs of classes (id, n, sketch) whose components hold every link."""
    values = classes.select("id", F.size("sketch").alias("z"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    posted = values.join(counts.hint("shuffle_merge"), "value")
    ranked = posted.groupBy("id", "z").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("x"))
    room = F.col("z") - F.ceil(F.col("z") * shared / k) + 1 - (F.col("z") - F.size("x"))  # values of one document come first and make no list
    lists = ranked.where(room > 0).select("id", F.explode(F.slice("x", 1, room.cast("int"))).alias("x")).select("id", F.col("x.value").alias("value"))
    lists = written(lists, "postings")
    heads = lists.groupBy("value").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = lists.join(heads.hint("shuffle_merge"), "value").select("value", "id", "head")
    pairs = stars.where("id <> head").select("id", "head").distinct()
    slim = classes.select("id", "n", "sketch")
    first = pairs.join(slim, "id").join(slim.select(F.col("id").alias("head"), F.col("n").alias("hn"), F.col("sketch").alias("hs")), "head")
    last = F.least(F.element_at("sketch", -1), F.element_at("hs", -1))
    both = F.size(F.array_intersect("sketch", "hs"))
    union = F.size(F.filter("sketch", lambda v: v <= last)) + F.size(F.filter("hs", lambda v: v <= last)) - both
    ratio = F.least("n", "hn") >= F.greatest("n", "hn") * threshold - 1e-9
    near = written(first.where(ratio & (both >= union * close)).select(F.col("id").alias("a"), F.col("head").alias("b")), "stars")

    # lists in which some member isn't close to the head: compare all members, those that are close under the head's label
    marked = stars.join(near.select(F.col("a").alias("id"), F.col("b").alias("head"), F.lit(1).alias("hit")), ["id", "head"], "left")
    marked = marked.withColumn("label", F.when(F.col("hit").isNotNull(), F.col("head")).otherwise(F.col("id")))
    open_ = marked.groupBy("value").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("value")
    rest = marked.join(open_.hint("shuffle_merge"), "value").select("value", "id", "label")
    blocks = _blocks(rest.join(slim, "id"), "value", 2 * block, "id")

    def compare(table: pa.Table) -> pa.Table:
        members = _listed(table, "sketch")
        good = _close(members, table["n"].to_numpy(), threshold, close)
        return _edges(_forest(table["id"].to_numpy(), table["label"].to_numpy(), good))

    far = blocks.groupBy("value", "x", "y").applyInArrow(compare, EDGE)
    return near.unionByName(far)


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """A spanning forest of the true links within groups (node, root) of classes, from full shingle sets."""
    texts = classes.select("id", "doc_id").join(groups, F.col("id") == F.col("node")).select("doc_id", "id", "root")
    members = docs.join(texts.hint("shuffle_merge"), "doc_id").select("id", "root", "text")
    blocks = _blocks(written(members, "members"), "root", block, "id")
    percent = round(threshold * 100)

    def verify(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets = [shingles(t or "", words) for t in table["text"].to_pylist()]
        if len(sets) < 2:
            return _edges([])
        sizes = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets).astype(np.float64)
        good = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        return _edges(_forest(ids, ids, good))

    return blocks.groupBy("root", "x", "y").applyInArrow(verify, EDGE)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, k: int = SKETCH, shared: int = SHARED,
                    close: float = CLOSE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, kept marks it.
    Null and empty texts, and texts without words, have no shingles, link with
    nothing and are kept. A row without a doc_id links with nothing either
    (component_id null, kept). Rows that repeat a doc_id are one node: they
    get one component, and all of them carry the same kept. Other columns are
    ignored; no rows give no rows.
    """
    if not math.ceil(k * threshold) > shared:
        raise ValueError("two linked sketches must share more values than asked")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(sketches(docs, words, k), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = written(classes.select("id", F.col("n_shingles").alias("n"), "c1", "c2", "sketch"), "classes")
    close_pairs = candidates(classes, threshold, k, shared, close, block)
    groups = components(close_pairs, "a", "b")
    found = links(docs, classes.select("id", F.col("id").alias("doc_id")).distinct(), groups, words, threshold, block)
    # a doc_id in several classes makes them one node
    own = full.join(classes.withColumnRenamed("n", "n_shingles").hint("shuffle_merge"), ["c1", "c2", "n_shingles"]).select("doc_id", "id")
    least = own.groupBy("doc_id").agg(F.min("id").alias("m"), F.max("id").alias("top")).where("m < top")
    twice = own.join(least, "doc_id").select(F.col("id").alias("a"), F.col("m").alias("b"))
    roots = components(found.unionByName(twice), "a", "b")
    named = classes.join(roots, F.col("id") == F.col("node"), "left").select("c1", "c2", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    linked = full.join(named.hint("shuffle_merge"), ["c1", "c2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
