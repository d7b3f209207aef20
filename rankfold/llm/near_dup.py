"""Near duplicates (operator 3): BagMinHash signatures, banding, exact verification.

A document is the multiset of its five-word shingles; two documents are linked if the
weighted Jaccard similarity of their multisets is 0.8 or more; classes are the connected
components of the links.

Signature: every shingle carries Poisson processes, one for each interval of its weight
(0..1, 1..2, 2..4, 4..8, ...), whose points have a register and a unit of the interval; a
point counts if its unit lies below the shingle's weight, so the points of equal shingles
with unequal weights agree as far as their weights do (the hierarchy over discretised
weights).  A register keeps its earliest point.  Two documents agree in a register with
probability equal to their weighted Jaccard similarity.  Points are drawn in order and
only until they come later than every register's, so a document of n shingles costs about
n steps, all documents of a batch together in numpy.

Banding: documents that agree in all registers of a band share a bucket.  With 24 bands
of 4, a pair at similarity 0.8 misses every bucket with probability 3e-6.

Verification, without listing all pairs of a bucket: texts with equal words are one node.
(1) Every member of a bucket is compared with the bucket's smallest member; the links'
components are found.  (2) In buckets that still hold several components, the members
outside the smallest one's component are compared with all the others, in blocks of
``BLOCK`` documents, so a hot bucket is many small tasks; pairs inside one component need
no comparison.  No link between components is lost, and nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .bpe import CACHE_CHARS, slices
from .held import cache

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
BLOCK = 256
CACHE_WORDS = 100_000
SLICE_ROWS = 200

_WORD = re.compile(r"\w+")
_G = np.uint64(0x9E3779B97F4A7C15)
_WORDS = cache("near_dup")


# -- shingles ------------------------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _word_hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word)
    if len(word) <= CACHE_CHARS:
        if len(_WORDS) >= CACHE_WORDS:
            _WORDS.clear()
        _WORDS[word] = h
    return h


def shingles(ws: list[str], size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of all runs of ``size`` words, repeats included; a shorter text is one
    shingle, a text without words has none."""
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.array([_WORDS.get(w) or _word_hash(w) for w in ws], dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = mix64(out * _G + h[k:k + n])
    out.sort()
    return out


def digest(ws: list[str]) -> bytes:
    return xxhash.xxh128_digest("\x00".join(ws))


def counted(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, counts) of a sorted array."""
    if not len(sorted_hashes):
        return sorted_hashes, np.empty(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
    return sorted_hashes[at], np.diff(np.append(at, len(sorted_hashes)))


# -- BagMinHash ------------------------------------------------------------------------------
def signatures(docs: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """(documents, registers) of points as float64; equal values mean the same point.

    ``docs``: the sorted shingle hashes of each document; one without any keeps infinity."""
    n = len(docs)
    regs = np.full((n, registers), np.inf)
    flat = regs.reshape(-1)
    parts = [counted(d) for d in docs]
    value = np.concatenate([p[0] for p in parts]) if n else np.empty(0, np.uint64)
    weight = np.concatenate([p[1] for p in parts]) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(p[0]) for p in parts])
    # one process for every interval (low, high] that starts below the weight
    seeds, owners, weights, lows, highs = [], [], [], [], []
    low, high = 0, 1
    with np.errstate(over="ignore"):
        while len(value):
            seeds.append(mix64(value + np.uint64(high) * _G))
            owners.append(owner)
            weights.append(weight)
            lows.append(np.full(len(value), low))
            highs.append(np.full(len(value), high))
            low, high = high, 2 * high
            more = weight > low
            value, weight, owner = value[more], weight[more], owner[more]
        if not seeds:
            return regs
        seed, owner, weight = np.concatenate(seeds), np.concatenate(owners), np.concatenate(weights)
        low, high = np.concatenate(lows), np.concatenate(highs)
        x = np.zeros(len(seed))
        step = np.uint64(0)
        while len(seed):
            step += np.uint64(1)
            r = mix64(seed + step * _G)
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / (registers * (high - low))
            r = mix64(r ^ _G)
            register = (r >> np.uint64(40)).astype(np.int64) % registers
            unit = low + 1 + (((r & np.uint64(2 ** 40 - 1)).astype(np.float64) * 2.0 ** -40) * (high - low)).astype(np.int64)
            counts = unit <= weight
            np.minimum.at(flat, (owner * registers + register)[counts], x[counts])
            left = x < regs.max(axis=1)[owner]
            if not left.all():
                seed, owner, weight, low, high, x = (v[left] for v in (seed, owner, weight, low, high, x))
    return regs


def band_keys(regs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) bucket keys as signed 64-bit integers."""
    bits = regs.view(np.uint64).reshape(len(regs), bands, -1)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, bits.shape[:2]).copy()
        for r in range(bits.shape[2]):
            key = mix64(key * _G + bits[:, :, r])
    return key.view(np.int64)


# -- verification ----------------------------------------------------------------------------
def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes, whole."""
    return hashes.astype("<u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of hashes."""
    (u, m), (v, n) = counted(a), counted(b)
    at = np.searchsorted(u, v)
    at[at == len(u)] = 0
    same = u[at] == v if len(u) else np.zeros(len(v), dtype=bool)
    overlap = np.minimum(m[at[same]], n[same]).sum()
    return overlap / max(1, len(a) + len(b) - overlap)


def links_within(ids: list[int], comps: list[int], docs: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the components of one block: every pair of different components is
    compared until the block is one component (exact; a spanning set is returned)."""
    label = {}
    root = [label.setdefault(c, i) for i, c in enumerate(comps)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    parts = [counted(d) for d in docs]
    values, local = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.concatenate([p[1] for p in parts])
    sizes = np.array([len(p[0]) for p in parts])
    ends = np.cumsum(sizes)
    totals = np.array([len(d) for d in docs])
    mine = np.zeros(len(values), dtype=np.int64)
    out = []
    for i in range(len(ids) - 1):
        r = find(i)
        if all(find(j) == r for j in range(i + 1, len(ids))):
            continue
        s, e = ends[i] - sizes[i], ends[i]
        mine[local[s:e]] = counts[s:e]
        overlap = np.add.reduceat(np.minimum(mine[local[e:]], counts[e:]), ends[i:-1] - e)
        mine[local[s:e]] = 0
        alike = overlap >= least * (totals[i] + totals[i + 1:] - overlap)
        for j in np.flatnonzero(alike) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                out.append((ids[i], ids[int(j)]))
    return out


# -- Spark side --------------------------------------------------------------------------------
def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, comp): the smallest node of every connected component, for all nodes of the
    edges (columns a, b).

    Stars are contracted in turns: every node points its larger neighbours, then its
    smaller ones, to the smallest it knows.  Each round is written to the shared folder."""
    spark = edges.sparkSession
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))

    def step(e: DataFrame, path: str) -> DataFrame:
        e.distinct().write.parquet(path)
        return spark.read.parquet(path)

    now = step(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{folder}/0")
    seen, k = now.agg(state.alias("s")).first().s, 0
    while seen.n:
        k += 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = step(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")), f"{folder}/{k}l")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        now = step(small.select("a", F.col("low").alias("b"))
                   .union(small.filter("b <> low").select("b", "low")), f"{folder}/{k}s")
        before, seen = seen, now.agg(state.alias("s")).first().s
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _read(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, digest, bands (null without words)."""
    cache("near_dup")
    for b in slices(batches, SLICE_ROWS):
        ws = [words(t) for t in b.column(2).to_pylist()]
        keys = band_keys(signatures([shingles(w) for w in ws]))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(ws) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)),
                                         mask=pa.array([not w for w in ws]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest(w) for w in ws], type=pa.binary()), bands],
                                         names=["doc_id", "h", "digest", "bands"])


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, digest, text -> node, shingles; rows whose text has another digest go."""
    cache("near_dup")
    for b in slices(batches, SLICE_ROWS):
        rows = [(n, words(t), d) for n, d, t in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows = [(n, pack(shingles(w))) for n, w, d in rows if digest(w) == d]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()),
                                          pa.array([r[1] for r in rows], type=pa.binary())], names=["node", "shingles"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = pa.array([similarity(unpack(x), unpack(y)) >= least for x, y in zip(a, c)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])
    return run


def _compare(least: float):
    """Rows task, node, comp, shingles, sorted by task: the links within each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, []

        def links():
            found = links_within([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], least) \
                if len({g[1] for g in group}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], type=pa.int64()),
                                               pa.array([f[1] for f in found], type=pa.int64())], names=["a", "b"])

        for b in slices(batches, SLICE_ROWS):
            for t, node, comp, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                if t != task and group:
                    yield links()
                    group = []
                task = t
                group.append((node, comp, unpack(raw)))
        if group:
            yield links()
    return run


def _tasks(mixed: DataFrame, block: int) -> DataFrame:
    """Block pairs of buckets that hold several components.

    mixed: key, node, comp, rest (not in the smallest member's component), n_rest, n_core.
    Rest blocks meet each other and every core block; core blocks do not meet."""
    rest_blocks = F.ceil(F.col("n_rest") / block).cast("int")
    core_blocks = F.ceil(F.col("n_core") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), rest_blocks).otherwise(core_blocks)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    name = lambda kind, i, j: F.concat_ws(":", F.col("key"), F.lit(kind), i, j)
    with_rest = F.transform(upto(rest_blocks), lambda j: F.when(
        F.col("rest"), name("r", F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))).otherwise(name("c", j, F.col("mine"))))
    with_core = F.transform(F.when(F.col("rest"), upto(core_blocks)).otherwise(upto(F.lit(0))),
                            lambda j: name("c", F.col("mine"), j))
    return mixed.withColumn("mine", mine).select(F.explode(F.concat(with_rest, with_core)).alias("task"), "node", "comp")


def _links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, folder: str, least: float, block: int) -> DataFrame:
    """The links (a, b) between nodes that make all components."""
    rows = nodes.filter("bands is not null").select("node", F.explode("bands").alias("key"))
    # buckets of two and more; of buckets with the same members one is enough
    buckets = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("y"), F.min("node").alias("hub"))
               .filter("n > 1").groupBy("n", "x", "y", "hub").agg(F.min("key").alias("key")).select("key", "hub"))
    members = _read(rows.join(buckets, "key").select("key", "hub", "node"), f"{folder}/members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "h", "digest")
    d, w = docs.alias("d"), wanted.alias("w")
    texts = d.join(w, F.col("d.h").eqNullSafe(F.col("w.h")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select(
        "w.node", "w.digest", "d.text")
    sh = _read(texts.mapInArrow(_shingle, "node long, shingles binary").dropDuplicates(["node"]), f"{folder}/shingles")

    # (1) every member against the smallest of its bucket
    pairs = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = _read(pairs.join(sh.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
                  .join(sh.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
                  .select("a", "b", "sa", "sb").mapInArrow(_verify(least), "a long, b long"), f"{folder}/first")
    comps = _read(components(first, f"{folder}/components1"), f"{folder}/comps1")

    # (2) buckets with several components: members outside the hub's component against all others
    named = (members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
             .join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", "left")
             .withColumn("hub_comp", F.coalesce("hub_comp", "hub")).filter("node <> hub")
             .withColumn("rest", F.col("comp") != F.col("hub_comp")))
    sizes = (named.groupBy("key").agg(F.count(F.when(F.col("rest"), 1)).alias("n_rest"),
                                      F.count(F.when(~F.col("rest"), 1)).alias("n_core"),
                                      F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").drop("low", "high"))
    tasks = _tasks(named.join(sizes, "key"), block).join(sh, "node").select("task", "node", "comp", "shingles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    second = _read(tasks.repartition(n, "task").sortWithinPartitions("task")
                   .mapInArrow(_compare(least), "a long, b long"), f"{folder}/second")
    return first.union(second)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
            block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size, kept (one row of each
    class: its smallest id), h (hash of the text): one row per row of ``df``.

    Null and empty texts, and texts without words, have no shingles: all of them are one
    class of equal texts.  Null ids come after all others and are kept only if their class
    has no other.  Repeated rows are equal texts; all rows of the kept id and text are
    marked (``keep`` returns one).  Only the two named columns are read.  An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark, "near-dup")
    docs = _keyed(df, id_col, text_col)
    signed = _read(docs.mapInArrow(_sign, "doc_id long, h long, digest binary, bands array<long>")
                   .withColumn("uid", F.monotonically_increasing_id()), f"{folder}/signed")
    # nodes: texts with equal words, named by their first row
    firsts = signed.groupBy("digest").agg(F.min("uid").alias("node"))
    nodes = _read(signed.join(firsts.select("node"), F.col("uid") == F.col("node"), "left_semi")
                  .withColumnRenamed("uid", "node"), f"{folder}/nodes")
    links = _links(spark, docs, nodes, folder, least, block)
    comps = _read(components(links, f"{folder}/components2"), f"{folder}/comps2")
    named = nodes.select("node", "digest").join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    rows = _read(signed.select("doc_id", "h", "uid", "digest").join(named, "digest").drop("digest"), f"{folder}/named")
    # the smallest id of each class (nulls last); of several texts with it, the first row's.
    # Counted per task before the shuffle, and written, so that the join back is a plain one
    # whose hot classes Spark can split.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid", "h")
    best = _read(rows.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
                 .select("comp", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("kept_h")),
                 f"{folder}/classes")
    return rows.join(best, "comp").select(
        "doc_id", "class_id", "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("h").eqNullSafe(F.col("kept_h"))).alias("kept"), "h")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each class."""
    marks = classes(df, id_col, text_col, least).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct().alias("m")
    # the row goes along as one column, so that no working column clashes with its names
    keyed = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"),
                      F.xxhash64(text_col).alias("_h")).alias("d")
    on: Column = F.col("d._h").eqNullSafe(F.col("m._h")) & F.col("d._id").eqNullSafe(F.col("m._id"))
    return keyed.join(marks, on, "left_semi").dropDuplicates(["_id", "_h"]).select("row.*")
