"""Approximate nearest neighbours (operator 9): a forest of random-projection trees.

Every tree splits the space by hyperplanes midway between two random points, until a leaf
holds at most ``LEAF`` sample rows.  The forest is fitted on a bounded sample
(``SAMPLE_ROWS``) and broadcast; every vector is then put into its leaf of every tree.
A query walks all trees through one shared priority queue, always opening the branch
whose margin to the query is best, until the leaves it has reached hold enough sample
rows.  How many are enough is measured: sample queries are compared with brute force over
the sample, and the smallest budget with a recall of ``RECALL`` is taken (data without
clusters needs a large share of all rows, clustered data a small one).  Leaves are dealt
into blocks, a block's rows into sub-blocks of about ``BLOCK_ROWS`` (also if they are of
one leaf) and the queries into chunks of about ``CHUNK_QUERIES``; a sub-block and the
queries of a chunk that reached it meet in one Python call, which reranks by exact cosine
and returns each query's best.

Equal vectors are one *class*: leaves hold classes, so a vector that a third of all rows
share is one candidate.  Of a class only the ``k + 1`` smallest ids can be in a result
(ties go to the smaller id, and one may be the query itself), which is exact.  Scaled
copies of a vector are classes of their own: their cosines can differ in the last digit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .bpe import slices
from .sample import about

SAMPLE_ROWS = 100_000
SAMPLE_QUERIES = 200
TREES = 16
LEAF = 48
RECALL = 0.96
MIN_CANDIDATES = 1_000
# Index rows and queries that meet in one Python call, in expectation.
BLOCK_ROWS = 50_000
CHUNK_QUERIES = 10_000
K = 5
SEED = 42


class Forest:
    """Nodes of all trees in flat arrays: ``plane`` and ``bias`` of inner nodes, children
    (``>= 0`` an inner node, ``< 0`` leaf number ``~child``), ``size`` of leaves (sample rows)."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.bias: list[float] = []
        self.child: list[list[int]] = []
        self.size: list[int] = []
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)] if len(sample) else []
        self.plane = np.array(self.planes, dtype=np.float32).reshape(len(self.planes), sample.shape[1])
        self.bias = np.array(self.bias, dtype=np.float32)
        del self.planes

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        """Node number of the tree over ``rows`` (an explicit stack: depth is no limit)."""
        root: list[int] = [0]
        stack = [(rows, root, 0)]
        while stack:
            rows, home, side = stack.pop()
            split = self._split(x, rows, rng) if len(rows) > leaf else None
            if split is None:
                self.size.append(len(rows))
                home[side] = ~(len(self.size) - 1)
                continue
            plane, bias, right = split
            self.planes.append(plane)
            self.bias.append(bias)
            self.child.append([0, 0])
            home[side] = len(self.child) - 1
            stack += [(rows[~right], self.child[-1], 0), (rows[right], self.child[-1], 1)]
        return root[0]

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, rng):
        for _ in range(5):
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = a - b
            norm = np.linalg.norm(plane)
            if norm < 1e-9:
                continue
            plane = plane / norm
            bias = -float(plane @ (a + b)) / 2
            right = x[rows] @ plane + bias > 0
            if 0.05 < right.mean() < 0.95:
                return plane, bias, right
        return None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every vector in every tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        child = np.array(self.child, dtype=np.int64).reshape(-1, 2)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (open_ := np.flatnonzero(at >= 0)).size:
                node = at[open_]
                side = np.einsum("ij,ij->i", x[open_], self.plane[node]) + self.bias[node] > 0
                at[open_] = child[node, side.astype(np.int64)]
            out[:, t] = ~at
        return out

    def search(self, q: np.ndarray, candidates: int) -> list[int]:
        """Leaves for one query: branches of all trees wait in one queue by their margin."""
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        margins = self.plane @ q + self.bias
        found, held = [], 0
        while queue and held < candidates:
            worst, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(worst, abs(float(m))), self.child[node][far]))
                node = self.child[node][near]
            found.append(~node)
            held += max(1, self.size[~node])
        return found


def calibrate(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL,
              n_queries: int = SAMPLE_QUERIES) -> int:
    """The smallest budget (doubling, then halving the step) whose recall of the k nearest
    sample rows reaches ``recall`` over sample queries."""
    n = len(sample)
    if n <= MIN_CANDIDATES:
        return n * max(1, len(forest.roots))
    queries = np.random.default_rng(SEED).choice(n, min(n_queries, n), replace=False)
    near = []
    for q in queries:
        s = sample @ sample[q]
        s[q] = -np.inf
        near.append(np.argpartition(-s, k)[:k])
    leaf = forest.leaves(sample)

    def reached(budget: int) -> float:
        hit = 0
        for q, best in zip(queries, near):
            found = forest.search(sample[q], budget)
            hit += np.isin(leaf[best], found).any(axis=1).sum()
        return hit / (k * len(queries))

    budget = MIN_CANDIDATES
    while budget < n * len(forest.roots) and reached(budget) < recall:
        budget = int(budget * 1.3)
    return budget


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.values.slice(col.offsets[0].as_py(), col.offsets[-1].as_py() - col.offsets[0].as_py())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def sub_blocks(leaf_rows: np.ndarray, blocks: int, rows: int) -> np.ndarray:
    """Into how many sub-blocks of about ``rows`` rows every block is split; leaf n is in
    block n % blocks and holds ``leaf_rows[n]`` rows in expectation."""
    held = np.bincount(np.arange(len(leaf_rows)) % blocks, weights=leaf_rows, minlength=blocks)
    return np.maximum(1, np.ceil(held / rows)).astype(np.int64)


def classes(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(cls, vector, ids): equal vectors together, with their k + 1 smallest ids; ``cls`` is
    unique once the table is written (an id can be in several classes).

    Null vectors and ids, empty and zero vectors, and vectors that hold a null, NaN or
    infinite component take no part.  The ids are cut by a window limit, which Spark
    applies before the shuffle, so a hot vector sends k + 1 rows per task."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double") + F.lit(0.0))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    good = (df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
            .filter(F.col("vec_id").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda c: c != 0)))
    w = Window.partitionBy("vector").orderBy("vec_id")
    return (good.dropDuplicates(["vector", "vec_id"]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
            .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .withColumn("cls", F.monotonically_increasing_id()))


def nearest(df: DataFrame, query_ids: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            trees: int = TREES, leaf: int = LEAF, recall: float = RECALL,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every id in
    ``query_ids`` (one column), by cosine in double precision, ties to the smaller id.

    The query's own id is no candidate.  Queries whose vector takes no part give no rows;
    repeated rows (same id and vector) count once; an id with several vectors is as near
    as its nearest one.  All vectors must have one length.  Other columns are not read.
    With fewer rows than leaves are searched for, every row is a candidate.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "ann")
    classes(df, id_col, vector_col, k).write.parquet(f"{path}/classes")
    cls = spark.read.parquet(f"{path}/classes")
    sample = about(cls, "vector", sample_rows).select(F.xxhash64("vector").alias("hash"), "vector").toArrow()
    order = np.argsort(sample["hash"].to_numpy(), kind="stable")
    vectors = unit(_matrix(sample["vector"].combine_chunks())[order]) if len(order) else np.empty((0, 1), np.float32)
    grown = Forest(vectors, trees, leaf)
    budget = calibrate(grown, vectors, k, recall)
    n_cls = cls.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_cls * trees // BLOCK_ROWS))
    # the sample is chosen by a hash, so leaves hold rows as they hold sample rows
    subs = sub_blocks(np.array(grown.size) * (n_cls / max(1, len(vectors))), blocks, BLOCK_ROWS)
    forest = spark.sparkContext.broadcast(grown)

    # every query vector is searched once, however many queries share it
    ids = query_ids.select(F.col(query_ids.columns[0]).cast("long").alias("query_id")).distinct()
    queries = (df.select(F.col(id_col).cast("long").alias("query_id"),
                         F.transform(F.col(vector_col), lambda c: c.cast("double") + F.lit(0.0)).alias("vector"))
               .join(ids, "query_id").dropDuplicates(["query_id", "vector"])
               .join(cls.select("cls", "vector"), "vector").select("query_id", F.col("cls").alias("q")))
    queries.write.parquet(f"{path}/queries")
    queries = spark.read.parquet(f"{path}/queries")
    chunks = -(-queries.select("q").distinct().count() // CHUNK_QUERIES) or 1
    asked = cls.join(queries.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = forest.value.leaves(unit(_matrix(b.column(1))))
            row = np.repeat(np.arange(b.num_rows), found.shape[1])
            flat = found.reshape(-1)
            sub = b.column(0).to_numpy()[row] % subs[flat % blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat % blocks), pa.array(sub), pa.array(flat), *[c.take(row) for c in b.columns]],
                names=["block", "sub", "leaf", "cls", "vector", "ids"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, block, leaves = [], [], []
            for i, q in enumerate(unit(_matrix(b.column(1)))):
                found = np.array(forest.value.search(q, budget), dtype=np.int64)
                for n in np.unique(found % blocks):
                    row.append(i)
                    block.append(n)
                    leaves.append(found[found % blocks == n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, type=pa.int64()), pa.array(subs[np.array(block, dtype=np.int64)]), b.column(0).take(pa.array(row, type=pa.int64())),
                 b.column(1).take(pa.array(row, type=pa.int64())), pa.array(leaves, type=pa.list_(pa.int64()))],
                names=["block", "subs", "q", "qv", "leaves"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k + 1 ids of each query within one sub-block, each with its best score."""
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            leaf_of, cls_of = left["leaf"].to_numpy(), left["cls"].to_numpy()
            y, members = _matrix(left["vector"].combine_chunks()), left["ids"].combine_chunks()
            n_ids = members.value_lengths().to_numpy(zero_copy_only=False)
            ids, first_id = members.flatten().to_numpy(zero_copy_only=False), np.cumsum(n_ids) - n_ids
            order = np.argsort(leaf_of, kind="stable")
            leaf_of, cls_of, y, n_ids, first_id = leaf_of[order], cls_of[order], y[order], n_ids[order], first_id[order]
            y_norm = np.sqrt((y * y).sum(axis=1))
            for q, x, wanted in zip(right["q"].to_pylist(), _matrix(right["qv"].combine_chunks()),
                                    right["leaves"].to_pylist()):
                start, stop = np.searchsorted(leaf_of, wanted), np.searchsorted(leaf_of, wanted, side="right")
                at = np.concatenate([np.arange(s, e) for s, e in zip(start, stop)])
                at = at[np.unique(cls_of[at], return_index=True)[1]]
                cos = (x * y[at]).sum(axis=1) / (np.sqrt((x * x).sum()) * y_norm[at])
                # the nearest classes, ties included, until they hold k + 1 different ids
                take = k + 1
                while True:
                    top = cos >= -np.partition(-cos, take - 1)[take - 1] if take < len(cos) else np.full(len(cos), True)
                    near = np.flatnonzero(top)[np.argsort(-cos[top], kind="stable")]
                    n = n_ids[at[near]]
                    flat = np.repeat(first_id[at[near]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    i, first = np.unique(ids[flat], return_index=True)
                    if len(i) > k or take >= len(cos):
                        break
                    take *= 4
                score = np.repeat(cos[near], n)[first]
                best = np.lexsort((i, -score))[: k + 1]
                out_q += [q] * len(best)
                out_i += i[best].tolist()
                out_s += score[best].tolist()
        return pa.table({"q": pa.array(out_q, type=pa.int64()), "vec_id": pa.array(out_i, type=pa.int64()),
                         "score": pa.array(out_s, type=pa.float64())})

    # every sub-block meets every chunk: rows are copied per chunk, queries per sub-block
    index = cls.select("cls", "vector", "ids").mapInArrow(
        place, "block long, sub long, leaf long, cls long, vector array<double>, ids array<long>")
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    reached = asked.select("cls", "vector").mapInArrow(
        walk, "block long, subs long, q long, qv array<double>, leaves array<long>")
    reached = (reached.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).drop("subs")
               .withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")))
    key = ["block", "sub", "chunk"]
    scored = (index.groupBy(*key).cogroup(reached.groupBy(*key))
              .applyInArrow(rerank, "q long, vec_id long, score double")
              .groupBy("q", "vec_id").agg(F.max("score").alias("score")))
    # k + 1 ids are enough: one of them may be the query itself
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (queries.join(top, "q").filter(F.col("vec_id") != F.col("query_id"))
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
