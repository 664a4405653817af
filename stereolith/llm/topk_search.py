"""Exact top-k search by inner product, by no-random-access aggregation over sorted lists.

Vectors are packed into blocks of ``BLOCK`` rows, which stay where they are: queries travel, as a broadcast of at most ``QUERY_BYTES``,
in as many rounds as they need. A task makes one sorted list per dimension of each block of its own. For each query the lists are
read from their better ends in steps; what has been seen of a vector gives its lower bound (unseen components at their worst) and its
upper bound (unseen components at the lists' current values). Reading stops when all but a few vectors have an upper bound below
the k-th lower bound, and below the k-th score of the task's earlier blocks; the scores of those few are resolved. Each task returns
k rows a query, and a windowed limit picks k of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import Scratch

BLOCK = 4096
QUERIES = 256
#: Bytes of queries that are broadcast at a time.
QUERY_BYTES = 32_000_000
#: Components beyond are held at it, and scores at the ends of 64 bits; up to ``EXACT`` sums of products are whole in a double.
MOST, EXACT, LONG = 2.0**62, 2**53, 2**63 - 1


def _packed(size: int, scale: int):
    """Rows (vec_id, embedding) to blocks (dim, ids, values): finite vectors as floor(scale * x), little-endian 64-bit."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "v": pa.array([values.astype("<i8").tobytes()], pa.binary())})

        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            use = np.asarray(rows.is_valid()) & np.asarray(ids.is_valid())
            ids, rows = ids.filter(pa.array(use)), rows.filter(pa.array(use))
            if not len(ids):
                continue
            length = np.asarray(rows.value_lengths())
            flat = rows.flatten()
            ok = np.asarray(flat.is_valid()) & np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
            with np.errstate(over="ignore"):
                flat = np.floor(scale * np.where(ok, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0)).clip(-MOST, MOST).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(length)])
            bad = np.concatenate([[0], np.cumsum(~ok)])
            good = bad[first[1:]] == bad[first[:-1]]
            name = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(length[good]):
                on = np.flatnonzero(good & (length == dim))
                held = waiting.setdefault(int(dim), ([], []))
                held[0].append(name[on])
                held[1].append(flat[first[on][:, None] + np.arange(dim)])
                while sum(map(len, held[0])) >= size:
                    i, v = np.concatenate(held[0]), np.concatenate(held[1])
                    yield block(int(dim), i[:size], v[:size])
                    held[0][:], held[1][:] = [i[size:]], [v[size:]]
        for dim, (i, v) in waiting.items():
            if sum(map(len, i)):
                yield block(dim, np.concatenate(i), np.concatenate(v))

    return run


class Lists:
    """A block's vectors and their components in order, one list a dimension."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.most = int(np.abs(v).max(initial=0))
        self.order = np.argsort(v, axis=0, kind="stable").astype(np.int32)
        self.ranked = np.take_along_axis(v, self.order, 0).astype(float)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(q).max(initial=0)) * max(1, len(q)) <= LONG:
            return self.v[at] @ q
        whole = self.v[at].astype(object) @ q.astype(object)
        return np.array([max(-LONG - 1, min(LONG, int(x))) for x in whole], np.int64)

    def best(self, name: int, q: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(vec ids, scores) of the best k, ties to smaller ids, the query's own id and scores below ``bar`` left out."""
        n, order, ranked = len(self.ids), self.order, self.ranked
        left = np.flatnonzero(self.ids != name)
        if self.most * int(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT:
            up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
            used = np.concatenate([up, down])
            worst = np.concatenate([ranked[0, up] * q[up], ranked[-1, down] * q[down]])
            gain, seen = np.zeros(n), np.zeros((n, len(used)), bool)
            at, step, floor = 0, max(64, n // 16), worst.sum()
            while at < n and len(left) > max(4 * k, n // 32):
                to = min(n, at + step)
                who = np.concatenate([order[n - to : n - at, up][::-1], order[at:to, down]], 1)
                what = np.concatenate([ranked[n - to : n - at, up][::-1] * q[up], ranked[at:to, down] * q[down]], 1)
                gain += np.bincount(who.ravel(), (what - worst).ravel(), n)
                seen[who, np.arange(len(used))] = True
                lower = gain[left]
                least = bar - floor
                if len(lower) > k:
                    least = max(least, np.partition(lower, len(lower) - k)[len(lower) - k])
                left = left[lower + (~seen[left]) @ (what[-1] - worst) >= least]
                at, step = to, 2 * step
        score = self.scores(left, q)
        first = np.lexsort((self.ids[left], -score.astype(float) if self.most < 2**20 else [-int(x) for x in score]))[:k]
        return self.ids[left][first], score[first]


def _search(k: int, held):
    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(dim, np.frombuffer(i, "<i8"), np.frombuffer(v, "<i8").reshape(len(i) // 8, dim)) for dim, i, v in held.value]
        #: By query, the best so far: ids and scores, the k-th last.
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, "<i8")
                lists = Lists(ids, np.frombuffer(v, "<i8").reshape(len(ids), dim))
                for b, (size, names, vectors) in enumerate(queries):
                    if size != dim:
                        continue
                    for j, (name, q) in enumerate(zip(names.tolist(), vectors, strict=True)):
                        have = found.get((b, j))
                        bar = float(have[1][-1]) if have and len(have[1]) == k else -np.inf
                        who, score = lists.best(name, q, k, bar)
                        if have:
                            who, score = np.concatenate([have[0], who]), np.concatenate([have[1], score])
                            first = sorted(range(len(who)), key=lambda i: (-int(score[i]), int(who[i])))[:k]
                            who, score = who[first], score[first]
                        found[b, j] = who, score
        for (b, j), (who, score) in found.items():
            yield pa.record_batch({"query": pa.array([(b << 20) + j] * len(who), pa.int64()), "query_id": pa.array([int(queries[b][1][j])] * len(who), pa.int64()), "vec_id": who, "score": score})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products over ``vectors``, ties to smaller ids.

    Components become floor(scale * x). Vectors (and queries) that are null or hold null or non-finite components, and rows with
    a null id, take no part; a query meets vectors of its own length. Rows that repeat an id are rows of their own, and
    a query never meets rows of its own id. Components beyond 2^62 are held at it, and scores at the ends of 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    schema = "dim int, ids binary, v binary"
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    asked = scratch.table(pick(queries).mapInArrow(_packed(QUERIES, scale), schema).withColumn("qb", F.monotonically_increasing_id()), "queries")
    blocks = scratch.table(pick(vectors).mapInArrow(_packed(BLOCK, scale), schema).withColumn("block", F.monotonically_increasing_id()), "blocks")
    # a small table's blocks are dealt over the cores; more blocks than that stay in the tasks that read them
    parts = min(blocks.count(), 2 * spark.sparkContext.defaultParallelism)
    if blocks.rdd.getNumPartitions() < parts:
        blocks = blocks.repartitionByRange(parts, "block")
    rounds, size = [[]], 0
    for qb, n in asked.select("qb", F.length("ids") + F.length("v")).orderBy("qb").collect():
        if rounds[-1] and size + n > QUERY_BYTES:
            rounds.append([])
            size = 0
        rounds[-1].append(qb)
        size += n
    found = None
    for turn in rounds:
        held = spark.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["v"])) for r in asked.where(F.col("qb").isin(turn)).orderBy("qb").collect()] if turn else [])
        part = scratch.table(blocks.select("dim", "ids", "v").mapInArrow(_search(k, held), "query long, query_id long, vec_id long, score long").withColumn("round", F.lit(len(scratch.made))), "found")
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    # rows that repeat a query's id are queries of their own
    order = Window.partitionBy("round", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
