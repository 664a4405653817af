"""Ranked lexical search by document FP-trees with branch and bound.

Terms of the items, in blocks of bounded size, are broadcast; a pass over all texts counts them (N, L, df). In a second pass each task
restricts its documents to those terms. For an item, a batch's documents become vectors of its terms, most frequent
term first, sorted so that vectors with a common beginning share a path of a trie. A node knows the largest tf of each term and
the least length factor m below it, which bound the score of every document there. Nodes are visited depth first, the
best roots first; a subtree is skipped when its bound lies under the item's twentieth score so far. Each task returns
its best documents of an item, and these meet in two rounds.

Scores are integers: terms, their counts and m as the contract has them; a bound is the same sum over larger counts and a smaller m, so
nothing that could qualify is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stereolith.llm import text as T
from stereolith.plans.scratch import Scratch

K = 20
#: Bytes of items' texts in a block (a pass over the documents each), of texts in a run, postings of a batch, and cells of a matrix of vectors.
BLOCK, RUN, BATCH, CELLS = 4_000_000, 4_000_000, 4_000_000, 1_000_000
#: Partial lists of an item that meet first.
PARTS = 64


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score, before its weight; it grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def vectors(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, each row's number of terms, and (row, place in ``terms``, tf) of the terms listed (ascending hashes)."""
    for a, b in T.runs(column, RUN):
        w = T.words(column.slice(a, b - a), T.ALNUM)
        on = np.flatnonzero(T.among(w.h, terms))
        key, tf = np.unique(w.row[on] * max(len(terms), 1) + np.searchsorted(terms, w.h[on]), return_counts=True)
        yield a, np.diff(w.first), key // max(len(terms), 1), key % max(len(terms), 1), tf.astype(np.int64)


def _count(terms):
    """(term, n): documents of each term; at -1 documents with terms, at -2 all terms."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(len(terms.value), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in vectors(batch.column(0), terms.value):
                df += np.bincount(term, minlength=len(df))
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": np.concatenate([[-1, -2], at]).astype(np.int64), "n": np.concatenate([[docs, total], df[at]]).astype(np.int64)})

    return run


class Best:
    """The k best (score, id), larger scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        s, d, o = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.known, known])
        at = np.lexsort((d, ~o, -s))[: self.k]
        at = at[s[at] > 0]
        self.score, self.doc, self.known = s[at], d[at], o[at]


class Tree:
    """The trie of vectors ``tf`` (documents by terms, most frequent term first, at least one in each), in preorder.

    Rows are sorted by the terms they have, so a node is a run ``row:until`` of rows that share all terms up to its own; those
    that end there come first. ``end`` is the next node that doesn't lie below.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        has = tf > 0
        order = np.lexsort(np.packbits(has, axis=1).T[::-1])
        self.order, self.tf, self.m, has = order, tf[order], m[order], has[order]
        rows, terms = has.shape
        differs = np.zeros(rows, np.int64)  # the first term at which a row differs from the one before
        if rows > 1:
            other = has[1:] != has[:-1]
            differs[1:] = np.where(other.any(1), other.argmax(1), terms)
        self.row, self.term = np.nonzero(has & (np.arange(terms)[None, :] >= differs[:, None]))
        self.until = np.full(len(self.row), rows)
        for t in range(terms):
            on, cut = np.flatnonzero(self.term == t), np.append(np.flatnonzero(differs <= t), rows)
            self.until[on] = cut[np.searchsorted(cut, self.row[on], "right")]
        self.end = np.searchsorted(self.row, self.until)
        # the rows whose vectors end at a node: up to its first child's, or all of a leaf's
        self.ends = np.where(self.end == np.arange(len(self.row)) + 1, self.until, np.append(self.row, rows)[1:])

    def roots(self) -> np.ndarray:
        out, k = [], 0
        while k < len(self.row):
            out.append(k)
            k = int(self.end[k])
        return np.array(out, np.int64)

    def bounds(self, low: int, top: int, w: np.ndarray, own: bool = False) -> np.ndarray:
        """The highest score that any document below each node (or ending there) can have: by the largest tf of each term and the least m."""
        at = np.stack([self.row[low:top], (self.ends if own else self.until)[low:top]], 1).ravel()
        tf = np.maximum.reduceat(np.vstack([self.tf, np.zeros((1, self.tf.shape[1]), self.tf.dtype)]), at, axis=0)[::2]
        return part(tf, np.minimum.reduceat(np.append(self.m, 0), at)[::2][:, None]) @ w

    def scores(self, rows: slice, w: np.ndarray) -> np.ndarray:
        return part(self.tf[rows], self.m[rows, None]) @ w


def search(tf: np.ndarray, m: np.ndarray, w: np.ndarray, doc: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Adds the best documents of one batch to ``best``; returns how many were scored in full."""
    tree, scored = Tree(tf, m), 0
    roots = tree.roots()
    every = tree.bounds(0, len(tree.row), w)
    high = every[roots]
    for r in np.argsort(-high, kind="stable"):
        if high[r] < best.least:
            break
        k, low, top = int(roots[r]), int(roots[r]), int(tree.end[roots[r]])
        bound, own = every[low:top].tolist(), tree.bounds(low, top, w, own=True).tolist()
        while k < top:
            if bound[k - low] < best.least:
                k = int(tree.end[k])
                continue
            rows = slice(int(tree.row[k]), int(tree.ends[k]))
            if rows.start < rows.stop and own[k - low] >= best.least:
                at = tree.order[rows]
                best.add(tree.scores(rows, w), doc[at], known[at])
                scored += len(at)
            k += 1
    return scored


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def _settle(held: list, terms: int, items: list, best: list[Best]) -> None:
    """Searches a batch of documents for every item."""
    doc, known, m = (np.concatenate([x[j] for x in held]) for j in range(3))
    base = np.cumsum([0] + [len(x[0]) for x in held])
    row = np.concatenate([x[3] + b for x, b in zip(held, base, strict=False)])
    term, tf = np.concatenate([x[4] for x in held]), np.concatenate([x[5] for x in held])
    order = np.argsort(term, kind="stable")
    row, tf = row[order], tf[order]
    first = np.searchsorted(term[order], np.arange(terms + 1))
    for (own, w), found in zip(items, best, strict=True):
        n = first[own + 1] - first[own]
        at = _spread(first[own], n)
        if not len(at):
            continue
        column, counts = np.repeat(np.arange(len(own)), n), tf[at]
        rows, place = np.unique(row[at], return_inverse=True)
        step = max(1, CELLS // len(own))
        for a in range(0, len(rows), step):
            on = np.flatnonzero((place >= a) & (place < a + step))
            matrix = np.zeros((min(step, len(rows) - a), len(own)), np.int64)
            matrix[place[on] - a, column[on]] = counts[on]
            r = rows[a : a + step]
            search(matrix, m[r], w, doc[r], known[r], found)


def _top(shared, k: int):
    """(item, doc_id, score): a task's best documents of each item."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, docs, total = shared.value
        best = [Best(k) for _ in items]
        held, size = [], 0
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy().astype(np.int64), np.asarray(batch.column(0).is_valid())
            for a, n, row, term, tf in vectors(batch.column(1), terms):
                m = 75 + (25 * n.astype(np.int64) * docs) // total
                held.append((ids[a : a + len(n)], known[a : a + len(n)], m, row, term, tf))
                size += len(row)
                if size >= BATCH:
                    _settle(held, len(terms), items, best)
                    held, size = [], 0
        if held:
            _settle(held, len(terms), items, best)
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.record_batch({"item": np.full(len(b.score), i, np.int64), "doc_id": pa.array(b.doc, mask=~b.known), "score": b.score})

    return run


def top_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents of a score above 0, equal scores by ascending id (null last).

    Rows of ``items`` that repeat both id and text are one item. Null and empty texts have no terms: such documents are never found
    and not counted, such items find nothing. Rows that repeat a document's id are documents of their own. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    at = f"{scratch.root}/top"
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        w = T.words(mine["text"].combine_chunks(), T.ALNUM)
        terms = spark.sparkContext.broadcast(np.unique(w.h))
        counts = dict(docs.select("text").mapInArrow(_count(terms), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term of the block
        found, total = counts.get(-1, 0), max(counts.get(-2, 0), 1)
        plans = []
        for i in range(len(w.first) - 1):
            own, times = np.unique(np.searchsorted(terms.value, w.h[w.first[i] : w.first[i + 1]]), return_counts=True)
            df = np.array([counts.get(t, 0) for t in own.tolist()], np.int64)
            order = np.lexsort((own, -df))[: int((df > 0).sum())]
            plans.append((own[order], np.array([weight(found, d) for d in df[order].tolist()], np.int64) * times[order]))
        shared = spark.sparkContext.broadcast((terms.value, plans, found, total))
        best = docs.mapInArrow(_top(shared, k), "item long, doc_id long, score long")
        for parts in (PARTS, 1):
            own = W.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            best = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(mine["item_id"].to_pylist())), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(at)  # names: a block's items
        for b in (shared, terms):
            b.unpersist()
    return spark.read.parquet(at)
