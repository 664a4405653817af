"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Short items inside long documents share too small a part of the union for one signature per document. So the items are
partitioned by size (classes of at most 2^c distinct 5-word shingles), and for each class every document is cut into
overlapping segments of 2 * 2^c shingle places, 2^c apart: a passage of the class lies whole in one segment, where it
makes up a fixed share of the union. Segments and items get one-permutation MinHash signatures (the least hash in each of
``4 * 2^c`` bins); one equal bin makes a candidate. Items of up to 16 shingles (the lowest class) are signed by every shingle, and so
are the documents for them: there nothing is missed. A larger item that a segment contains to 80 % stays unseen only if each
of its shared shingles, 14 or more, is undercut in its bin on one side; with 2 bins or more per value of a segment that is below
0.45^14, 1e-5, at 17 shingles and 1e-8 at 30.

Documents emit only hashes that are marked in a bit table of fixed size (2^26 bits, 8 MB, whatever the number of items). The rows
meet the items' signatures in a join; what it gives are candidate pairs, and only documents of such pairs are read
again and compared by the share of the item's distinct shingles that the whole document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import Scratch

SHINGLE = 5
PERCENT = 80
#: Bytes of text that are shingled at a time, at most: the arrays of a run take some twenty times as much.
RUN = 1_000_000
#: Size classes by their exponent; items of the first are signed by all their shingles.
CLASSES = range(4, 13)


def item_class(size: np.ndarray) -> np.ndarray:
    """The least c of ``CLASSES`` with size <= 2^c (the last takes all larger ones)."""
    c = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    return np.clip(c, CLASSES[0], CLASSES[-1])


def _least(group: np.ndarray, h: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each bin of each group; of the lowest class, all hashes."""
    if c == CLASSES[0]:
        return group, h
    b = (h >> np.uint64(64 - (c + 2))).astype(np.int64)
    order = np.lexsort((h, b, group))
    group, h, b = group[order], h[order], b[order]
    new = np.ones(len(h), bool)
    new[1:] = (group[1:] != group[:-1]) | (b[1:] != b[:-1])
    return group[new], h[new]


@T.tidy
def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, class, shingle, signs): an item's distinct shingles, and whether each is of its signature."""
    for batch in batches:
        w = T.words(batch.column(1), T.ALNUM)
        t, first = T.sets(*T.grams(w.h, w.first, SHINGLE, short=True))
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        c = item_class(size)
        signs = np.zeros(len(t), bool)
        for k in np.unique(c[size > 0]):
            on = np.flatnonzero(c[row] == k)
            group, low = _least(row[on], t[on], int(k))
            kept = set(zip(group.tolist(), low.tolist(), strict=True))
            signs[on] = [(g, x) in kept for g, x in zip(row[on].tolist(), t[on].tolist(), strict=True)]
        yield pa.record_batch({"item_id": batch.column(0).take(pa.array(row)), "class": c[row], "shingle": t.view(np.int64), "signs": signs})


def _marks(hashes: DataFrame) -> np.ndarray:
    """A table of 2^26 bits, one set for the top bits of each hash: at most 2^20 words come to the driver."""
    word, bit = F.shiftrightunsigned("h", 44), F.shiftrightunsigned("h", 38).bitwiseAND(F.lit(63))
    found = hashes.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << 20, np.uint64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _marked(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return (marks[h >> np.uint64(44)] >> (h >> np.uint64(38) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _shingles(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shingles in order, row, place, marked) of runs of documents that hold a marked shingle."""
    for batch in (b.slice(at, end - at) for b in batches for at, end in T.runs(b.column(1), RUN)):
        w = T.words(batch.column(1), T.ALNUM)
        g, first = T.grams(w.h, w.first, SHINGLE, short=True)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        hit = _marked(g, marks)
        if hit.any():
            yield batch.column(0), g, row, np.arange(len(g)) - first[row], hit


def _signatures(held, classes: list[int]):
    """(doc_id, class, key) rows: marked hashes of the signatures of documents' segments."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, row, place, hit in _shingles(batches, held.value):
            rows, kinds, keys = [], [], []
            for c in classes:
                if c == CLASSES[0]:
                    r, low = row[hit], g[hit]
                else:
                    # a place is in its own segment and in the one that began before it; only segments with a marked hash count
                    wide = int(place.max() >> c) + 2
                    own = row * wide + (place >> c) + 1
                    wanted = np.zeros((int(row[-1]) + 1) * wide + 1, bool)
                    wanted[own[hit]] = wanted[own[hit] - 1] = True
                    wanted[:: wide] = False
                    a, b = wanted[own], wanted[own - 1]
                    group, low = _least(np.concatenate([own[a], own[b] - 1]), np.concatenate([g[a], g[b]]), c)
                    keep = _marked(low, held.value)
                    r, low = group[keep] // wide, low[keep]
                rows.append(r)
                kinds.append(np.full(len(low), c))
                keys.append(low)
            found = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(kinds), np.concatenate(keys)], names="r,c,k"))
            yield pa.record_batch({"doc_id": ids.take(pa.array(found["r"])), "class": found["c"], "key": found["k"].view(np.int64)})

    return run


def _held(held):
    """(doc_id, shingle) rows: documents' marked shingles."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, row, _, hit in _shingles(batches, held.value):
            found = np.unique(np.rec.fromarrays([row[hit], g[hit]], names="r,k"))
            yield pa.record_batch({"doc_id": ids.take(pa.array(found["r"])), "shingle": found["k"].view(np.int64)})

    return run


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, item_id``: documents with a segment whose signature agrees in a bin with that of an item."""
    signs = index.where("signs").select("class", F.col("shingle").alias("key"), "item_id")
    classes = sorted(r[0] for r in index.select("class").distinct().collect())
    marks = docs.sparkSession.sparkContext.broadcast(_marks(signs.select(F.col("key").alias("h"))))
    return docs.mapInArrow(_signatures(marks, classes), "doc_id long, class long, key long").join(signs, ["class", "key"]).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` for each document that holds 80 % or more of an item's shingles.

    Words are runs of digits, letters a-z and non-ASCII bytes of the A-Z-lower-cased text; an item of fewer than five
    words is one shingle, met only by an equally short document. Rows with a null id, and null or empty texts, give
    nothing; a repeated id counts as one document whose texts are taken together, a repeated item likewise. Texts are read
    whole, however long; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    index = scratch.table(items.mapInArrow(_items, "item_id long, class long, shingle long, signs boolean").distinct(), "items")
    whole = index.select("item_id", "shingle").distinct()
    size = whole.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    pairs = scratch.table(candidates(docs, index), "candidates")
    # what the candidates' documents would have to hold, and what they hold
    need = pairs.join(whole, "item_id")
    marks = docs.sparkSession.sparkContext.broadcast(_marks(whole.select(F.col("shingle").alias("h"))))
    # written, so that Spark knows its size: where it is small, texts don't move
    among = scratch.table(pairs.select("doc_id").distinct(), "among")
    holds = docs.join(among, "doc_id", "left_semi").mapInArrow(_held(marks), "doc_id long, shingle long")
    met = need.join(holds, ["doc_id", "shingle"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    out = met.join(size, "item_id").where(100 * F.col("shared") >= PERCENT * F.col("item_shingles"))
    return out.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id stay. The ids that go are written first: where they are few, texts don't move."""
    bad = Scratch(docs.sparkSession, "contaminated").table(contaminated(docs, items).select("doc_id").distinct(), "ids")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
