"""Stupid-backoff scores of whole documents under the corpus's own n-gram counts.

Rows are dealt over blocks of about ``BLOCK_BYTES``, repeated rows too. Each block explodes its texts into n-grams and, as the combine step of
a shuffle, sends each distinct n-gram once, with its count in the block, to the partition of the count table that its hash
falls in. There counts are summed over all blocks, and the total of each n-gram that other blocks hold too is joined
back to the blocks that asked, as bits over the n-grams they sent, whose order both sides know. A block then scores its positions
and sums them per document.

The table is filled order by order (1 and 2 together): from 3 on, an n-gram is sent only if both (n-1)-grams in it are counted
twice or more. Where one is counted once, the n-gram stands at that very place alone: its count is 1, known without asking.

S(w | context) = c(context w) / c(context) if the n-gram is counted ``MIN_COUNT`` times or more (once: the classic rule), else
``BACKOFF`` * S(w | shorter context); at the end of the chain c(w) / N.

Rows between stages are runs of texts, compressed, and of hashes as binary columns, so a shuffled n-gram costs a few bytes rather than a row, and a frequent
n-gram is one entry a block, not one a place. There are as many rows as (block, part) pairs with an n-gram, thus never more than rows of single
n-grams would be.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import small_batches

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 1
#: Bytes of text a block holds about, and n-grams a part of the count table.
BLOCK_BYTES = 10_000_000
PART_GRAMS = 1_500_000


def _grams(column: pa.Array, order: int) -> tuple[T.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of the rows, and for each n the n-grams that start at a word (hash, place), none across rows."""
    w = T.words(column, T.ALNUM)
    out = []
    row = w.row
    for n in range(1, order + 1):
        g, _ = T.grams(w.h, w.first, n)
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        out.append((g, at))
    return w, out


def pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences: six bytes each if all fit, else eight; their top bytes by a Huffman code where that is shorter."""
    d = np.diff(keys, prepend=np.uint64(0))
    size = 6 if not len(d) or int(d.max()) < 1 << 48 else 8
    flat = d.astype("<u8").view(np.uint8).reshape(-1, 8)
    top, low = flat[:, size - 1].tobytes(), flat[:, : size - 1].tobytes()
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    short = coder.compress(top) + coder.flush()
    coded = len(short) < len(top)
    return bytes([size, coded]) + len(low).to_bytes(4, "little") + low + (short if coded else top)


def unpack(data: bytes) -> np.ndarray:
    size, coded, end = data[0], data[1], 6 + int.from_bytes(data[2:6], "little")
    low = np.frombuffer(data[6:end], np.uint8).reshape(-1, size - 1)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : size - 1] = low
    wide[:, size - 1] = np.frombuffer(zlib.decompress(data[end:], -15) if coded else data[end:], np.uint8)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts by byte planes: the low bytes, then the mostly empty high ones, which shuffle compression takes away."""
    return n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


@T.tidy
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"n": pa.array([sum(len(T.words(batch.column(0).slice(a, b - a), T.ALNUM).h) for a, b in T.runs(batch.column(0)))], pa.int64())})


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ascending keys, and how often each stands there."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _spans(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of ascending keys, by equal ranges of the hash."""
    cut = np.searchsorted(keys, np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64))
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip([0, *cut], [*cut, len(keys)], strict=True))]


def _deal(blocks: int):
    """(block, docs): rows dealt by their content, their task and which of its equal rows they are, so that a task that runs again with its
    rows in another order deals alike, and equal rows spread; those of a batch for one block as compressed Arrow."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = np.uint64(TaskContext.get().partitionId() + 1), Counter()
        for batch in batches:
            buf, off = T.text_bytes(batch.column(1), lower=False)
            own = T.hashes(buf, off[:-1], np.diff(off)) ^ T.mix(batch.column(0).fill_null(-1).to_numpy().astype(np.int64).view(np.uint64))
            nth = np.zeros(len(own), np.uint64)
            for i, h in enumerate(own.tolist()):
                nth[i] = seen[h]
                seen[h] += 1
            block = (T.mix(own ^ T.mix(nth * np.uint64(0x9E3779B97F4A7C15) + task)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            batch, out = batch.take(pa.array(order)), []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                # a copy of the rows alone, without what the slice is cut from
                part = pa.table(batch.slice(a, b - a)).take(pa.array(np.arange(b - a)))
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_table(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.record_batch({"block": names, "docs": pa.array(out, pa.binary())})

    return run


def _rows(dealt: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for chunk in dealt.column("docs").chunks for x in chunk])


def _runs(docs: pa.Table) -> list[pa.Array]:
    return [batch.slice(a, b - a) for batch in docs.column("text").chunks for a, b in T.runs(batch)]


class Block:
    """A block's n-grams and how often each is counted, as far as totals are known."""

    def __init__(self, docs: pa.Table, order: int, min_count: int, parts: int):
        self.min_count, self.parts = min_count, parts
        found = [_grams(x, order) for x in _runs(docs)]
        self.words, self.grams = [w for w, _ in found], [g for _, g in found]
        #: By run and order, the count of the n-gram that starts at each word; 0 where none starts or it is under ``min_count``.
        self.count = [[] for _ in found]

    def level(self, orders: list[int], replies: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of these orders whose count isn't known yet, ascending, and their counts; with ``replies``, in the whole corpus."""
        used, alone = [], []
        for k, grams in enumerate(self.grams):
            for n in orders:
                g, at = grams[n - 1]
                once = np.zeros(0, np.int64)
                if n > 2:
                    below = np.minimum(self.count[k][n - 2][at], self.count[k][n - 2][at + 1])
                    on, once = below >= max(self.min_count, 2), at[below == 1]
                    g, at = g[on], at[on]
                used.append((k, g, at))
                alone.append(once)
        found = np.concatenate([np.zeros(0, np.uint64), *(g for _, g, _ in used)])
        if replies is None:
            return _counted(np.sort(found))
        # counts go back to the places by the order that brought equal n-grams together: searching each place's takes five times as long
        order = np.argsort(found)
        keys, times = _counted(found[order])
        counts, spans = times.copy(), _spans(keys, self.parts)
        for p, more, totals in zip(*(replies.column(c).to_pylist() for c in ("part", "more", "totals")), strict=True):
            _, a, b = spans[p]
            counts[a:b][np.unpackbits(np.frombuffer(more, np.uint8))[: b - a].astype(bool)] = unpack_counts(totals)
        placed, begin = np.empty(len(found), np.int64), 0
        placed[order] = np.repeat(counts, times)
        for (k, g, at), once in zip(used, alone, strict=True):
            own = np.zeros(len(self.words[k].h), np.int64)
            own[once] = 1
            own[at] = placed[begin : begin + len(g)]
            begin += len(g)
            self.count[k].append(own)
        return keys, counts


def _levels(order: int) -> list[list[int]]:
    return [[1, 2][:order], *([n] for n in range(3, order + 1))]


def _ask(order: int, level: int, min_count: int, parts: int):
    """(block, level, part, keys, counts): a block's distinct n-grams of a level by part of the hash range. Orders share one key space."""

    def run(key: tuple, docs: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        levels = _levels(order)
        block = Block(_rows(docs), levels[level][-1], min_count, parts)
        for k in range(level):
            block.level(levels[k], replies.filter(pa.compute.equal(replies.column("level"), k)))
        keys, counts = block.level(levels[level], None)
        name = docs.column("block")[0].as_py()
        del block
        spans = [(p, a, b) for p, a, b in _spans(keys, parts) if b > a]
        out = pa.table(
            {
                "block": pa.array([name] * len(spans), pa.int64()),
                "level": pa.array([level] * len(spans), pa.int32()),
                "part": pa.array([p for p, _, _ in spans], pa.int64()),
                "keys": pa.array([pack(keys[a:b]) for _, a, b in spans], pa.binary()),
                "counts": pa.array([pack_counts(counts[a:b]) for _, a, b in spans], pa.binary()),
            }
        )
        T.give_back()
        return out

    if level:
        return lambda key, docs, replies: run(key, docs, replies)
    return lambda key, docs: run(key, docs)


def _sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(block, level, part, more, totals): which of the keys that a block sent have a total above its own count, as bits, and those totals."""
    keys = [unpack(x) for x in rows["keys"]]
    counts = [unpack_counts(x) for x in rows["counts"]]
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    out, begin = [], 0
    for block, level, k, c in zip(rows["block"], rows["level"], keys, counts, strict=True):
        t = total[at[begin : begin + len(k)]]
        begin += len(k)
        more = t > c
        if more.any():
            out.append((block, level, key[0], np.packbits(more).tobytes(), pack_counts(t[more])))
    return pd.DataFrame(out, columns=["block", "level", "part", "more", "totals"])


def _score(order: int, backoff: float, min_count: int, tokens: int, parts: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _rows(docs)
        block = Block(docs, order, min_count, parts)
        for k, orders in enumerate(_levels(order)):
            block.level(orders, replies.filter(pa.compute.equal(replies.column("level"), k)))
        n_words, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w, grams, count in zip(block.words, block.grams, block.count, strict=True):
            s = np.log(np.maximum(count[0], 1) / max(tokens, 1))
            for n in range(2, order + 1):
                # places of n-grams, by their first word; the score belongs to their last
                at = grams[n - 1][1]
                own, context, last = count[n - 1][at], count[n - 2][at], at + n - 1
                s[last] = np.where(own >= min_count, np.log(np.maximum(own, 1) / np.maximum(context, 1)), np.log(backoff) + s[last])
            rows = len(w.first) - 1
            score.append(np.bincount(w.row, s, rows) if len(s) else np.zeros(rows))
            n_words.append(np.diff(w.first))
        del block
        T.give_back()
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": np.concatenate(n_words), "score": np.concatenate(score)})

    return run


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, n_words, score``: the sum of log S over a document's words (digits, letters a-z and non-ASCII, lower-cased).

    Texts that are null or hold no word have 0 words and score 0. Repeated rows count as often as they stand, null ids too. Texts
    are read whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    parts = max(1, -(-(size[0] or 0) * 2 // (5 * PART_GRAMS)))
    tokens = docs.select("text").mapInArrow(_words, "n long").agg(F.sum("n")).first()[0] or 0
    dealt = docs.mapInArrow(_deal(blocks), "block long, docs binary")
    asks, replies = "block long, level int, part long, keys binary, counts binary", None
    for level in range(len(_levels(order))):
        ask = _ask(order, level, min_count, parts)
        asked = dealt.groupBy("block").applyInArrow(ask, asks) if replies is None else dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask, asks)
        told = asked.groupBy("part").applyInPandas(_sum, "block long, level int, part long, more binary, totals binary")
        replies = told if replies is None else replies.unionByName(told)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(order, backoff, min_count, tokens, parts), "doc_id long, n_words long, score double")
