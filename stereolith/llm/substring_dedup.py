"""Removal of passages that repeat, by super-k-mers: runs of windows that share a minimiser.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash among its ``GRAM``-word grams, so
equal windows have equal minimisers, wherever they stand. The job:

1. **Places.** Each document gives one small row per super-k-mer (consecutive windows of one minimiser, which stands in one place): the minimiser and
   the place, no text.
2. **Once is never twice.** Minimisers counted once drop out: their windows can't repeat. The rest go back to their documents.
3. **Strings.** The windows that are left are cut into super-k-mers again, by an order in which grams that stand in many
   texts come last; so the windows at the edges of a frequent passage go by their own surroundings and
   not all to one bucket. Each super-k-mer travels as one packed string to the bucket of its minimiser. Strings that a
   run of texts holds several times are settled there, and one of them travels.
4. **Buckets.** A bucket sorts its windows and counts them exactly (hashes are sorted, equal ones compared word by word);
   windows that stand in several places are returned as bits of their super-k-mer.
5. **Removal.** Bits meet their document, whose words under such a window go.

Documents are keyed by id and a hash of their text. Steps 3 and 5 join them by the same key, so their texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import Scratch

WINDOW = 35
GRAM = 6
#: Windows of a super-k-mer at most (bits of a mark).
MOST = 32
#: Times that a gram stands in one run of texts from which it is counted, its total from which it comes last in the order of step 3,
#: and how many of these are broadcast (8 bytes each) at most. Any values give the same result.
LOCAL, COMMON, FREQUENT = 4, 64, 1_000_000
#: Bytes of text of a run, and of strings whose windows a bucket sorts at a time.
RUN, BLOCK = 4_000_000, 6_000_000

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAST = np.uint64(1 << 63)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    if not len(first):
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, T.U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, T.U), np.cumsum(values * _powers(len(values), _B), dtype=T.U)])
        self.back = _powers(len(values) + 1, _BINV)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(T.U) * _B)


def _grams(w: T.Words, late: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all grams and each row's first; those in ``late`` (ascending) have the top bit, so that they come last."""
    g, first = T.grams(w.h, w.first, min(GRAM, window))
    g >>= T.U(1)
    if len(late):
        g |= T.among(g, late).astype(T.U) << T.U(63)
    return g, first


def _minimisers(w: T.Words, g: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, minimiser, whether its first gram is the minimiser) of every window."""
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    at, wide, many = g, 1, window - min(GRAM, window) + 1
    while wide < many:  # at[i]: the least of wide grams from i on
        step = min(wide, many - wide)
        at = np.minimum(at, np.concatenate([at[step:], at[-1:].repeat(min(step, len(at)))]))
        wide += step
    row = np.repeat(np.arange(len(count)), count)
    own = _spread(first[:-1], count)
    return row, _spread(np.zeros(len(count), np.int64), count), at[own] & ~_LAST, g[own] == at[own]


def _cut(row: np.ndarray, place: np.ndarray, low: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mers (first, number) of windows, in order: consecutive ones whose minimiser stands in the same place, MOST at most.

    No two of them are equal, as equal windows have their (first) minimiser at equal distances.
    """
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (place[1:] != place[:-1] + 1) | leaves[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(row)))
    parts = -(-length // MOST)
    first = np.repeat(begin, parts) + MOST * _spread(np.zeros(len(begin), np.int64), parts)
    return first, np.diff(np.append(first, len(row)))


def _times(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[cut], np.diff(np.append(cut, len(values)))


def _counts(window: int):
    """(frequent, hash, count) of a run: its minimisers (one a super-k-mer), and grams that stand in it LOCAL times or more."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.runs(batch.column(0), RUN):
                w = T.words(batch.column(0).slice(a, b - a), T.WS, lower=False)
                g, at = _grams(w, np.zeros(0, T.U), window)
                found = _minimisers(w, g, at, window)
                h, n = _times(found[2][_cut(*found)[0]])
                many, m = _times(g)
                often = m >= LOCAL
                yield pa.record_batch({"frequent": np.repeat([False, True], [len(h), often.sum()]), "minimiser": np.concatenate([h, many[often]]).view(np.int64), "n": np.concatenate([n, m[often]])})

    return run


def _places(window: int):
    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0), batch.column(1)
            for a, b in T.runs(batch.column(2), RUN):
                w = T.words(batch.column(2).slice(a, b - a), T.WS, lower=False)
                row, place, low, leaves = _minimisers(w, *_grams(w, np.zeros(0, T.U), window), window)
                first, n = _cut(row, place, low, leaves)
                at = pa.array(a + row[first])
                yield pa.record_batch({"minimiser": low[first].view(np.int64), "doc": doc.take(at), "key": key.take(at), "start": place[first].astype(np.int32), "n": n.astype(np.int32)})

    return run


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """buf[start:end] as binary rows."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(buf[_spread(start, size)])])


def _strings(late, window: int):
    """Packed super-k-mers of the windows listed: (minimiser, string, doc, key, start, mask). A string without a place stands
    for two or more of a run, whose places come as rows without a string and the bits of all their windows."""

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, lists = batch.column(0), batch.column(1), batch.column(3)
            for a, b in T.runs(batch.column(2), RUN):
                column = batch.column(2).slice(a, b - a)
                w = T.words(column, T.WS, lower=False)
                row, place, low, leaves = _minimisers(w, *_grams(w, late.value, window), window)
                own = lists.slice(a, b - a)
                off, spans = own.offsets.to_numpy().astype(np.int64), own.flatten()
                begin, n = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                of = np.repeat(np.arange(b - a), np.diff(off))
                base = np.concatenate([[0], np.cumsum(np.maximum(np.diff(w.first) - window + 1, 0))])
                keep = np.zeros(len(row), bool)
                keep[_spread(base[of] + begin, n)] = True
                row, place, low = row[keep], place[keep], low[keep]
                first, n = _cut(row, place, low, leaves[keep])
                s = w.first[row[first]] + place[first]
                e = s + n + window - 1
                if not len(first):
                    continue
                h = Rolling(w.h).of(s, e)
                order = np.argsort(h, kind="stable")
                same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
                several = same.copy()
                several[:-1] |= same[1:]
                alone, twice = np.ones(len(h), bool), order[several]
                alone[twice] = False
                sent = np.sort(np.concatenate([np.flatnonzero(alone), order[several & ~same]]))
                plain, _ = T.text_bytes(column, lower=False)
                plain[:-8][~T.WS[plain[:-8]]] = 32
                at = pa.array(a + row[first[sent]])
                mine = ~alone[sent]
                count, start = n.astype(np.int64), place[first].astype(np.int32)
                yield pa.record_batch(
                    {
                        "minimiser": low[first[sent]].view(np.int64),
                        "string": _slices(plain, w.start[s[sent]], w.start[e[sent] - 1] + w.length[e[sent] - 1]),
                        "doc": pa.array(doc.take(at).to_numpy(zero_copy_only=False), mask=mine, type=pa.int64()),
                        "key": pa.array(key.take(at).to_numpy(), mask=mine, type=pa.int64()),
                        "start": start[sent],
                        "mask": np.zeros(len(sent), np.int64),
                    }
                )
                at = pa.array(a + row[first[twice]])
                # settled places are dealt by their document, as any bucket passes them on
                yield pa.record_batch({"minimiser": key.take(at), "string": pa.nulls(len(twice), pa.binary()), "doc": doc.take(at), "key": key.take(at), "start": start[twice], "mask": (np.int64(1) << count[twice]) - 1})

    return run


def repeats(ids: np.ndarray, start: np.ndarray, window: int, value: np.ndarray | None = None) -> np.ndarray:
    """For windows of ``window`` values of ``ids`` from each start on: the number of the first equal one in sorted order (equal windows
    get equal numbers). Hashes are sorted, neighbours of one hash compared value by value."""
    h = Rolling(T.mix(ids.astype(T.U) + T.U(1))).of(start, start + window) if value is None else value
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]]) if len(order) else np.zeros(0, bool)
    at, wrong = np.flatnonzero(same), False
    for k in range(0, len(at), 100_000):
        x, y = start[order[at[k : k + 100_000]]], start[order[at[k : k + 100_000] - 1]]
        for j in range(window):
            wrong = wrong or bool((ids[x + j] != ids[y + j]).any())
    group = np.empty(len(order), np.int64)
    if wrong:  # two windows of one hash: sorted by their values
        group[:] = np.unique(ids[start[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
    else:
        group[order] = np.cumsum(~same) - 1
    return group


def _count(minimiser: np.ndarray, strings: pa.Array, lone: np.ndarray, window: int) -> np.ndarray:
    """Bits of each string's windows that stand elsewhere too; strings that aren't ``lone`` stand twice or more themselves."""
    off = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    text = pa.StringArray.from_buffers(len(strings), pa.py_buffer((off - off[0]).astype(np.int32)), pa.py_buffer(np.frombuffer(strings.buffers()[2], np.uint8)[off[0] : off[-1]]))
    w = T.words(text, T.WS, lower=False)
    # exact names of words: the first of its hash, if the bytes are the same
    order = np.argsort(w.h, kind="stable")
    new = np.concatenate([[True], w.h[order][1:] != w.h[order][:-1]])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    lead = order[new][ids]
    if not _same_bytes(w, lead):
        raw = w.buf.tobytes()
        ids[:] = np.unique(np.array([raw[s : s + n] for s, n in zip(w.start.tolist(), w.length.tolist(), strict=True)], object), return_inverse=True)[1]
    n = np.diff(w.first) - window + 1
    start = _spread(w.first[:-1], n)
    of = np.repeat(np.arange(len(n)), n)
    group = repeats(ids, start, window)
    size = np.bincount(group, minlength=1)
    size += np.bincount(group, weights=~lone[of], minlength=len(size)).astype(np.int64)
    bit = np.where(size[group] > 1, np.int64(1) << (start - w.first[of]), 0)
    return np.add.reduceat(bit, w.first[:-1] - (window - 1) * np.arange(len(n))) if len(n) else np.zeros(0, np.int64)


def _same_bytes(w: T.Words, lead: np.ndarray) -> bool:
    """Whether each word has the bytes of word ``lead``, eight at a time."""
    if (w.length != w.length[lead]).any():
        return False
    at8 = np.ndarray(shape=(len(w.buf) - 7,), dtype="<u8", buffer=w.buf, strides=(1,))
    todo, k = np.flatnonzero(lead != np.arange(len(lead))), 0
    while len(todo):
        rest = T._MASK[np.minimum(w.length[todo] - k, 8)]
        if ((at8[w.start[todo] + k] ^ at8[w.start[lead[todo]] + k]) & rest).any():
            return False
        k += 8
        todo = todo[w.length[todo] > k]
    return True


def _buckets(window: int):
    """Rows sorted by minimiser, whole minimisers at a time: (doc, key, start, mask) of places with windows that repeat."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks()
        at = np.flatnonzero(np.asarray(batch.column("string").is_valid()))
        mask = batch.column("mask").to_numpy().copy()
        lone = np.asarray(batch.column("key").is_valid())
        if len(at):
            strings = batch.column("string").take(pa.array(at)).combine_chunks()
            strings = strings.chunk(0) if isinstance(strings, pa.ChunkedArray) else strings
            mask[at] = _count(batch.column("minimiser").to_numpy()[at], strings, lone[at], window)
        keep = pa.array(lone & (mask != 0))
        out = batch.select(["doc", "key", "start"]).append_column("mask", pa.array(mask)).filter(keep).combine_chunks()
        return out.to_batches()[0] if out.num_rows else None

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, BLOCK
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("minimiser").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole and (out := settle(table.slice(0, whole))):
                yield out
            held = table.slice(whole).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
            most = max(BLOCK, 2 * size)
        if held and (out := settle(pa.Table.from_batches(held))):
            yield out

    return run


def _kept(window: int):
    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.runs(batch.column(1), RUN):
                column = batch.column(1).slice(a, b - a)
                w = T.words(column, T.WS, lower=False)
                marks = batch.column(2).slice(a, b - a)
                count = np.diff(w.first)
                gone = np.zeros(len(w.h) + 1, np.int64)
                size = np.where(np.asarray(marks.is_valid()), np.diff(marks.offsets.to_numpy()), 0)
                if size.sum():
                    spans = marks.flatten()
                    start, mask = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    base = w.first[:-1][np.repeat(np.arange(b - a), size)] + start
                    for bit in range(MOST):
                        on = base[(mask >> bit) & 1 > 0] + bit
                        np.add.at(gone, on, 1)
                        np.add.at(gone, on + window, -1)
                keep = np.cumsum(gone[:-1]) == 0
                row = w.row
                # the kept words' bytes, and behind each but a row's last the white space there as one blank
                at = np.flatnonzero(keep)
                last = np.ones(len(at), bool)
                last[:-1] = row[at][1:] != row[at][:-1]
                edge = np.zeros(len(w.buf) + 1, np.int8)
                edge[w.start[at]] += 1
                edge[w.start[at] + w.length[at]] -= 1
                mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
                gap = w.start[at[~last]] + w.length[at[~last]]
                mask[gap] = True
                w.buf[gap] = 32
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], weights=w.length[at] + ~last, minlength=b - a))]).astype(np.int64)
                kept = memoryview(w.buf[mask])
                removed = count - np.bincount(row[at], minlength=b - a)
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "n_words": count.astype(np.int64), "n_removed": removed.astype(np.int64), "kept_sha256": [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)], **_text(kept, ends)})

    return run


def _text(kept: memoryview, ends: np.ndarray) -> dict:
    return {"kept": pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept))}


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256, kept`` (the words that stay, joined by one blank).

    A word goes if it stands in a window whose word sequence starts in another place too, in the same text or
    another; rows that repeat an id or a text are texts of their own. Null and empty texts have no words and keep the empty
    string; texts shorter than a window keep all words. Rows with a null id are treated like others. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    places = docs.mapInArrow(_places(window), "minimiser long, doc long, key long, start int, n int")
    counts = docs.select("text").mapInArrow(_counts(window), "frequent boolean, minimiser long, n long").groupBy("frequent", "minimiser").agg(F.sum("n").alias("n"))
    counts = scratch.table(counts.where(F.when(F.col("frequent"), F.col("n") >= COMMON).otherwise(F.col("n") > 1)), "minimisers")
    often = counts.where("frequent").orderBy(F.desc("n"), "minimiser").limit(FREQUENT).select("minimiser").toArrow()["minimiser"]
    late = spark.sparkContext.broadcast(np.sort(often.to_numpy().astype(np.int64).view(np.uint64)))
    listed = places.join(counts.where("not frequent").select("minimiser"), "minimiser").groupBy("key", "doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    listed = scratch.table(listed, "listed")
    both = lambda x: (docs["key"] == x["key"]) & docs["doc"].eqNullSafe(x["doc"])
    texts = docs.join(listed, both(listed)).select(docs["doc"], docs["key"], docs["text"], "spans")
    strings = texts.mapInArrow(_strings(late, window), "minimiser long, string binary, doc long, key long, start int, mask long")
    marks = strings.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_buckets(window), "doc long, key long, start int, mask long")
    marks = marks.groupBy("key", "doc").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    found = docs.join(marks, both(marks), "left").select(docs["doc"].alias("doc_id"), docs["text"], "marks")
    return found.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
