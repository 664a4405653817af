"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising is a map over whole texts; only documents longer than a sequence are cut. Lengths are integers up to the capacity, so
the number of pieces of each length, a table of as many rows at most, is all that best-fit decreasing needs: one small
task plans the packing of all pieces at once. A segment tree over the remaining capacities finds the tightest open bins in logarithmic
time; bins filled alike are one group of consecutive numbers, and a step puts pieces of one length into such a group. The
plan is a table of these steps, whose size depends on the capacity and not on the pieces. Pieces are ranked within their length (in range
partitions, so that no length meets in one task) and look up their bin and offset by that rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.operators.ranking import ranked
from stereolith.plans.scratch import Scratch

CAPACITY = 4096
END = 1

#: Texts with other characters go through the tokenizer whole.
_RARE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\\|")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_CACHE = 350_000


class Parts(dict):
    """Parts of lower-cased words, as the tokenizer cuts them, to their ids' little-endian bytes."""

    def __init__(self, model):
        self.model = model
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in direct} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(direct))}

    def __missing__(self, part: str) -> bytes:
        coded = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        if len(self) >= _CACHE:
            self.clear()
        self[part] = ids
        return ids


class Ids(dict):
    """Lower-cased words between blanks to their ids' little-endian bytes; ``encode`` does a whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.parts = Parts(self.whole.model)

    def __missing__(self, word: str) -> bytes:
        found = _PART.findall(word)
        ids = self.parts[word] if found == [word] else b"".join(map(self.parts.__getitem__, found))
        if len(self) >= _CACHE:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _RARE.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each text's ids and the end id, cut at ``capacity``.

    A null text counts as empty and gives one piece of the end id alone. Every row gives pieces, repeated and null ids too.
    """

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(tokenizer_path)
        end = np.array([END], "<u4").tobytes()
        for batch in (b.slice(at, e - at) for b in batches for at, e in T.runs(b.column(1))):
            row, piece, length, crc, body = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = ids.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(np.frombuffer(part, "<u4").astype(np.int32))
            piece_no = np.array(piece, np.int32)
            out = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece_no, "start": piece_no.astype(np.int64) * capacity, "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)}
            yield pa.record_batch(out | ({"ids": pa.array(body, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class Rooms:
    """Remaining capacities that open bins have, as a segment tree: a leaf a capacity, a node counts what is below it."""

    def __init__(self, capacity: int):
        self.half = 1 << int(capacity).bit_length()
        self.tree = [0] * (2 * self.half)

    def add(self, room: int, n: int) -> None:
        i = room + self.half
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of ``least`` or more, -1 if there is none."""
        tree, half = self.tree, self.half
        i = least + half
        if tree[i]:
            return least
        while i > 1 and (i & 1 or not tree[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < half:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - half


def plan(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, n, each, bin, offset) of best-fit decreasing over ``counts`` pieces of each length.

    The pieces of a length from number ``first`` on go to the ``n`` bins from ``bin`` on, ``each`` to a bin, behind one another from
    ``offset``. Pieces of one length fill a bin as far as they can before another is opened or chosen, as each finds the bin
    of the last the tightest.
    """
    rooms, groups, steps, bins = Rooms(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(length: int, first: int, at: int, n: int, each: int, room: int) -> None:
        steps.append((length, first, n, each, at, capacity - room))
        left = room - each * length
        if left:
            groups[left].append((at, n))
            rooms.add(left, 1)

    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        done = 0
        while done < count:
            room = rooms.tightest(length)
            if room < 0:
                room, at, n = capacity, bins, -(-(count - done) // (capacity // length))
                bins += n
            else:
                at, n = groups[room].pop()
                rooms.add(room, -1)
            most = room // length
            whole = min(n, (count - done) // most)
            if whole:
                put(length, done, at, whole, most, room)
                done += whole * most
            rest = min(count - done, most) if whole < n else 0
            if rest:
                put(length, done, at + whole, 1, rest, room)
                done += rest
            if n > whole + (rest > 0):  # the others keep their room
                groups[room].append((at + whole + (rest > 0), n - whole - (rest > 0)))
                rooms.add(room, 1)
    return steps


def assign(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_df`` (with ``doc_id, piece, length``; other columns are kept) with ``sequence_id`` and ``offset``.

    The packing is that of best-fit decreasing over all pieces. A row is a piece of its own, repeated rows and null ids too;
    pieces of one length are alike to it. No rows, no sequences.
    """
    spark = pieces_df.sparkSession
    scratch = Scratch(spark, "packing")
    now = scratch.table(pieces_df.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = now.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row a length, of the capacity at most
    steps = np.array(sorted(plan([r["length"] for r in counts], [r["n"] for r in counts], capacity)), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(steps)
    placed = ranked(now, [F.col("uid")], scratch, by="length", rank="_rank")
    names = placed.columns
    kept = [k for k, n in enumerate(names) if n not in ("uid", "_rank", "sequence_id", "offset")]

    @T.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        bounds = np.append(np.flatnonzero(np.diff(table[:, 0], prepend=-1)), len(table))
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                on = length == n
                low, high = bounds[np.searchsorted(table[bounds[:-1], 0], n) :][:2]
                at[on] = low + np.searchsorted(table[low:high, 1], rank[on], "right") - 1
            _, first, _, each, b, offset = table[at].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(b + nth // each), pa.array(offset + nth % each * length)], [*(names[k] for k in kept), "sequence_id", "offset"])

    types = dict(placed.dtypes)
    return placed.mapInArrow(place, ", ".join([*(f"`{names[k]}` {types[names[k]]}" for k in kept), "sequence_id long, offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences themselves, for pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
