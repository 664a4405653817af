"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words (runs of letters of the A-Z-lower-cased text), pairs and triples of words in a row, and pairs
with one or two words between, each hashed into one of ``2 ** BITS`` coordinates. Per-coordinate learning rates let rare features
move as fast as frequent ones, and the L1 term leaves most weights at zero. What is broadcast is the list of coordinates
with a weight, which the number of coordinates bounds.

Training reads at most ``TRAIN_ROWS`` labelled rows and about ``TRAIN_BYTES`` of their texts, chosen by a hash of the id. Their
features are made by many tasks; one task runs FTRL over that bounded sample, all features, in hash order. Everything
else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import RUN_BYTES, Scratch, small_batches

TRAIN_ROWS, TRAIN_BYTES = 24_000, 32_000_000
BITS = 22
EPOCHS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.1
#: Bytes of text at a time: five features a word, eight bytes each, several copies while they are sorted.
RUN = 300_000
_KIND = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x5BE0CD19137E2179)]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of a run of rows, repeats included."""
    w = T.words(column, T.ALPHA)
    row = w.row
    out, rows = [T.mix(w.h ^ _KIND[0])], [row]
    for gap in (1, 2, 3):
        on = np.flatnonzero(row[gap:] == row[:-gap])
        pair = w.h[on] * np.uint64(0x9E3779B97F4A7C15) + w.h[on + gap]
        out.append(T.mix(pair ^ _KIND[gap]))
        rows.append(row[on])
        if gap == 2:
            out.append(T.mix(pair + w.h[on + 1] * np.uint64(0xBF58476D1CE4E5B9) ^ _KIND[4]))
            rows.append(row[on])
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.uint32)


def _distinct(row: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.uint64) << np.uint64(32) | f)
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


@dataclass
class Model:
    """Coordinates with a weight, and the bias; a bias of minus infinity scores 0."""

    key: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.key] = self.weight
        return out

    def scores(self, column: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(column))
        if self.bias == -np.inf:
            return out
        table = self.table() if table is None else table
        for a, b in T.runs(column, RUN):
            row, f = features(column.slice(a, b - a))
            on = table[f] != 0
            row, f = _distinct(row[on], f[on])
            total = self.bias + np.bincount(row, table[f], b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return out


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in row order; row i has the coordinates rows[i]."""
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    bz = bn = 0.0
    for _ in range(epochs):
        for at, yi in zip(rows, y, strict=True):
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            b = -bz / ((BETA + bn**0.5) / ALPHA + L2)
            p = 1 / (1 + np.exp(-max(-40.0, min(40.0, b + float(w.sum())))))
            g = p - yi
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * b
            bn += g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w, -bz / ((BETA + bn**0.5) / ALPHA + L2)


@T.tidy
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, y, text) with a row's distinct coordinates in place of the text."""
    for batch in batches:
        for a, b in T.runs(batch.column(2), RUN):
            row, f = _distinct(*features(batch.column(2).slice(a, b - a)))
            first = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.record_batch({"order": batch.column(0).slice(a, b - a), "y": batch.column(1).slice(a, b - a), "f": pa.array([f[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())})


@T.tidy
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order, y, rows = [], [], []
    for batch in batches:
        order += batch.column(0).to_pylist()
        y += batch.column(1).to_pylist()
        rows += [np.frombuffer(x.as_buffer().to_pybytes(), np.uint32) for x in batch.column(2)]
    # rows of one id come in the order of their labels and features
    turn = sorted(range(len(y)), key=lambda i: (order[i], y[i], rows[i].tobytes()))
    w, bias = ftrl([rows[i] for i in turn], np.array([y[i] for i in turn], float), 1 << BITS)
    key = np.flatnonzero(w)
    yield pa.record_batch({"key": pa.array(np.append(key, -1), pa.int32()), "w": pa.array(np.append(w[key].astype(float), bias))})


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """``labelled``: ``doc_id, text, y`` (0 or 1; rows with a null label are left out, null texts are empty). One task fits the bounded sample.

    Without a row labelled 1 there is nothing to find, and all scores are 0. Rows that repeat count as often as they stand.
    """
    scratch = Scratch(labelled.sparkSession, "toxicity", RUN_BYTES)
    rows = labelled.where("y is not null").select(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")).alias("order"), F.col("y").cast("int").alias("y"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scratch.table(rows, "texts")
    count, size, toxic = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.max("y")).first()
    if not toxic:
        return Model(np.zeros(0, np.int32), np.zeros(0), -np.inf)
    share = min(1.0, train_rows / count, train_bytes / max(1, size))
    if share < 1:
        rows = rows.where(F.col("order").bitwiseAND(F.lit((1 << 31) - 1)) < F.lit(int(share * (1 << 31))))
    small = scratch.table(rows.mapInArrow(_featured, "order long, y int, f binary"), "sample")
    found = small.coalesce(1).mapInArrow(_fit, "key int, w double").toArrow()
    key, w = found["key"].to_numpy(), found["w"].to_numpy()
    return Model(key[key >= 0], w[key >= 0], float(w[key < 0].sum()))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score, from the whole text alone.

    Null and empty texts, and texts without a letter, get the bias's score. Every row gives one, repeated rows and null ids too;
    other columns are kept, one named as ``out`` is replaced.
    """
    names = docs.columns
    small_batches(docs.sparkSession, RUN_BYTES)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.table()
        for batch in batches:
            s = held.value.scores(batch.column(names.index(text_col)), table)
            keep = [k for k, n in enumerate(names) if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(s)], [*(names[k] for k in keep), out])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != out), f"`{out}` double"])
    return docs.mapInArrow(run, schema)


def label_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, y`` of labelled documents outside the held-out fold (crc32 of the id as text, modulo ``folds``).

    At most ``train_rows`` labels are taken, smallest hash first, so the side that meets the documents is bounded. An
    id labelled both ways counts as toxic.
    """
    y = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))).limit(train_rows)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
