"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of byte n-grams (n = 1, 2, 3, hashed into
``BUCKETS``) that both hold, over the root of the product of their own numbers. Nyström landmarks (about ``LANDMARKS``
training texts, as many of each language) turn it into features Z = K(x, landmarks) K(landmarks, landmarks)^(-1/2), and
one-versus-rest kernel ridge regression is solved from Z'Z and Z'Y, which Spark sums over at most about ``TRAIN_ROWS`` training
rows. Scoring is two matrix products per run of rows, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereolith.llm import text as T
from stereolith.plans.scratch import RUN_BYTES, small_batches

ORDERS = (1, 2, 3)
BUCKETS = 4096
LANDMARKS = 256
#: Landmarks at most. With more languages than that, these are one each of the languages of least hash; all languages are still
#: learned, as features come from landmarks of any language.
MOST_LANDMARKS = 1024
TRAIN_ROWS = 8192
#: Bytes of text at a time: an n-gram a byte, eight bytes each, several copies while they are hashed.
RUN = 300_000
RIDGE = 1e-3
UNKNOWN = "und"
#: A text fits its language if its share of n-grams that the language's landmarks hold reaches this part of what
#: ``FIT_OF`` of the landmarks reach, each without itself.
FIT, FIT_OF = 0.75, 0.95

_plain = np.full(256, 32, np.uint8)
_plain[97:123] = np.arange(97, 123)
_plain[128:] = np.arange(128, 256)


def presence(column: pa.Array) -> np.ndarray:
    """Rows by buckets, 1 where the row holds an n-gram of the bucket; digits and marks count as blanks."""
    buf, off = T.text_bytes(column)
    n = len(buf) - 8
    buf[:n] = _plain[buf[:n]]
    out = np.zeros((len(off) - 1, BUCKETS), np.uint8)
    if not n:
        return out
    flat = out.ravel()
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64) * BUCKETS, np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    at8 = np.ndarray(shape=(n,), dtype="<u8", buffer=buf, strides=(1,))
    blank = buf[:n] == 32
    place = np.arange(n)
    for k in ORDERS:
        v = at8 & np.uint64((1 << (8 * k)) - 1)
        bucket = (v * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
        # a run of blanks counts once, and an n-gram ends within its row
        on = place + k <= end
        if k > 1:
            on[: n - 1] &= ~(blank[: n - 1] & blank[1:n])
        flat[row[on] + bucket[on].astype(np.int64)] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    norms: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    #: Languages' rows of ``known``, the buckets that their landmarks hold, and the least share of them in a text that fits.
    slot: np.ndarray
    least: np.ndarray
    known: np.ndarray

    def features(self, column: pa.Array) -> np.ndarray:
        return self.project(presence(column))

    def project(self, p: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(p.sum(1, dtype=np.float32), 1))
        return (p.astype(np.float32) @ self.landmarks.T / own[:, None] / self.norms) @ self.root

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether each text fits its language at all."""
        names, scores, fits = [], [], []
        for a, b in T.runs(column, RUN):
            part = column.slice(a, b - a)
            for text_at in range(0, b - a, 1024):
                some = part.slice(text_at, 1024)
                if not self.languages:
                    names += [UNKNOWN] * len(some)
                    scores.append(np.zeros(len(some)))
                    fits.append(np.zeros(len(some), bool))
                    continue
                p = presence(some)
                f = self.project(p) @ self.weights
                best = f.argmax(1)
                known = lettered(some)
                names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, np.clip((f.max(1) + 1) / 2, 0, 1), 0.0))
                fits.append(known & ((p & self.known[self.slot[best]]).sum(1) >= self.least[best] * p.sum(1)))
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(fits) if fits else np.zeros(0, bool)


def _fit(marks: np.ndarray, langs: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each language's row of ``known``: buckets that two of its landmarks hold (one, of fewer than three); the least share of
    them that fits; and ``known``. Languages without landmarks share a row of none, and any text fits them."""
    have = np.unique(langs)
    slot = np.minimum(np.searchsorted(have, languages), len(have) - 1)
    slot = np.where(have[slot] == np.array(languages), slot, len(have))
    known, least = np.zeros((len(have) + 1, BUCKETS), np.uint8), np.zeros(len(have) + 1)
    for k, lang in enumerate(have):
        own = marks[langs == lang] > 0
        hold = own.sum(0)
        enough = 2 if len(own) > 2 else 1
        known[k] = hold >= enough
        if len(own) > 1:
            share = (own & (hold - own >= enough)).sum(1) / np.maximum(own.sum(1), 1)
            least[k] = FIT * np.quantile(share, 1 - FIT_OF)
    return slot, least[slot], known


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each row has a letter (a character of Unicode's categories L; numerals such as one half or a circled one are none)."""
    w = T.words(column, T.ALPHA)
    out = np.diff(w.first) > 0
    buf, off = T.text_bytes(column)
    ascii_letter = np.concatenate([[0], np.cumsum((buf[:-8] >= 97) & (buf[:-8] <= 122))])
    for i in np.flatnonzero(out & (ascii_letter[off[1:]] == ascii_letter[off[:-1]])):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out


def _hash(salt: str) -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt))


def _sampled(df: DataFrame, per_class: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` rows of each language (all, if fewer), by hash of the id: no window over a language's rows."""
    share = _hash(salt).bitwiseAND(F.lit((1 << 31) - 1)) / (1 << 31)
    return df.join(F.broadcast(per_class), "lang").where(share * F.col("rows") < most)


def train(labelled: DataFrame, landmarks: int = LANDMARKS, train_rows: int = TRAIN_ROWS) -> Model:
    """``labelled``: ``doc_id, text, lang``; rows with a null or empty text or a null language are left out.

    Every language has the same number of landmarks (one at least, all its rows if it has fewer), those of least hash of the id;
    repeated rows are rows of their own. The model grows with the number of languages, not of rows.
    Whether a row is held out is for the caller to say (``train_rows_of``); a null id has no fold and is not learned from.
    """
    spark = labelled.sparkSession
    small_batches(spark, RUN_BYTES)
    rows = labelled.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return Model([], *(np.zeros((0, 0), np.float32),) * 7)
    each = max(1, min(landmarks, MOST_LANDMARKS) // len(languages))
    # twice as many by chance, then the first of them: a language's rows never meet in one place
    first = F.row_number().over(Window.partitionBy("lang").orderBy(_hash("landmark"), "doc_id", "text"))
    of = counts
    if len(languages) > MOST_LANDMARKS:
        of = counts.orderBy(F.xxhash64("lang", F.lit("landmark")), "lang").limit(MOST_LANDMARKS)
    base = _sampled(rows, of, 2 * each + 8, "landmark").withColumn("turn", first).where(F.col("turn") <= each)
    found = sorted(base.select("doc_id", "lang", "text").mapInArrow(_as_presence, "doc_id long, lang string, p binary").collect(), key=lambda r: (r["lang"], r["doc_id"], r["p"]))
    marks = np.array([np.unpackbits(np.frombuffer(r["p"], np.uint8)) for r in found], np.float32)
    norms = np.sqrt(np.maximum(marks.sum(1), 1))
    k = marks @ marks.T / norms[:, None] / norms
    values, vectors = np.linalg.eigh(k.astype(float))
    keep = values > 1e-4 * values[-1]
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    fit = _fit(marks, np.array([r["lang"] for r in found]), languages)
    half = spark.sparkContext.broadcast(Model(languages, marks, norms, root, np.zeros((0, 0)), *fit))

    @T.tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = half.value
        size = m.root.shape[1]
        zz, zy = np.zeros((size, size)), np.zeros((size, len(m.languages)))
        seen = False
        for batch in batches:
            for a, b in T.runs(batch.column(0), RUN):
                z = m.features(batch.column(0).slice(a, b - a)).astype(float)
                y = np.where(np.array(batch.column(1).slice(a, b - a).to_pylist())[:, None] == np.array(m.languages), 1.0, -1.0)
                zz += z.T @ z
                zy += z.T @ y
                seen = True
        if seen:
            yield pa.record_batch({"row": pa.array(np.arange(size)), "v": pa.array(list(np.hstack([zz, zy])), pa.list_(pa.float64()))})

    sample = _sampled(rows, counts, max(1, train_rows // len(languages)), "train")
    parts = sample.select("text", "lang").mapInArrow(sums, "row long, v array<double>")
    total = parts.select("row", F.posexplode("v")).groupBy("row", "pos").agg(F.sum("col").alias("v")).collect()
    size = root.shape[1]
    both = np.zeros((size, size + len(languages)))
    for r in total:
        both[r["row"], r["pos"]] = r["v"]
    weights = np.linalg.solve(both[:, :size] + RIDGE * np.trace(both[:, :size]) / size * np.eye(size), both[:, size:])
    return Model(languages, marks, norms, root, weights.astype(np.float32), *fit)


@T.tidy
def _as_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence(batch.column(2).slice(i, 1))[0]).tobytes() for i in range(batch.num_rows)]
        yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "lang": batch.column(1), "p": pa.array(bits, pa.binary())})


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fits_out: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1); null texts and texts without a letter get ``und`` and 0.

    Texts are read whole. Every row gives one, repeated rows and null ids too; of equal scores the first language by name is taken.
    Other columns are kept, those named as a result are replaced. A model of no languages calls everything ``und``.

    ``fits_out``: whether the text is of its language at all, as letter junk and languages not learned are not.
    """
    names = docs.columns
    small_batches(docs.sparkSession, RUN_BYTES)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = [(lang_out, "string"), (score_out, "double"), *([(fits_out, "boolean")] if fits_out else [])]
    kept = [k for k, n in enumerate(names) if n not in [o for o, _ in out]]

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, s, fits = held.value.predict(batch.column(names.index(text_col)))
            new = [pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(fits, pa.bool_())][: len(out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], [*(names[k] for k in kept), *(o for o, _ in out)])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{names[k]}` {types[names[k]]}" for k in kept), *(f"`{o}` {t}" for o, t in out)]))


def train_rows_of(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, text, lang`` outside the held-out fold (crc32 of the id as text, modulo ``folds``)."""
    return docs.select("doc_id", "text", "lang").where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
