"""What the pipeline's kernels hold at a time: numpy's own count of it, on one batch of many megabytes of text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from stereolith.llm import jaccard_join, language_id, toxicity
from stereolith.plans.scratch import RUN_BYTES

MB = 1_000_000


def batch(size, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(size // 2000)]
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_is_told_in_short_runs():
    texts = batch(4 * MB).column(1)
    marks = language_id.presence(texts.slice(0, 8)).astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(1), 1))
    fit = language_id._fit(marks, np.array(["a", "b"] * 4), ["a", "b"])
    model = language_id.Model(["a", "b"], marks, norms, np.eye(8, dtype=np.float32), np.random.default_rng(1).normal(size=(8, 2)).astype(np.float32), *fit)
    found = []
    assert peak(lambda: found.extend(model.predict(texts))) < 40 * MB
    one = [model.predict(texts.slice(i, 1)) for i in range(0, len(texts), 97)]
    assert [n for names, _, _ in one for n in names] == found[0][::97]
    assert np.allclose(np.concatenate([s for _, s, _ in one]), found[1][::97])


def test_toxicity_is_scored_in_short_runs():
    texts = batch(4 * MB).column(1)
    model = toxicity.Model(np.arange(0, 1 << toxicity.BITS, 3, dtype=np.int32), np.full((1 << toxicity.BITS) // 3 + 1, 0.01), -3.0)
    table, found = model.table(), []
    assert peak(lambda: found.append(model.scores(texts, table))) < 20 * MB
    assert np.allclose(np.concatenate([model.scores(texts.slice(i, 1), table) for i in range(0, len(texts), 97)]), found[0][::97])


def test_shingles_are_made_in_short_runs_and_first_pass_sends_tokens_alone():
    rows = batch(2 * MB)
    assert peak(lambda: [None for _ in jaccard_join.shingle_sets(rows.column(1))]) < 8 * MB
    first = list(jaccard_join._groups()(iter([rows])))
    assert all(b.schema.names == ["token"] for b in first)
    late = type("Held", (), {"value": (np.zeros(0, np.uint64), np.zeros(0, np.int32))})
    whole = pa.Table.from_batches(jaccard_join._groups(late)(iter([rows]))).column("token").drop_null().to_pylist()
    assert sorted(whole) == sorted(t for b in first for t in b.column(0).to_pylist())


def test_batches_of_text_are_small(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    try:
        assert {r["component_id"] for r in jaccard_join.jaccard_classes(docs).collect()} == {1}
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= RUN_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
