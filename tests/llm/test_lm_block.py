"""A block's counts of n-grams, as its places get them."""

from collections import Counter

import numpy as np
import pyarrow as pa

from stereolith.llm import lm_score


def test_totals_reach_every_place_without_a_search_each(monkeypatch):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in r.zipf(1.5, 400) % 300) for _ in range(60)] + [None, "", "one"]
    docs = pa.table({"doc_id": np.arange(len(texts)), "text": pa.array(texts, pa.string())})
    block = lm_score.Block(docs, 3, 1, 7)
    none = pa.table({"part": pa.array([], pa.int64()), "more": pa.array([], pa.binary()), "totals": pa.array([], pa.binary())})
    # the corpus is this block twice: every total is double its count here
    keys, counts = block.level([1, 2], None)
    rows = [(p, np.packbits(np.ones(b - a, bool)).tobytes(), lm_score.pack_counts(2 * counts[a:b])) for p, a, b in lm_score._spans(keys, 7) if b > a]
    told = pa.table({c: [row[k] for row in rows] for k, c in enumerate(none.column_names)})
    sought, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **named: (sought.append(np.size(v)), search(a, v, *args, **named))[1])
    got = block.level([1, 2], told)
    block.level([3], none)
    monkeypatch.undo()
    assert sum(sought) <= 4 * 7
    assert (got[0] == keys).all() and (got[1] == 2 * counts).all()
    words = [(t or "").split() for t in texts]
    for n in (1, 2, 3):
        whole = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
        expected = [(whole[tuple(w[i : i + n])] * (2 if n < 3 else 1)) if i + n <= len(w) else 0 for w in words for i in range(len(w))]
        assert np.concatenate([c[n - 1] for c in block.count]).tolist() == expected, n
