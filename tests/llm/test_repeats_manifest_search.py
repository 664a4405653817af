"""Substring removal, manifests and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolith.llm import merkle, ranked_search, substring_dedup

ODD = [(None, "null id"), (900, None), (901, ""), (902, "  \n"), (903, "long " * 30_000), (904, "same text"), (904, "same text"), (905, "same text")]


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4.0) for i, t in rows], "doc_id long, text string, key int, n int, marks string, idx int, score double")


def without_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if places[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("window,run,block", [(35, 4_000_000, 6_000_000), (35, 3_000, 5_000), (8, 20_000, 2_000), (3, 3_000, 5_000)])
def test_repeats_against_all_windows(spark, monkeypatch, window, run, block):
    for name, value in (("RUN", run), ("BLOCK", block), ("COMMON", 8), ("LOCAL", 2)):
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(window + run)
    words = [f"w{k}" for k in range(400)] + ["é", "über", "W1", "あい", "a b"]
    passage = [r.choices(words, k=n) for n in (window - 1, window, window + 1, 2 * window + 5)]
    rows = []
    for i in range(220):
        w = r.choices(words, k=r.choice([0, 3, window, 60, 150]))
        if i % 3 == 0:  # a third of the rows share a passage, at different places
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[3]
        if i % 20 == 1:
            w += passage[i % 3]
        rows.append((i, r.choice(["", " ", "\n "]) + r.choice([" ", "\t", " \r\n "]).join(w) + r.choice(["", " "])))
    text = " ".join(r.choices(words, k=90))
    rows += [(300 + k, text) for k in range(40)] + [(400 + k, text[: 300 - k] + " changed " + text[300 - k :]) for k in range(40)]
    rows += [(500, "a b c d e f g h " * 40), (501, ("x " * 70 + "y ") * 5), (502, "z " * (window + 1)), *ODD]
    got = substring_dedup.dedupe(frame(spark, rows).repartition(5), window=window).collect()
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"], x["kept"]) for x in got) == without_repeats(rows, window)


def test_repeats_of_empty_tables(spark):
    assert substring_dedup.dedupe(frame(spark, [])).count() == 0
    got = substring_dedup.dedupe(frame(spark, [(1, None), (2, "a b")])).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in got) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


def test_windows_of_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9])
    start = np.arange(7)
    equal = lambda g: [[g[i] == g[j] for j in range(7)] for i in range(7)]
    want = equal([tuple(ids[k : k + 3]) for k in start])
    assert equal(substring_dedup.repeats(ids, start, 3)) == want
    assert equal(substring_dedup.repeats(ids, start, 3, value=np.zeros(7, np.uint64))) == want


def plain_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r: h("".join(map(field, r)))

    def climb(nodes):
        """(root, each one's steps)"""
        steps = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[8 * (a // 8) : 8 * (a // 8) + 8]
                steps[k].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
            nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
            at = [a // 8 for a in at]
        return nodes[0], steps

    trees = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    roots = {k: climb([leaf(r) for r in v]) for k, v in trees.items()}
    root, upper = climb([x for x, _ in roots.values()])
    out = []
    for (lang, own), top in zip(trees.items(), upper, strict=True):
        for r, below in zip(own, roots[lang][1], strict=True):
            steps = below + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf((*r[:4], r[4].translate(low) if changed and r[4] is not None else r[4]))
            for a, b in steps:
                x = h(a + x + b)
            out.append((str(r[0]), leaf(r), roots[lang][0], root, h("".join(a + b for a, b in steps)), x, x == root))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 700])
def test_manifest_against_a_plain_version(spark, n):
    r = random.Random(n)
    langs = [None, "", "en", "EN", "é", "\U0001f600", "￿", "-", "1:x"] + [f"l{k}" for k in range(70)]
    rows = [(r.choice([None, r.randrange(-50, 3 * n)]) if r.random() < 0.05 else 3 * k - n, r.choice([None, "", "src"]), "en" if k % 2 else r.choice(langs), r.choice([None, k]), r.choice([None, "", "Été ABC", "low", "X" * r.randrange(200)])) for k in range(n)]
    rows += rows[: n // 10]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, h string").repartition(3)
    got = sorted((str(x["doc_id"]), *list(x)[1:]) for x in merkle.digest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == (plain_manifest(rows) if n else [])


def test_binary_manifest(spark):
    rows = spark.range(11).selectExpr("id", "'t' as grp", "sha2(cast(id as string), 256) as leaf_")
    got = merkle.manifest(rows, "grp", "id", "leaf_", [], arity=2)
    nodes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(11)]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[k : k + 2]).encode()).hexdigest() for k in range(0, len(nodes), 2)]
    found = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert len(found) == 11 and {x["root"] for x in found} == {x["folded"] for x in found} == {nodes[0]}


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for i, t in {x for x in items if x[1] is not None}:
        found = []
        for d, c in own:
            m = 75 + (25 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 12 * m)) for x in terms(t) if c[x])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(str(i), rank + 1, str(x[3]), -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,batch,cells", [(4_000_000, 4_000_000, 1_000_000), (400, 300, 200)])
def test_ranks_against_all_scores(spark, monkeypatch, block, batch, cells):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("CELLS", cells), ("RUN", 100 * batch)):
        monkeypatch.setattr(ranked_search, name, value)
    r = random.Random(4)
    words = [f"w{int(k**1.5)}" for k in range(60)] + ["é", "Ünder", "x_y"]
    docs = [(i, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.choice([1, 8, 40, 200])))) for i in range(260)]
    docs += [(1000 + k, "w0 w1 w2 w0 É") for k in range(120)] + ODD + [(None, "w0 w1 w2")]
    items = [(i, ", ".join(r.choices(words, k=r.choice([1, 4, 30]))).upper()) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "long same null"), (53, "long same null"), (54, " ".join(words) * 2), (None, "w0 w5"), (55, "w0 w1 w2 w0 é")]
    it = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    got = ranked_search.top_documents(frame(spark, docs).repartition(4), it)
    assert sorted((str(x["item_id"]), x["rank"], str(x["doc_id"]), x["score"]) for x in got.collect()) == plain_ranks(docs, items, 20)
    assert ranked_search.top_documents(frame(spark, []), it).count() == 0 == ranked_search.top_documents(frame(spark, docs), it.where("false")).count()


def test_trees_skip_what_cannot_qualify():
    r = np.random.default_rng(3)
    tf = (r.random((20_000, 24)) < np.geomspace(0.4, 0.002, 24)) * (1 + (r.random((20_000, 24)) < 0.1))
    tf = tf[tf.any(1)].astype(np.int64)
    m, w = r.integers(75, 110, len(tf)), (1000 * -np.log(np.geomspace(0.4, 0.002, 24))).astype(np.int64)
    tree = ranked_search.Tree(tf, m)
    exact = tree.scores(slice(None), w)
    assert all(b >= exact[a:e].max() for a, e, b in zip(tree.row, tree.until, tree.bounds(0, len(tree.row), w), strict=True))
    best = ranked_search.Best(20)
    scored = ranked_search.search(tf, m, w, np.arange(len(tf)), np.ones(len(tf), bool), best)
    want = np.lexsort((np.arange(len(tf)), -(ranked_search.part(tf, m[:, None]) @ w)))[:20]
    assert best.doc.tolist() == want.tolist() and scored < len(tf) / 5
