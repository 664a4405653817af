import random
import re

import pytest

from stereolith.llm import jaccard_join as J


def brute(rows):
    """(id, text) rows -> {id: component} and set sizes, by all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def made(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = [r.choice(words) for _ in range(60)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind == 1:
            w = [r.choice(words) for _ in range(r.randint(1, 80))] + common
        elif kind == 2:
            w = [r.choice(words) for _ in range(r.randint(0, 8))]
        elif kind == 3 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").upper().split()
        elif kind == 4 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").split()
            if w:
                w[r.randrange(len(w))] = "x"
        else:
            w = [r.choice(words) for _ in range(r.randint(20, 60))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("parts,long", [(1, 8), (40, 3)])
def test_against_all_pairs(spark, monkeypatch, parts, long):
    monkeypatch.setattr(J, "LONG", long)
    rows = made(300, 5) + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c d e f"), (7, "another text of the same id"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in rows], "doc_id long, text string, component_id string, token int").repartition(parts)
    got = sorted(map(tuple, J.jaccard_classes(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_meet():
    for n in range(1, 200):
        assert n - J.prefix_length(n) < -(-80 * n // 100)
