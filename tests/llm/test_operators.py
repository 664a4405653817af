"""Small tests of the training-data operators: brute force, round trips, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import SF, connect, same

from stereolith.llm import decontaminate, language_id, license_scan, lm_score, packing, queries, topk_search, toxicity, warc

ODD = [(None, "null id"), (900, None), (901, ""), (902, "  \n"), (903, "long " * 30_000), (904, "same text"), (904, "same text"), (905, "same text")]


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, key string, n int, score double")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, con, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], con)


def test_toxicity_learns_and_takes_odd_rows(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(i, " ".join(r.choices(words, k=60) + (["vile", "scum"] if i % 5 == 0 else []))) for i in range(300)]
    labelled = spark.createDataFrame([(i, t, int(i % 5 == 0)) for i, t in rows], "doc_id long, text string, y int")
    model = toxicity.train(labelled)
    got = toxicity.score(frame(spark, [*rows[:50], *ODD]), model).collect()
    assert len(got) == 50 + len(ODD) and all(0 <= x["score"] <= 1 for x in got)
    assert all((x["score"] >= 0.5) == (x["doc_id"] % 5 == 0) for x in got[:50])
    assert toxicity.score(frame(spark, []), model).count() == 0
    # nothing is toxic without a row that is labelled so
    for none in ("false", "y = 0"):
        model = toxicity.train(labelled.where(none))
        assert {x["score"] for x in toxicity.score(frame(spark, [*rows[:9], *ODD]), model).collect()} == {0.0}


def test_ftrl_against_a_plain_version():
    r = random.Random(6)
    data = [(sorted(r.sample(range(40), r.randint(0, 12))), r.randint(0, 1)) for _ in range(150)]
    z, n = Counter(), Counter()

    def weight(i):
        if i != "bias" and abs(z[i]) <= toxicity.L1:
            return 0.0
        pull = 0.0 if i == "bias" else toxicity.L1 * np.sign(z[i])
        return -(z[i] - pull) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for f, y in data:
            w = {i: weight(i) for i in [*f, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    w, bias = toxicity.ftrl([np.array(f, np.uint32) for f, _ in data], np.array([y for _, y in data], float), 40, 3)
    assert np.allclose(w, [weight(i) for i in range(40)], atol=1e-3) and abs(bias - weight("bias")) < 1e-3 and 0 < np.count_nonzero(w) < 40


def test_toxicity_features_are_ngrams_and_skipgrams():
    import pyarrow as pa

    row, f = toxicity.features(pa.array(["Aa bb cc dd", "aa BB", None, "bb cc, 12"]))
    sets = [set(f[row == k].tolist()) for k in range(4)]
    # 4 words, 3 pairs, 2 triples, 2 and 1 skipped pairs; two texts share what they have in common
    assert [len(x) for x in sets] == [12, 3, 0, 3] and sets[1] < sets[0] and sets[3] < sets[0]


def test_language_id_learns_and_takes_odd_rows(spark):
    r = random.Random(1)
    say = lambda parts: " ".join("".join(r.choices(parts, k=3)) for _ in range(20))
    parts = {"aa": ["ka", "to", "mi"], "bb": ["sch", "und", "ver"]}
    rows = [(i, say(parts[lang]), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "x", None), (None, "katomi", "aa")], "doc_id long, text string, lang string")
    model = language_id.train(language_id.train_rows_of(df))
    got = {x["doc_id"]: x for x in language_id.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    none = [(k, t) for k, t in enumerate(["123 ?! …", "½ ²³ ① Ⅷ", "一²"[1:], "\u0301 €"])]
    odd = language_id.identify(frame(spark, [*ODD, *none, (4, "½ é"), (5, "一")]), model).collect()
    assert len(odd) == len(ODD) + 6
    assert {x["doc_id"] for x in odd if x["lang_pred"] == "und"} == {900, 901, 902, 0, 1, 2, 3}
    assert all(x["score"] == 0 for x in odd if x["lang_pred"] == "und")
    none = language_id.train(df.where("false"))
    assert {x["lang_pred"] for x in language_id.identify(df, none).collect()} == {"und"}


def test_languages_are_all_kept(spark):
    rows = [(k % 40, f"{chr(97 + k % 20) * 3} {chr(98 + k % 20) * 4} {chr(97 + k // 20) * 5}", f"l{k % 300:03d}") for k in range(900)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:03d}" for k in range(300)] and len(model.landmarks) == 300


def test_more_languages_than_landmarks(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANDMARKS", 40)
    rows = [(k, " ".join(chr(97 + (k * 7 + j * (1 + k // 26)) % 26) * 3 for j in range(6)), f"l{k % 90:03d}") for k in range(900)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 90 and len(model.landmarks) == 40
    got = language_id.identify(spark.createDataFrame([*rows, (None, "x", None)], "doc_id long, text string, lang string"), model, fits_out="fits").collect()
    assert len(got) == 901 and {x["lang_pred"] for x in got} <= set(model.languages)
    assert len({x["lang_pred"] for x in got}) > 40


def test_kernel_ridge_against_a_plain_version(spark):
    r = random.Random(9)
    texts = [(" ".join("".join(r.choices(parts, k=2)) for _ in range(r.randint(1, 6))), lang) for _ in range(12) for lang, parts in (("aa", ["ka", "tö"]), ("bb", ["sch", "un"]), ("cc", ["io", "l'"]))]
    model = language_id.train(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string"), landmarks=10_000)
    assert len(model.landmarks) == len(texts)

    def grams(t):
        b = re.sub(rb"[^a-z\x80-\xff]", b" ", t.lower().encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1) if n == 1 or b"  " not in b[i : i + 2]}

    def kernel(x, y):
        return np.array([[len(p & q) / np.sqrt(len(p) * len(q)) for q in map(grams, y)] for p in map(grams, x)])

    names = [t for t, _ in sorted(texts)]
    values, vectors = np.linalg.eigh(kernel(names, names))
    keep = values > 1e-4 * values[-1]
    z = lambda x: kernel(x, names) @ (vectors[:, keep] / np.sqrt(values[keep]))
    own = z([t for t, _ in texts])
    y = np.array([[1.0 if lang == k else -1.0 for k in ("aa", "bb", "cc")] for _, lang in texts])
    w = np.linalg.solve(own.T @ own + language_id.RIDGE * np.trace(own.T @ own) / own.shape[1] * np.eye(own.shape[1]), own.T @ y)
    new = ["kakatö", "schun l'io", "zzz", "unsch kaka io"]
    want = z(new) @ w
    got = {x["text"]: x for x in language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string"), model).collect()}
    for t, f in zip(new, want, strict=True):
        assert abs(got[t]["score"] - min(1, max(0, (f.max() + 1) / 2))) < 0.02
        if np.sort(f)[-1] - np.sort(f)[-2] > 0.05:
            assert got[t]["lang_pred"] == ("aa", "bb", "cc")[f.argmax()]


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_decontamination_against_all_pairs(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    items = [(i, " ".join(r.choices(words, k=r.choice([3, 5, 6, 8, 11, 12, 20, 22, 30, 90])))) for i in range(120)] + [(90 + 100, None), (None, "a b c d e"), (191, "")]
    docs = []
    for i in range(240):
        w = r.choices(words, k=r.choice([5, 60, 2000]))
        if i % 2:
            p = items[r.randrange(120)][1].split()
            if i % 4 == 3 and len(p) > 20:
                p[r.randrange(len(p))] = "other"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() for x in p]
        docs.append((i, " , ".join(w)))
    docs += [*ODD, (995, items[0][1])]
    want = sorted((d, i) for d, t in docs for i, s in items if d is not None and i is not None and shingles(s) and 100 * len(shingles(t) & shingles(s)) >= 80 * len(shingles(s)))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs).repartition(5), it)
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == sorted(set(want))
    kept = decontaminate.clean(frame(spark, docs), it)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})
    assert decontaminate.contaminated(frame(spark, []), it).count() == 0


@pytest.mark.parametrize("order,least,block,part", [(1, 1, 4_000, 500), (2, 2, 10_000_000, 1_500_000), (3, 1, 4_000, 500), (3, 2, 4_000, 500), (4, 1, 3_000, 300), (4, 3, 3_000, 300)])
def test_lm_scores_against_counts(spark, monkeypatch, order, least, block, part):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "PART_GRAMS", part)
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 80)))) for i in range(100)] + ODD + [(910, "all these words stand here alone")] * 3 + [(911, "nowhere else at all")]
    texts = [re.findall("[0-9a-z]+", t or "") for _, t in rows]
    count = Counter(tuple(t[k : k + n]) for t in texts for n in range(1, order + 1) for k in range(len(t) - n + 1))
    total = sum(map(len, texts))

    def s(gram):
        if len(gram) == 1:
            return np.log(count[gram] / total)
        return np.log(count[gram] / count[gram[:-1]]) if count[gram] >= least else np.log(0.4) + s(gram[1:])

    want = sorted((str(i), len(t), round(float(sum(s(tuple(t[max(0, k - order + 1) : k + 1])) for k in range(len(t)))), 6)) for (i, _), t in zip(rows, texts, strict=True))
    got = sorted((str(x["doc_id"]), x["n_words"], round(x["score"], 6)) for x in lm_score.scores(frame(spark, rows), order, min_count=least).collect())
    assert got == want
    assert lm_score.scores(frame(spark, [])).count() == 0


def test_packed_numbers():
    for k in (np.array([], np.uint64), np.array([0, 5, 2**64 - 1], np.uint64), np.arange(1, 90, dtype=np.uint64) ** 7):
        assert (lm_score.unpack(lm_score.pack(k)) == k).all()
    assert lm_score.unpack_counts(lm_score.pack_counts(np.array([1, 300, 2**40]))).tolist() == [1, 300, 2**40]


def best_fit(lengths, size):
    """Best-fit decreasing, a piece at a time."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def test_the_plan_is_best_fit_decreasing():
    r = np.random.default_rng(0)
    for size, n, low, high in ((8, 300, 1, 8), (100, 300, 1, 100), (4096, 900, 1, 4096), (4096, 600, 1200, 2900), (64, 500, 1, 12), (10, 7, 10, 10), (4096, 500, 1, 90)):
        lengths = r.integers(low, high + 1, n)
        values, counts = np.unique(lengths, return_counts=True)
        steps = packing.plan(values.tolist(), counts.tolist(), size)
        bins: dict[int, list] = {}
        taken: dict[int, list] = {}
        for length, first, many, each, b, offset in steps:
            taken.setdefault(length, []).append((first, first + many * each))
            for k in range(many):
                bins.setdefault(b + k, []).extend((offset + j * length, length) for j in range(each))
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            spans = sorted(taken[v])
            assert spans[0][0] == 0 and spans[-1][1] == c and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        left = []
        for b in bins.values():
            end = 0
            for o, k in sorted(b):
                assert o == end
                end += k
            left.append(size - end)
        assert sorted(left) == best_fit(lengths.tolist(), size)


def test_packing_is_whole(spark):
    path = queries.word_bpe()
    rows = [*ODD, *[(i, f"Some text, number {i}! It's ²³ ñÉ <|endoftext|> " * (1 + i % 9)) for i in range(60)]]
    out = packing.assign(packing.pieces(frame(spark, rows), path, capacity=256), 256).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    by_doc: dict = {}
    bins: dict = {}
    for x in out:
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] and len(x["ids"]) == x["length"] and x["start"] == 256 * x["piece"]
        by_doc.setdefault(x["doc_id"], []).append(x)
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 256
    whole = [sum((p["ids"] for p in sorted(v, key=lambda p: p["piece"])), []) for k, v in by_doc.items() if k not in (904, None)]
    assert all(w in want for w in whole) and len(whole) == len(rows) - 3
    assert len(bins) == len(best_fit([x["length"] for x in out], 256))
    seqs = packing.sequences(spark.createDataFrame([(1, 1, 0, 0, [5, 6]), (1, 2, 0, 2, [7])], "sequence_id long, doc_id long, piece int, offset long, ids array<int>")).first()
    assert seqs["ids"] == [5, 6, 7]
    assert packing.assign(packing.pieces(frame(spark, []), path)).count() == 0


@pytest.mark.parametrize("length", ["3000", "1 + pmod(xxhash64(id), 2500)", "if(id % 2 = 0, 2500 + pmod(xxhash64(id), 1500), 100 + pmod(xxhash64(id), 1500))", "1200 + pmod(xxhash64(id), 1700)"])
def test_packing_is_one_best_fit_of_all(spark, length):
    df = spark.range(0, 6000, 1, 9).selectExpr("id as doc_id", "0 as piece", f"cast({length} as long) as length", "'kept' as offset")
    out = packing.assign(df).toPandas()
    assert len(out) == out["doc_id"].nunique() == 6000
    out = out.sort_values(["sequence_id", "offset"])
    ends = out["offset"] + out["length"]
    same = out["sequence_id"].to_numpy()[1:] == out["sequence_id"].to_numpy()[:-1]
    assert (out["offset"].to_numpy()[1:] == np.where(same, ends.to_numpy()[:-1], 0)).all()
    used = out.groupby("sequence_id")["length"].sum()
    assert sorted(4096 - used) == best_fit(out["length"].tolist(), 4096)


def test_packed_sequences_hold_their_documents(spark):
    path = queries.word_bpe()
    texts = [(i, f"Text {i} " * (1 + i % 40)) for i in range(120)]
    packed = packing.assign(packing.pieces(frame(spark, texts), path, capacity=128), 128)
    whole = {}
    for s in packing.sequences(packed).collect():
        assert len(s["ids"]) <= 128
        whole[tuple(s["ids"])] = s["doc_ids"]
    tok = packing.tokenizer(path)
    assert sum(len(k) for k in whole) == sum(len(tok.encode(t)) // 4 + 1 for _, t in texts)


def test_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.word_bpe()
    whole, fast = Tokenizer.from_file(path), packing.tokenizer(path)
    r = random.Random(8)
    some = ["a", "B", "é", "ß", "İ", "ǅ", "²", "½", "1", "_", "'", "'s", "'LL", "’", "-", ".", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\u200b", "\u0301", "Ω", "一", "😀", "\x00", "\x85", "<|", "|>", "<|endoftext|>", "ﬁ", "\u2028", "¡", "\xad"]
    texts = ["".join(r.choices(some, k=r.randint(0, 12))) for _ in range(4000)]
    texts += [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:200]


def test_warc_round_trip(spark):
    rows = [(3, "http://a/x?y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "no\r\nurl", None), (5, "http://b", ""), (7, "http://c", "\r\n\r\nWARC/1.1"), (7, "http://c", "\r\n\r\nWARC/1.1"), (None, "http://d", "<p>é</p>"), (-4, "http://[bad", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    got = warc.round_trip(df, with_block=True).collect()
    assert len(got) == len(rows)
    kind = sorted((str(x["page_id"]), x["response"]["type"], str(x["response"]["refers_to"])) for x in got)
    assert kind == sorted([("3", "revisit", "1"), ("1", "response", "None"), ("2", "response", "None"), ("5", "revisit", "2"), ("7", "response", "None"), ("7", "response", "None"), ("None", "revisit", "1"), ("-4", "response", "None")])
    for x in got:
        html = next(h for p, _, h in rows if p == x["page_id"]) or ""
        assert x["response"]["payload_bytes"] == len(html.encode()) and x["response"]["payload_digest"] == warc.base32_sha1(html.encode())
        assert x["request"] is not None and x["metadata"] is not None
        if x["response"]["type"] == "response":
            assert bytes(x["response"]["block"]).endswith(html.encode())
        assert bytes(x["request"]["block"]).startswith(b"GET ") and dict(x["metadata"]["fields"])["warc-type"] == "metadata"
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_of_one_payload_in_many_pages_and_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 10)
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "if(id % 3 = 0, '', if(id % 3 = 1, 'same', concat('own ', id))) as html").repartition(3)
    scratch = warc.Scratch(spark, "test")
    manifest = scratch.table(warc.write_archives(pages, scratch.path("archives"), most=4_000), "manifest")
    records = warc.read_records(manifest)
    assert manifest.count() > 8 and records.rdd.getNumPartitions() == min(manifest.count(), 32)
    got = {x["page_id"]: x["response"] for x in warc.captures(records).collect()}
    assert len(got) == 400
    for i, x in got.items():
        first = i % 3 if i % 3 < 2 else i
        assert (x["type"], x["refers_to"]) == (("response", None) if i == first else ("revisit", first))


def test_license_places(spark):
    rows = [*ODD, (1, "Under the MIT License. cc by nc cc-by-nc; under the mit licenses"), (2, "Permission is hereby granted, free of charge, to any person"), (3, "APACHE LICENSE, version 2 apache license version 2")]
    got = {x["doc_id"]: x for x in license_scan.digest(license_scan.scan(frame(spark, rows))).collect()}
    assert tuple(got[1])[1:7] == (14, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit") and got[1]["score"] == 1.0
    assert got[2]["base_labels"] == "" and got[2]["labels"] == "mit" and got[2]["first_word"] is None and 0 < got[2]["score"] < 1
    assert got[3]["n_base"] == 2 and got[3]["last_word"] == 4
    assert got[900]["n_words"] == 0 and got[903]["n_words"] == 30_000 and got[900]["score"] == 0.0
    assert license_scan.digest(license_scan.scan(frame(spark, []))).count() == 0
    # every notice is found by its label, whatever words are rare; more anchors change nothing
    whole = [(k, f"x {t.text.upper()} y") for k, t in enumerate(license_scan.TEMPLATES)]
    for anchors in (1, 2, 4):
        got = {x["doc_id"]: x for x in license_scan.digest(license_scan.scan(frame(spark, [*whole, *ODD]), anchors=anchors)).collect()}
        assert all(t.label in got[k]["labels"].split(",") and got[k]["score"] == 1.0 for k, t in enumerate(license_scan.TEMPLATES))
    assert len({t.label for t in license_scan.TEMPLATES}) >= 20


@pytest.mark.parametrize("most", [32_000_000, 100])
def test_top_k_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(topk_search, "BLOCK", 150)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", most)
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(700, 6)), 1)
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (None, [1.0] * 6), (1000, [])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk_search.top_k(df, df.where("vec_id % 100 = 0")).collect())
    q = np.floor(1024 * v.astype(np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, 700, 100):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:10]
        want += [(i, n + 1, int(j), int(s[j])) for n, j in enumerate(best)]
    assert got == want
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0
    # a repeated query is answered twice; huge components are exact or held at the ends of 64 bits
    few = spark.createDataFrame([(1, [3.0e12, 1.0]), (1, [3.0e12, 1.0]), (2, [1.0e300, 0.0]), (3, [-2.0e3, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk_search.top_k(few, few.where("vec_id in (1, 4)"), 2).collect())
    a, top = 3 * 10**12 * 1024, 2**63 - 1
    assert got == sorted([*[(1, 1, 2, top), (1, 2, 4, a * 1024)] * 2, (4, 1, 2, top), (4, 2, 1, a * 1024)])
