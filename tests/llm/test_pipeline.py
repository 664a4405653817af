"""The pipeline's stages against plain versions of what they decide."""

import random

from pyspark.sql import functions as F
from test_jaccard_join import brute
from test_operators import SF, shingles

import corpus_pipeline as P


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    some = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, some, SF).columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = {i: c for i, _, c in brute(rows)}
    one = {r["doc_id"] for r in P.one_of_each_class(spark, docs, SF).collect()}
    assert one == {i for i, c in classes.items() if i == c}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, t in rows if any(s and 100 * len(shingles(t) & s) >= 80 * len(s) for s in items)}
    assert {r["doc_id"] for r in P.drop_contaminated(spark, docs, SF).collect()} == {i for i, _ in rows} - bad


def test_run_packs_what_is_left(spark):
    out = P.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 100


def test_language_stage_rejects_what_is_of_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(0)
    planted = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (100, 400, 2000)] + [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "12 34",
    ]
    new = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = P.drop_unidentified(spark, docs.unionByName(new, allowMissingColumns=True), SF)
    assert not kept.where(F.col("doc_id") >= 10**9).count()
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) & F.col("text").rlike("[a-z]")
    assert kept.where(held).count() >= 0.998 * docs.where(held).count()


def test_one_row_stays_of_repeated_rows(spark):
    words = [f"w{k}" for k in range(90)]
    a, b, c = " ".join(words[:30]), " ".join(words[30:60]), " ".join(words[60:])
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (2, a, "x"), (3, b, "x"), (3, c, "x"), (4, None, None), (4, None, None), (5, c, "z"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.one_of_each_class(spark, docs, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "x"), (3, b, "x"), (4, None, None), (None, a, "x"), (None, a, "x")]))
