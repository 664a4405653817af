"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.llm import decontaminate, jaccard_join, language_id, packing, toxicity
from stereolith.llm.queries import table, word_bpe
from stereolith.plans.scratch import Scratch

#: A text goes as unidentified below this score. The best of few languages always lies above; what is of none of them goes by its fit.
LEAST_LANGUAGE_SCORE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(toxicity.label_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, out="_toxicity").where("_toxicity < 0.5").select(docs.columns)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.train_rows_of(docs))
    found = language_id.identify(docs, model, lang_out="_lang", score_out="_score", fits_out="_fits")
    return found.where(F.col("_fits") & (F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays, as one row (the least, of rows that repeat the id); rows with a null id stay."""
    scratch = Scratch(spark, "classes")
    classes = jaccard_join.jaccard_classes(docs).where("doc_id is not null")
    marks = classes.groupBy("doc_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("_gone"))
    marks = scratch.table(marks.where("_gone or _n > 1"), "marks")
    single = docs.join(marks.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.join(marks.where("not _gone").select("doc_id"), "doc_id", "left_semi")
    return single.unionByName(repeated.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.assign(packing.pieces(docs, word_bpe(), with_ids=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Learned scores and packing have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
