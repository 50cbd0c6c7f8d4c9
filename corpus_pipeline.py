"""The corpus pipeline: toxic, undetermined and near-duplicate documents go, repeated passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents in their order; ``text`` and ``n_chars`` change where a stage cuts texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.llm import langid, neardup, packing, repeats, toxicity
from densika.llm.common import drop_folder, make_importable, read, shared_folder

#: Near-duplicates of the pipeline: five words a shingle, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Passages of so many bytes that an earlier document has too are cut.
PASSAGE_BYTES = 50
#: A language is rejected below this score (of 1), and where it can't be determined.
LEAST_LANGUAGE_SCORE = 0.3


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    make_importable(spark)
    models = toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id", "text", "toxic", None, toxicity.SAMPLE)
    return toxicity.drop_toxic(docs, models)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that can be told."""
    make_importable(spark)
    model = langid.learn(docs, "doc_id", "text", "lang")
    return langid.drop_undetermined(docs, model, least=LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, and rows that have no id."""
    make_importable(spark)
    found = neardup.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    gone = found.where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too; n_chars follows the text."""
    make_importable(spark)
    left = repeats.cut_repeats(docs, length=PASSAGE_BYTES)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    make_importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", packed),
]
#: Learned models, Bayesian pruning and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what was read is deleted then."""
    docs = read(spark, sf_dir, "documents")
    folder, before = shared_folder(spark, "pipeline"), ""
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
