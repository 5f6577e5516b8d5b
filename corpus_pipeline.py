"""The corpus pipeline: five stages over ``documents``, each one operator of barflow.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import Scratch
from barflow.llm.langid import identify, train
from barflow.llm.linededup import line_dedup
from barflow.llm.minhash import first_of_each
from barflow.llm.mixing import WEIGHTS, mix, tree
from barflow.llm.packing import best_fit_packing

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 2048


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what has letters and a likely language; a document without a label gets the one predicted.

    Null and empty texts and those without a letter go, repeated rows stay or go alike.  Where no document has a label there is
    nothing to learn and nothing to reject by: every text with a letter stays, unlabelled.
    """
    model = train(docs)
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sure = identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines like earlier ones; a document that loses every line with words goes, the others' n_chars follow.

    Null, empty and blank texts lose nothing and stay; of repeated rows the first in the table keeps its lines and the others go.
    """
    done = line_dedup(docs)
    kept = done.filter((F.size("__gone") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    return kept.withColumn("n_chars", F.when(F.size("__gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate class (smallest doc_id, null before all, then the first row); texts without a word all stay."""
    return first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mixture's budgets; one that is taken in several epochs is there as often.

    A null language or source is a value of its own; documents of an equal id and so an equal place are taken together or not at all.
    """
    return mix(docs, tree(), WEIGHTS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most SEQUENCE tokens; a null or empty text is its end token, repeated rows are packed one by one."""
    return best_fit_packing(docs, TOKENIZER, SEQUENCE)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: No stage but the mixture can be told in SQL: tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = scratch.keep(done) if k < len(STAGES) - 1 else done
    return docs
