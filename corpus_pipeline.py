"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes each
stage's rows as Parquet to the shared folder that the session names and reads them again, so a lost executor
costs a stage at most. All stages but the last return the columns of documents.

Defined results. A table without rows gives no rows. Null ids: such rows are scored and compared as texts, but link with nothing and
have no repeats; of copies among them one stays. Repeated rows are one document from the second stage on; several texts of one id are each
kept, linked together and cut by themselves. Null and empty texts are equal, so one of them stays, the one with the smallest
id, as a piece that is its end id alone. Other columns pass through to the last stage, whatever their names; n_chars follows the text. Ties
are settled by the smallest id.

Learned weights and token ids are beyond SQL, so
ORACLE_SQL is None; tests/llm/test_pipeline.py holds each stage and the whole against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import exact_dedup, near_dedup, packing, scratch, suffix_dedup, toxicity

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the learned lexicon scores at 0.5 or more go; one at just 0.5 goes, one without words stays unless most labels are toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the smallest id stays, a null id only if there is no other; repeated rows once."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group stays, that with the smallest id; five-word shingles, similarity 0.8. Texts without words and rows without an id stay."""
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages of 50 words or more stay in the document with the smallest id only; every document stays."""
    cut = suffix_dedup.drop_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one row per piece of a document in a sequence of 2048 ids; a null text is its end id alone."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch.last_stays(spark):  # what the operator leaves for its result to be read from goes, now that the stage is written
            docs, path = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            scratch.drop(spark, last)
        last = path
    return docs
