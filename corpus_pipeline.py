"""A corpus pipeline: language ID, near-duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import chaining, mixing, packing, ppm, shared, superminhash
from axisframe.llm.queries import MIX_WEIGHTS

#: A document whose language is less certain than this is rejected.
LEAST_CERTAIN = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no language that is known (op 3); a missing label becomes the language that is told."""
    shared.table(spark, sf_dir, "documents")  # the package is on the executors from here on
    model = ppm.fit(docs)
    told = ppm.identify(docs, model, keep=True)
    named = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN))
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each component of near-duplicates (op 1, but of 5-word shingles).

    Rows that repeat a doc_id and text are one; of rows with one doc_id and other texts all stay. So do null doc_ids.
    """
    found = superminhash.near_duplicates(docs, length=5).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    found, _ = shared.written(found, "kept")
    once = docs.join(found.where("k = 1"), "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.join(found.where("k > 1"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return once.select(*docs.columns).union(again.select(*docs.columns)).union(docs.where("doc_id is null"))


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds (op 10)."""
    return chaining.without_passages(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents until sources have their target weights (op 5)."""
    return mixing.mix(docs, MIX_WEIGHTS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token ids into windows (op 4)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", first_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: the stages' language model, signatures and tokenizer are outside SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
