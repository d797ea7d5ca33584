"""The documents' way to training tokens: STAGES, each one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.mixing import mix
from tessera.llm.pieces import encode_documents
from tessera.llm.quality_rules import quality_rules
from tessera.llm.simhash import simhash_dedup
from tessera.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with row_key: equal for rows that are equal in all COLUMNS, and only for those."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(n).cast("string") for n in COLUMNS)]
    return docs.select(*COLUMNS, F.md5(F.concat(*parts).cast("binary")).alias("row_key"))


def _with(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Keyed documents with their row of ``decided`` (one per row_key)."""
    return docs.join(decided, "row_key").drop("row_key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own verdict."""
    docs = _keyed(docs)
    verdict = quality_rules(docs.withColumn("doc_id", F.col("row_key")))  # rows with equal keys have equal verdicts
    return _with(docs, verdict.where("kept").select(F.col("doc_id").alias("row_key")).distinct())


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits): the smallest doc_id; repeated rows of it become one."""
    docs = _keyed(docs)
    verdict = simhash_dedup(docs, shingle=3, radius=2, carry=["row_key"])
    return _with(docs, verdict.where("kept").select("row_key").distinct()).dropDuplicates()


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a smaller doc_id's text holds in 50-byte strings; n_chars follows the text."""
    out = suffix_dedup(docs, carry=["lang", "source"], with_text=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), F.col("x_lang").alias("lang"), F.col("x_source").alias("source"),
                      F.length("kept_text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (never, once or twice)."""
    docs = _keyed(docs)
    repeats = mix(docs, carry=["row_key"]).where("repeats > 0").select("row_key", "repeats").distinct()  # equal for equal keys
    return _with(docs, repeats).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))) \
        .select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids, n_chunks, round_trip."""
    return encode_documents(docs)


STAGES = [("quality_rules", quality_stage), ("simhash_near_dedup", simhash_stage), ("suffix_array_dedup", suffix_stage),
          ("source_mixing", mixing_stage), ("sentencepiece", sentencepiece_stage)]

#: The SimHash and outlier stages have no SQL form; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
