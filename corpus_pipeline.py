"""From raw documents to packed training sequences: five stages over one table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All
stages take an empty table and give one; texts of any length are worked on whole; columns
beside doc_id, text and n_chars pass through. A row is known by its id and text: rows that
the table repeats whole, and rows with a null id, are decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import decontaminate, jaccard, ledger, packing, quality
from tallystone.llm.tokens import vocabulary
from tallystone.session import materialise, scratch_path


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``rows`` names by doc_id and digest (xxhash64 of the text)."""
    named = rows.select(F.col("doc_id").alias("chosen id"), F.col("digest").alias("chosen digest"))
    same = docs["doc_id"].eqNullSafe(F.col("`chosen id`")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("`chosen digest`"))
    return docs.join(named, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' votes make probably good; the others go, null and empty texts among them."""
    return _chosen(docs, quality.judge(docs).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: that with the smallest id.

    A null id comes after all others; of rows repeated whole one stays. Texts without words
    are linked with nothing and stay.
    """
    firsts = jaccard.linked(docs, 5, 80).filter("first")
    kept = _chosen(docs, firsts).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept.dropDuplicates(["doc_id", "digest"]).drop("digest")  # a row that the table repeats whole


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none. Rows with one id go together."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), run=decontaminate.RUN)
    leaked = found.select(F.col("doc_id").alias("leaked id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(F.col("`leaked id`")), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced by a mark; n_chars follows the text, both stay null."""
    out = ledger.redact(docs, scratch_path(spark, "ledger"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids; a null or empty text is the end id alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("retrieval_packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the label model nor the packing can be said in SQL; the tests replay the stages in plain Python.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
