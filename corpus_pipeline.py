"""The corpus pipeline: quality rules, toxicity, line dedup, near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Labels are read from sf_dir.

Defined cases of all stages: a null text counts as empty; rows are documents even if they share a doc_id or have none, and
rows that agree in all columns are documents each until near-dedup keeps one of them; columns beside those of documents are
dropped at once, so their names cannot clash; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import linededup, nearcopies, packing, quality, toxicity
from sievework.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The near-dedup stage first compares what SimHash links at so many differing bits; the links are those of a likeness of 0.8.
NEAR_BITS = 6

#: Its verdicts come from a trained classifier and a multi-pass graph search, which SQL cannot express; tests compare it
#: with a brute-force version.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. One without words is never kept; a text with both labels counts as bad."""
    return quality.keep_good(docs.select(*COLUMNS), _labels(spark, sf_dir))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic. One without words is scored as one without evidence."""
    return toxicity.reject_toxic(docs.select(*COLUMNS), _labels(spark, sf_dir))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; a text that had only such lines is left empty."""
    done = linededup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a five-word Jaccard of 0.8 or more: the one with the smallest doc_id (null last),
    then of the smallest hash. Texts without words are copies of each other."""
    return nearcopies.keep_one(docs.select(*COLUMNS), NEAR_BITS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and offset. An empty text is the end token alone."""
    return packing.pack_documents(docs)


STAGES = [("quality", good), ("toxicity", civil), ("line_dedup", fresh_lines), ("near_dedup", distinct_documents), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
