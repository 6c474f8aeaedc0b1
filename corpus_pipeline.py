"""A training-corpus pipeline: five stages over ``documents``, each with one of the operators of folio.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.

Defined results, for every stage: a null or empty text counts as empty and is no reason to drop a document,
except that equal texts are copies of each other, empty ones too. Repeated rows are copies. A null doc_id is an id like
any other, and of copies one with an id stays before one without. Texts of any length are read whole. An empty table
gives an empty one of the same columns. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import pieces, pii, simhash, templates, toxicity
from folio.llm.common import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score as toxic go; of equal scores all or none. Without labels of both classes nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8) one stays, the one of the smallest doc_id."""
    return simhash.dedupe(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item, re-parameterised or not, go; without a benchmark none does."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data and revealing terms are replaced; all documents stay, n_chars is the new length, a null text stays null."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every document; none for an empty text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii", sanitise),
    ("sentencepiece", encode),
]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
