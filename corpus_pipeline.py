"""From raw documents to packed sequences: quality rules, near-duplicate removal, personal data, packing.

Each stage takes the session, the documents that its predecessor kept, and the folder of the tables. All but the last
return the columns of documents. ``run`` writes the result of each stage as Parquet and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm import near_dup, packing, pii, quality
from kvstrata.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail.

    A null or empty text fails. Repeated rows are judged alike, very long texts whole, and other columns come along.
    """
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest identifier.

    Rows without an identifier or a text stay. Of equal rows one stays; an identifier with several texts is one row for each
    that no other document has.
    """
    return near_dup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    A null text stays null, a text without personal data as it is; very long texts are whole, and repeated rows stay.
    """
    redacted = docs.withColumn("text", pii.redact(F.col("text")))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    A null text is its end token alone; each repeated row is a document of its own; very long texts are cut.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: SQL has no word for the sketches and the tokenizer; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
