"""Five stages from raw documents to token ids.

Every stage takes the documents its predecessor kept and returns documents
(the last one token ids); its result is written and read again before the
next.  Only the columns of documents are carried on; others are left out.

Defined cases: null and empty texts leave in the first stage, as they have no
letter; rows with a null id are kept like others; rows alike in all columns are
one document after the second stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, langid, mixing, personal, simhash
from vigil.llm.common import DOCUMENT_COLUMNS, table
from vigil.llm.queries import PATTERN, VOCABULARY
from vigil.session import materialize

COLUMNS = list(DOCUMENT_COLUMNS)

#: Bytes of texts that go to a Python worker at once; a longer text goes alone.
BATCH_BYTES = 4 << 20


def sent_in_parts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents; from now on the session sends them to Python in bounded batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    docs = sent_in_parts(spark, docs)
    found = langid.identify(docs, langid.learn(docs), COLUMNS)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(sent_in_parts(spark, docs), words=simhash.SHINGLE, bits=simhash.BITS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new lengths."""
    found = personal.redact(sent_in_parts(spark, docs), spans="_redacted")
    length = F.when(F.size("_redacted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(sent_in_parts(spark, docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    kept = ["doc_id", "lang", "source"]
    rows = bpe.checked_ids(sent_in_parts(spark, docs), kept, VOCABULARY, PATTERN)
    return rows.select(*kept, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]

#: Compression, sampling and BPE have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
