"""Documents to training tokens, stage by stage.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. ``run`` applies them to ``documents``.

Defined results: columns other than those of documents are dropped at the first stage, so none can clash with a new one. A null or
empty text has no word and fails the rules; of rows that repeat an id with another text, each is judged by itself; of equal
rows, and of the documents of one group, that with the smallest id stays (the smallest text hash among equal ids; a group without
ids keeps one row too). Null languages and sources are values of their own. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import mixing, pii, quality, sentencepiece_bpe, simhash
from verbatlas.llm.common import DOC_COLS, table

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs.select(*DOC_COLS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.deduplicate(docs.select(*DOC_COLS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose personal data and the terms that disclose it."""
    return pii.sanitised(docs.select(*DOC_COLS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights of sources, languages and topics."""
    return mixing.sampled(docs.select(*DOC_COLS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return sentencepiece_bpe.encoded(docs.select(*DOC_COLS)).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; a test compares run() with a plain version.
ORACLE_SQL = None


def folder(spark: SparkSession) -> str:
    """A new folder in the place that the session names for written tables, which all executors share."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where and spark.sparkContext.master.startswith("local"):
        where = tempfile.mkdtemp(prefix="corpus-")
    return f"{where or spark.conf.get('spark.sql.warehouse.dir')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, docs = folder(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
