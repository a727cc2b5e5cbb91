"""A corpus pipeline: each stage takes what the one before it kept, written as Parquet between."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import decontam, jaccard, packing, quality, secrets
from cartulary.llm.common import shared_folder, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near duplicates: words of a shingle and hundredths of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: What stands for a secret in a kept text.
MASK = "[secret]"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules are learned from the documents given."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds a key of the row's id and text: ids may be null or repeated."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The least ``doc_id`` stays; of repeated rows one stays. Documents without words are in no
    group. Documents without an id are grouped with equal texts only.
    """
    linked = jaccard.link_documents(docs, NEAR_WORDS, NEAR_PERCENT, keep_key=True)
    alone = F.expr("n_shingles = 0 OR component_id IS NULL")
    group = F.when(alone, F.concat(F.lit("row "), F.col("row_key"))).otherwise(
        F.concat(F.lit("group "), F.col("component_id"))
    )
    # Nulls order first in a structure, so an id goes before a missing one by the extra field.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    stay = linked.groupBy(group.alias("name")).agg(first).select("first.row_key").distinct()
    kept = _keyed(docs).join(stay, "row_key", "left_semi")
    return kept.dropDuplicates(["row_key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    keyed = _keyed(docs)
    asked = keyed.select(F.col("row_key").alias("doc_id"), "text")
    found = decontam.find_contaminated(asked, table(spark, sf_dir, "benchmark"))
    hit = found.select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(hit, "row_key", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by ``MASK`` and counted anew."""
    found = secrets.scan_secrets(docs, MASK, keep=COLUMNS)
    text = F.col("masked").alias("text")
    n_chars = F.length("masked").cast("long").alias("n_chars")
    return found.select("doc_id", text, "lang", "source", n_chars)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents are packed into."""
    return packing.pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("packing", pack_documents),
]

#: The learned rules and the tokenizer have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
