"""The corpus pipeline: five stages over documents, each a table that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm import lexical_packing, ngram_jaccard, quality_compression, secret_crf, template_decontamination
from ledgerspark.llm._tables import by_ids, give_back, kept, shared_folder, table
from ledgerspark.llm.queries import tokenizer_path

#: A document is rejected below this probability of good quality.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier takes for good."""
    model = quality_compression.fit(docs, table(spark, sf_dir, "labels"))
    give_back()  # the sample's texts, in the driver
    scored = quality_compression.score(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group linked by five-word shingles at 0.8; repeated rows of it once."""
    groups = ngram_jaccard.near_copies(docs, shingle=5, percent=80)
    copies = kept(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = by_ids(docs, copies, ["doc_id"], "left_anti")
    repeated = kept(left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    once = by_ids(left, repeated, ["doc_id"], "left_semi").withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__row = 1").drop("__row")
    return by_ids(left, repeated, ["doc_id"], "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    found = template_decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    texts = kept(found.select(F.col("text_hash").alias("__text_hash")).distinct(), "held")
    return by_ids(docs.withColumn("__text_hash", F.xxhash64("text")), texts, ["__text_hash"], "left_anti").drop("__text_hash")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts."""
    instead = {"text": F.col("masked"), "n_chars": F.char_length("masked").cast("bigint")}
    own = docs.select("text", F.struct(*(c for c in docs.columns if c not in instead)).alias("__own"))  # columns that the scan adds may have names of these
    field = secret_crf.fit(docs)
    give_back()  # the sample's windows, in the driver
    rows = secret_crf.scan(own, field)
    return rows.select(*(instead.get(c, F.col("__own").getField(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 ids."""
    return lexical_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: SQL cannot compress, join by segments or run the field.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
