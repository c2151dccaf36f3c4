"""Insights and their evidence, stored together or not at all.

Both tables are written under a commit's name, and only then is the name added to the manifest that
both readers follow. A write that dies in between leaves files that nobody reads.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.insights import distinct_evidence
from ledgerspark.sources.tables import SCHEMAS


class Stored(NamedTuple):
    insights: DataFrame
    evidence: DataFrame


def _committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table's commits that the manifest names."""
    schema = f"{SCHEMAS[name]}, commit string"
    try:
        manifest = spark.read.schema("commit string").parquet(f"{root}/insight_commits")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(schema).parquet(f"{root}/{name}").join(manifest, "commit", "left_semi").drop("commit")


def read_insights(spark: SparkSession, root: str) -> Stored:
    return Stored(_committed(spark, root, "insights"), _committed(spark, root, "insight_evidence"))


def write_insights(spark: SparkSession, root: str, insights: DataFrame, evidence: DataFrame, between=None) -> DataFrame:
    """Adds insights that are new, with their distinct evidence; returns the refused ones with a reason.

    Refused: a stored id (``duplicate``), an id that the batch has before (``repeated``, by text), and a blank kind or
    text (``blank``). Evidence of refused insights is left out. ``between`` is called after the insights and
    before the evidence, for tests.
    """
    names = lambda t: [f.split()[0] for f in SCHEMAS[t].split(", ")]
    stored = read_insights(spark, root).insights.select("insight_id", F.lit(True).alias("__stored"))
    first = insights.groupBy("insight_id").agg(F.min_by(F.struct(*insights.columns), F.struct("text", "insight_kind")).alias("x"), F.count(F.lit(1)).alias("__n")).join(stored, "insight_id", "left")
    blank = (F.coalesce(F.trim("x.insight_kind"), F.lit("")) == "") | (F.coalesce(F.trim("x.text"), F.lit("")) == "")
    judged = first.withColumn("reason", F.when(F.col("__stored"), "duplicate").when(blank, "blank"))
    good = judged.where("reason IS NULL").select("x.*")
    commit = uuid.uuid4().hex
    good.select(*names("insights")).write.parquet(f"{root}/insights/commit={commit}")
    if between is not None:
        between()
    # what was written decides, as the store may have changed since
    kept = spark.read.parquet(f"{root}/insights/commit={commit}").select("insight_id")
    distinct_evidence(evidence).join(kept, "insight_id", "left_semi").select(*names("insight_evidence")).write.parquet(f"{root}/insight_evidence/commit={commit}")
    spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.mode("append").parquet(f"{root}/insight_commits")
    refused = judged.where("reason IS NOT NULL").select("insight_id", "reason")
    return refused.unionByName(judged.where("reason IS NULL AND __n > 1").select("insight_id", F.lit("repeated").alias("reason")))
