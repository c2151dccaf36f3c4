"""Insights with their evidence, and the check of figures in generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """One row per insight, kind and evidence: the lowest ordinal."""
    return evidence.groupBy("insight_id", "kind", "evidence_id").agg(F.min("ordinal").alias("ordinal"))


def live(insights: DataFrame, kind: str | None = None) -> DataFrame:
    rows = insights.where("dismissed_at IS NULL")
    return rows if kind is None else rows.where(F.col("insight_kind") == kind)


def citing(insights: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Insights that cite any of the records (kind, evidence_id)."""
    ids = evidence.join(records, ["kind", "evidence_id"], "left_semi").select("insight_id").distinct()
    return insights.join(ids, "insight_id", "left_semi")


def with_evidence(insights: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each insight with its evidence, ordered, as kind:id."""
    lists = evidence.groupBy("insight_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "evidence_id", "kind"))).alias("e"))
    lists = lists.select("insight_id", F.transform("e", lambda x: F.concat(x["kind"], F.lit(":"), x["evidence_id"])).alias("evidence"))
    return insights.join(lists, "insight_id", "left")


def dangling_evidence(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Evidence whose record (kind, evidence_id) is in no table."""
    return evidence.join(ids, ["kind", "evidence_id"], "left_anti")


def checked(insights: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A detector's insights that cite something, and those that cite nothing."""
    cited = evidence.select("insight_id").distinct()
    return insights.join(cited, "insight_id", "left_semi"), insights.join(cited, "insight_id", "left_anti")


def dismiss(insights: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets dismissed_at (changes: insight_id, at) where not set yet; the first of several times counts."""
    first = changes.groupBy("insight_id").agg(F.min("at").alias("__at"))
    return insights.join(first, "insight_id", "left").withColumn("dismissed_at", F.coalesce("dismissed_at", "__at")).drop("__at")


def unsupported_figures(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """insight_id, figure: numbers in a text that its fact pack (insight_id, figure) does not hold."""
    figures = texts.select("insight_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:,\d+)*(?:\.\d+)?"), F.lit(0))).alias("figure"))
    return figures.withColumn("figure", F.regexp_replace("figure", ",", "")).distinct().join(facts, ["insight_id", "figure"], "left_anti")


