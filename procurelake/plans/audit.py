"""Whole reports put together from operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions.text import bare
from procurelake.operators import collusion, rules
from procurelake.sources.docx import read_docx_facts


def audit_docx(spark: SparkSession, path: str, as_of: date, **scope: str) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts of all OOXML files under a path."""
    return rules.validate(read_docx_facts(spark, path), as_of, **scope)


def collusion_report(docs: DataFrame, prices: DataFrame | None = None, project_col: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Pairs (project, doc_a, doc_b, distance, verdict) and (project, ..., risk, skipped_short) of tenders."""
    fit = collusion.eligible(docs)
    pairs = collusion.all_pairs(collusion.simhash(fit, keep=(project_col,)), project_col)
    short = docs.groupBy(F.col(project_col).alias("__p")).agg(F.count_if(F.length(bare(F.coalesce("text", F.lit("")))) < collusion.MIN_CHARS).alias("skipped_short"))
    risk = collusion.project_risk(pairs, prices, project_col)
    full = short.join(risk, F.col("__p") == F.col(project_col), "left").drop(project_col).withColumnRenamed("__p", project_col)
    return pairs, full.fillna({"high": 0, "medium": 0, "max_distance": 0, "pattern": False, "risk": "LOW"})
