"""Scores over findings: weighted density, health, grades, pillar status, delta and counterfactual accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import js_round

#: Weights of severities and bounds of grades.
HEALTH_WEIGHTS = {"CRITICAL": 8, "HIGH": 4, "MEDIUM": 2}
SLOP_WEIGHTS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2}
GRADES = [(95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D")]
DENSITY_SCALE = 1.5
CHARS_PER_LINE = 36
CHARS_PER_TOKEN = 3.8


def severity_weight(severity: Column, weights: dict[str, int]) -> Column:
    """Weight of a severity; others weigh 1."""
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def density_score(density: Column) -> Column:
    """Score 0 to 100 of a weighted density of findings."""
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(100 - DENSITY_SCALE * density)))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def health(findings: DataFrame, files: DataFrame, by: list[str], weights: dict[str, int] = HEALTH_WEIGHTS) -> DataFrame:
    """Score and grade per group: weight of ``findings`` (severity and the group columns) over the files of ``files``.

    Groups without findings score 100; findings of groups without files are left out.
    """
    n = files.groupBy(*by).agg(F.count("*").alias("n_files"))
    w = findings.groupBy(*by).agg(F.sum(severity_weight(F.col("severity"), weights)).alias("weight"))
    out = n.join(w, by, "left").withColumn("density", F.coalesce("weight", F.lit(0)) / F.greatest(F.lit(1), "n_files"))
    return out.withColumn("score", density_score(F.col("density"))).withColumn("grade", grade(F.col("score")))


def pillar_status(findings: DataFrame, pillars: DataFrame) -> DataFrame:
    """Counts by severity and status of every pillar of ``pillars``, those without findings included."""
    n = lambda s: F.coalesce(F.count_if(F.col("severity") == s), F.lit(0)).alias(s.lower())
    counted = findings.groupBy("pillar").agg(F.count("*").alias("n"), n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"))
    out = pillars.join(counted, "pillar", "left").fillna(0)
    status = F.when(F.col("critical") > 0, "FAILED").when((F.col("high") > 0) | (F.col("medium") > 1), "WARN").otherwise("PASSED")
    return out.withColumn("status", status)


def estimate_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(chars / 4)


#: Kinds of counterfactual whose characters count.
MEASURED_KINDS = ["file-whole", "raw-output"]


def account_calls(calls: DataFrame, by: list[str]) -> DataFrame:
    """Counterfactual accounting of tool calls per group: estimates from summed characters, never summed estimates."""
    measured = F.col("cf_kind").isin(*MEASURED_KINDS)
    some = lambda c: F.coalesce(F.sum(F.when(measured, F.col(c))), F.lit(0))
    sums = calls.groupBy(*by).agg(
        F.count("*").alias("n_calls"), F.count_if(measured).alias("n_measured"), F.sum("result_chars").alias("chars"),
        some("result_chars").alias("measured_chars"), some("cf_chars").alias("cf_chars"),
        F.coalesce(F.sum(F.when(F.col("cf_kind") == "validation-call", F.col("cf_calls"))), F.lit(0)).alias("avoided"),
    )
    gross = estimate_tokens(F.col("cf_chars")) - estimate_tokens(F.col("measured_chars"))
    plain = estimate_tokens(F.col("chars") - F.col("measured_chars"))
    return sums.select(
        *by, "n_calls", "n_measured", estimate_tokens(F.col("chars")).alias("overhead_tokens"), gross.alias("gross_saved"), plain.alias("unmeasured_tokens"),
        (gross - plain).alias("net_saved"), "avoided", ((F.col("n_measured") > 0) & (F.col("n_measured") < 5)).alias("is_thin"),
    )
