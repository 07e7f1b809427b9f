"""The status algebra: how gate records become one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE_RESULTS = "subject string, gate string, status string, message string, evidence string"


def ok(status: Column) -> Column:
    return status == "PASS"


def is_divergence(status: Column) -> Column:
    return status.isin("FAIL", "UNDECL")


def verdict(status: Column) -> Column:
    """An aggregate over a subject's gates, in this order: any FAIL; any UNDECL (spelled UNDECLARED); nothing that
    passed (INCONCLUSIVE); anything but PASS and N/A (PARTIAL); else PASS."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return F.when(some(status == "FAIL"), "FAIL").when(some(status == "UNDECL"), "UNDECLARED").when(~some(status == "PASS"), "INCONCLUSIVE").when(some(~status.isin("PASS", "N/A") | status.isNull()), "PARTIAL").otherwise("PASS")


def fold(results: DataFrame, *by: str) -> DataFrame:
    """One row a subject: verdict, counts and the lists of failed and undeclared gates, by name."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("gate"))))
    got = results.groupBy(*(by or ("subject",))).agg(verdict(F.col("status")).alias("status"), F.count(F.lit(1)).alias("n_gates"), names("FAIL").alias("failed_gates"), names("UNDECL").alias("undeclared_gates"))
    return got.withColumn("divergences", F.concat("failed_gates", "undeclared_gates"))
