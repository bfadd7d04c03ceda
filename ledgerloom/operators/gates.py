"""Gates, manifests and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(expected: DataFrame, observed: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Files by path: missing, unexpected, or the first field (name, issue) that differs."""
    o = observed.select(key, *(F.col(c).alias(f"__{c}") for c, _ in fields), F.lit(True).alias("__o"))
    joined = expected.select(key, *(c for c, _ in fields), F.lit(True).alias("__e")).join(o, key, "full_outer")
    issue = F.when(F.col("__o").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
    for c, name in fields:
        issue = issue.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), name)
    return joined.select(key, issue.alias("issue")).where("issue is not null")


def requirements(gates: DataFrame, group: list[str], gate: str, passed: str) -> DataFrame:
    """Eligible if all gates passed (null: not), with the blockers in order."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return gates.groupBy(*group).agg(F.bool_and(ok).alias("eligible"), F.array_sort(F.collect_list(F.when(~ok, F.col(gate)))).alias("blockers"))


def first_failure(gates: list[tuple[str, Column]], passed: str) -> Column:
    """The class of the first gate that fails, or ``passed``."""
    out = F.when(F.lit(False), F.lit(""))
    for name, ok in gates:
        out = out.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(passed))


def within_caps(rows: DataFrame, value: str, cap: str) -> DataFrame:
    """Used share of the cap and whether it is within."""
    return rows.withColumns({"used": F.round(F.try_divide(value, cap), 9), "within": F.coalesce(F.col(value) <= F.col(cap), F.lit(False))})


def classified(rows: DataFrame, kind: Column, key: str) -> DataFrame:
    """The class of every record, one row each."""
    return rows.select(key, kind.alias("class"))


def taxonomy(classes: DataFrame, key: str) -> DataFrame:
    """Records of each class and the first of them; which they are, :func:`classified` says row by row."""
    return classes.groupBy("class").agg(F.count("*").alias("n"), F.min(key).alias("first"))
