"""Closed contracts over JSON documents.

A rule is (code, path, condition that breaks it); :func:`violations` gives a row for every
broken rule and :func:`first_violation` the first in the order of the rules, which is what a
validator that stops at once reports.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Rule = tuple[str | Column, str | Column, Column]


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """A row for every broken rule, with its place in the list."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(k).alias("ordinal"), F.lit(code).alias("code"), F.lit(path).alias("location"))) for k, (code, path, broken) in enumerate(rules))))
    return df.select(key, F.inline(found))


def first_broken(rules: list[Rule]) -> Column:
    """Struct of code and location of the first broken rule, null if none is; a condition that is null isn't broken."""
    one = lambda code, path: F.struct(F.lit(code).cast("string").alias("code"), F.lit(path).cast("string").alias("location"))
    out = F.when(F.lit(False), one("", ""))
    for code, path, broken in rules:
        out = out.when(F.coalesce(broken, F.lit(False)), one(code, path))
    return out


def first_violation(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``code`` and ``location`` of the first broken rule of each row, null if none is."""
    return df.select(key, first_broken(rules).alias("found")).select(key, "found.code", "found.location")


def missing_fields(raw: Column, required: list[str]) -> Column:
    """Required top-level keys that a JSON object lacks (all, if it is none)."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))


def unknown_fields(raw: Column, allowed: list[str]) -> Column:
    """Top-level keys that the contract doesn't know, in order."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def is_strict_integer(raw: Column, path: str) -> Column:
    """The value at ``path`` of a VARIANT is an integer and no boolean."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(raw, path, "variant")).isin("BIGINT"), F.lit(False))


def has_duplicates(array: Column) -> Column:
    """C6."""
    return F.size(F.array_distinct(array)) < F.size(array)


def unsafe_path(path: Column) -> Column:
    """Not a plain relative path: empty, absolute, a drive, a backslash, or a ``.``, ``..`` or empty part."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return path.isNull() | (path == "") | path.contains("\\") | path.rlike("^[A-Za-z]:") | odd


def json_code(text: str | None) -> str | None:
    """A3: null for strict JSON, else DUPLICATE_JSON_KEY, NONFINITE_NUMBER or MALFORMED_JSON (null and empty texts too)."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise KeyError
        return dict(items)

    def constant(_: str):
        raise OverflowError

    try:
        json.loads(text or "", object_pairs_hook=pairs, parse_constant=constant)
    except KeyError:
        return "DUPLICATE_JSON_KEY"
    except OverflowError:
        return "NONFINITE_NUMBER"
    except (ValueError, RecursionError):
        return "MALFORMED_JSON"
    return None


@F.pandas_udf(StringType())
def strict_json_code(raw: pd.Series) -> pd.Series:
    """A3 as a column."""
    return raw.map(json_code)
