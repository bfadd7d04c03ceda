"""JSON documents of any depth."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..functions import lexical
from . import walk
from .contracts import document


def all_keys(raw: Column) -> Column:
    """Every key of a document at any depth, distinct and sorted; none if it isn't JSON."""
    keys = F.transform(F.filter(lexical.tokens(raw), lexical.is_key), lexical.string_value)
    return F.when(document(raw).isNotNull(), F.array_sort(F.array_distinct(keys))).otherwise(F.array().cast("array<string>"))


def forbidden_keys(raw: Column, forbidden: list[str], fold_case: bool) -> Column:
    """The forbidden keys that occur, with or without regard to case."""
    found = all_keys(raw)
    return F.array_intersect(F.transform(found, F.lower) if fold_case else found, F.array(*map(F.lit, forbidden)))


def absolute_paths(df: DataFrame, key: str, raw: str) -> DataFrame:
    """String leaves that name an absolute path; addresses and digests don't."""
    leaves = walk.leaves(df, key, raw).withColumn("text", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))
    string = F.startswith("value", F.lit('"'))
    return leaves.where(string & F.col("text").rlike(r"^([A-Za-z]:[\\/]|/|\\\\)")).select(key, "path", "text")


def prefix_document(raw: Column) -> Column:
    """The first JSON value that begins at the first ``{`` of a model's answer, whatever follows; else null."""

    @F.pandas_udf(StringType())
    def first(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(text: str | None) -> str | None:
            at = (text or "").find("{")
            try:
                value, end = decoder.raw_decode(text, at) if at >= 0 else (None, 0)
            except (ValueError, RecursionError):
                return None
            return text[at:end] if isinstance(value, dict) else None

        return texts.map(one)

    return first(raw)


def first_difference(left: Column, right: Column) -> Column:
    """Path of the first place at which two documents differ, types and signed zeros told apart; null if they are equal.

    A side that is null or no JSON differs at ``$`` from everything but the same text.
    """

    @F.pandas_udf(StringType())
    def path_of(a: pd.Series, b: pd.Series) -> pd.Series:
        def differs(x, y, path: str) -> str | None:
            if type(x) is not type(y):
                return path
            if isinstance(x, dict):
                if x.keys() != y.keys():
                    return path
                return next((d for k in sorted(x) if (d := differs(x[k], y[k], f"{path}.{k}"))), None)
            if isinstance(x, list):
                if len(x) != len(y):
                    return path
                return next((d for k, (u, v) in enumerate(zip(x, y, strict=True)) if (d := differs(u, v, f"{path}[{k}]"))), None)
            return None if (x.hex() == y.hex() if isinstance(x, float) else x == y) else path

        def one(x: str | None, y: str | None) -> str | None:
            if x == y:
                return None
            try:
                return differs(json.loads(x or ""), json.loads(y or ""), "$")
            except (ValueError, RecursionError):
                return "$"

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return path_of(left, right)


def chained_digest(rows: DataFrame, group: str, order: str, header: str, payload: str) -> DataFrame:
    """One digest over a group's steps in order, header and payload each behind its length in eight bytes."""
    sized = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), F.to_binary(F.col(c), F.lit("utf-8")))
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(F.concat(sized(header), sized(payload))).alias("h"))))
    return rows.groupBy(group).agg(F.sha2(F.unhex(F.array_join(F.transform(steps, lambda s: s["h"]), "")), 256).alias("digest"))


def epoch_order(n: Column, seed: Column) -> Column:
    """The order in which a seeded shuffle of Python's generator puts n records."""

    @F.pandas_udf(ArrayType(LongType()))
    def order(counts: pd.Series, seeds: pd.Series) -> pd.Series:
        def one(count: int, start: int) -> list[int]:
            places = list(range(count))
            random.Random(start).shuffle(places)
            return places

        return pd.Series([one(int(c), int(s)) for c, s in zip(counts, seeds, strict=True)])

    return order(n, seed)
