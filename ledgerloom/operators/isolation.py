"""Isolation of splits by content identity.

Identities are rows of (split or key, kind, identity): one per record and kind, several where a
record has a list of them, so every check is an equi-join or an aggregate on (kind, identity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of identity that a registry holds, and what an id of the first two and a digest of the others look like.
KINDS = ("case_ids", "family_ids", "instruction_sha256", "observation_sha256", "candidate_sha256", "image_sha256")
NAMES = KINDS[:2]
IDENTIFIER, DIGEST = "[a-z0-9][a-z0-9._-]{0,127}", "(?:sha256:)?[0-9a-f]{64}"


def identities(records: DataFrame, keep: list[str], kinds: dict[str, Column]) -> DataFrame:
    """One row for each identity of each record; a kind may be a list; nulls have none."""
    types = dict(records.select(*(v.alias(k) for k, v in kinds.items())).dtypes)
    none = F.array().cast("array<string>")

    def cells_of(kind: str, value: Column) -> Column:
        values = value.cast("array<string>") if types[kind].startswith("array") else F.array(value.cast("string"))
        return F.transform(F.coalesce(values, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("identity")))

    cells = F.flatten(F.array(*(cells_of(k, v) for k, v in kinds.items())))
    return records.select(*keep, F.inline(cells)).where("identity is not null")


def overlaps(ids: DataFrame, split: str, left: list[str], right: list[str]) -> DataFrame:
    """H-2: kind and identity of what stands on both sides."""
    side = F.when(F.col(split).isin(*left), 1).when(F.col(split).isin(*right), 2)
    return ids.groupBy("kind", "identity").agg(F.count_if(side == 1).alias("left"), F.count_if(side == 2).alias("right")).where("left > 0 and right > 0").select("kind", "identity")


def isolation_report(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """H-2: one row a kind: how many identities overlap, the least of them, and whether there is none."""
    all_kinds = found.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = found.groupBy("kind").agg(F.count("*").alias("n"), F.min("identity").alias("first"))
    return F.broadcast(all_kinds).join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("overlaps"), "first", F.col("n").isNull().alias("passed"))


def registry_issues(registry: DataFrame) -> DataFrame:
    """H-6: kind, place and code of every registry row that isn't canonical: known kinds, sorted, distinct, well-formed.

    Each row (kind, place from 0 on, identity) is joined with the one before it, so no list is gathered.
    """
    before = registry.select("kind", (F.col("place") + 1).alias("place"), F.col("identity").alias("__before"))
    good = F.when(F.col("kind").isin(*NAMES), F.col("identity").rlike(rf"\A{IDENTIFIER}\z")).otherwise(F.col("identity").rlike(rf"\A{DIGEST}\z"))
    code = (
        F.when(~F.col("kind").isin(*KINDS), "EXCLUSION_REGISTRY_SHAPE_INVALID").when(F.col("__before") >= F.col("identity"), "EXCLUSION_REGISTRY_NOT_CANONICAL")
        .when(~F.coalesce(good, F.lit(False)), F.when(F.col("kind").isin(*NAMES), "EXCLUSION_ID_INVALID").otherwise("EXCLUSION_HASH_INVALID"))
    )
    return registry.join(before, ["kind", "place"], "left").withColumn("code", code).where("code is not null").select("kind", "place", "code")


def exclusion_collisions(ids: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Records and kinds that collide with the registry, over all kinds."""
    return ids.join(registry.select("kind", "identity").distinct(), ["kind", "identity"], "left_semi").select(key, "kind").distinct()
