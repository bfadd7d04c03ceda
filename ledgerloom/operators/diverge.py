"""Divergence of sequences, vectors and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_difference(left: Column, right: Column) -> Column:
    """D14 on two arrays: the first index (from 0) at which they differ, their lengths included; null if equal."""
    both = F.arrays_zip(left.alias("l"), right.alias("r"))
    places = F.filter(F.transform(both, lambda x, i: F.when(~x["l"].eqNullSafe(x["r"]), i)), lambda i: i.isNotNull())
    return F.try_element_at(places, F.lit(1)).cast("long")


def layer_mismatches(reference: DataFrame, replay: DataFrame, key: str, layers: list[str]) -> DataFrame:
    """A row for each record and layer with whether it is equal; a record that one side lacks is equal in none."""
    r = replay.select(key, *(F.col(c).alias(f"__{c}") for c in layers), F.lit(True).alias("__there"))
    joined = reference.select(key, *layers, F.lit(True).alias("__here")).join(r, key, "full_outer")
    both = F.col("__here").isNotNull() & F.col("__there").isNotNull()
    return joined.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("layer"), (both & F.col(c).eqNullSafe(F.col(f"__{c}"))).alias("same")) for c in layers))))


def layered_equality(cells: DataFrame, key: str) -> DataFrame:
    """Per layer, how many records are equal and how many not, and the first that isn't."""
    return cells.groupBy("layer").agg(F.count_if("same").alias("equal"), F.count_if(~F.col("same")).alias("different"), F.min(F.when(~F.col("same"), F.col(key))).alias("first_mismatch"))


def delta_statistics(pairs: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """Per pair of vectors: elements, how many differ, largest delta and its first place, mean and RMS.

    Sums are of decimals, so no order of addition shows in the result.
    """
    cells = pairs.select(*key, F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("pos", "x"))
    delta = F.abs(F.col("x.l").cast("double") - F.col("x.r").cast("double"))
    rows = cells.select(*key, "pos", delta.alias("d"))
    total = lambda x: F.sum(x.cast("decimal(38,15)")).cast("double")
    out = rows.groupBy(*key).agg(
        F.count("*").alias("elements"), F.count_if(F.col("d") > 0).alias("n_different"), F.max("d").alias("max_delta"),
        F.max_by(F.col("pos"), F.struct(F.col("d"), -F.col("pos"))).alias("first_max"),
        F.min(F.when(F.col("d") > 0, F.col("pos"))).alias("first_different"), total(F.col("d")).alias("__sum"), total(F.col("d") * F.col("d")).alias("__squares"),
    )
    return out.select(*key, "elements", "n_different", "max_delta", F.col("first_max").cast("long").alias("first_max"), F.col("first_different").cast("long").alias("first_different"), F.round(F.col("__sum") / F.col("elements"), 9).alias("mean_delta"), F.round(F.sqrt(F.col("__squares") / F.col("elements")), 9).alias("rms_delta"))


def rounding_audit(updates: DataFrame, key: list[str], base: str, update: str, places: int) -> DataFrame:
    """Of the nonzero updates, how many survive rounding of base + update to a grid, and how many are lost."""
    cells = updates.select(*key, F.inline(F.arrays_zip(F.col(base).alias("b"), F.col(update).alias("u"))))
    grid = lambda x: F.floor(x.cast("double") * (1 << places) + 0.5)
    nonzero = F.col("u") != 0
    moved = grid(F.col("b").cast("double") + F.col("u").cast("double")) != grid(F.col("b"))
    return cells.groupBy(*key).agg(F.count_if(nonzero).alias("nonzero"), F.count_if(nonzero & moved).alias("effective"), F.count_if(nonzero & ~moved).alias("rounded_to_base"))


def first_divergent(modules: DataFrame, group: list[str], index: str, equal: str, size: str) -> DataFrame:
    """the first module that differs, whether all before it agree, and the ratio of the last delta to the first."""
    rows = modules.groupBy(*group).agg(
        F.min(F.when(~F.col(equal), F.col(index))).alias("first_index"), F.count_if(F.col(equal)).alias("n_equal"),
        F.min_by(F.when(~F.col(equal), F.col(size)), F.when(~F.col(equal), F.col(index))).alias("first_size"),
        F.max_by(F.when(~F.col(equal), F.col(size)), F.when(~F.col(equal), F.col(index))).alias("last_size"),
    )
    return rows.withColumn("growth", F.round(F.try_divide("last_size", "first_size"), 9))


def growth_by_stage(modules: DataFrame, group: list[str], index: str, equal: str, size: str) -> DataFrame:
    """every differing module with its size as a multiple of the first differing one's."""
    different = modules.where(~F.col(equal)).select(*group, index, size)
    first = different.groupBy(*group).agg(F.min_by(size, index).alias("__first"))
    return different.join(first, group).select(*group, index, F.round(F.try_divide(size, "__first"), 9).alias("growth"))


def delta_bounds(statistics: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Issues of delta statistics (elements, n_different, n_bitwise, nonzero, max_delta, mean_delta, rms_delta, witness) that can't be true together.

    Five bounds: mean <= rms <= max; no delta without a difference, and none with one of 0; differences among the bitwise ones; a witness's delta is at most the greatest; counts within the elements.
    """
    c = F.col
    issues = {
        "MEAN_OVER_RMS": c("mean_delta") > c("rms_delta") + tolerance, "RMS_OVER_MAX": c("rms_delta") > c("max_delta") + tolerance, "DELTA_WITHOUT_DIFFERENCE": (c("n_different") == 0) != (c("max_delta") == 0), "DIFFERENT_OVER_BITWISE": c("n_different") > c("n_bitwise"),
        "WITNESS_OVER_MAX": c("witness") > c("max_delta") + tolerance, "COUNT_OVER_ELEMENTS": (c("n_bitwise") > c("elements")) | (c("nonzero") > c("elements")),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in issues.items())))
    return statistics.withColumn("issues", found)


def epoch_orders(records: DataFrame, epochs: DataFrame, key: str, epoch: str, place: str) -> DataFrame:
    """per epoch, ids that are missing, unknown or repeated, and places that aren't 0..n-1; an epoch with none is a permutation.

    ``epochs``: one row for each epoch and place with the id that stands there.
    """
    known = records.select(key).distinct()
    n = known.agg(F.count("*").alias("__n"))
    seen = epochs.join(known.withColumn("__known", F.lit(True)), key, "left")
    per = seen.groupBy(epoch).agg(
        F.count_if(F.col("__known").isNull()).alias("unknown"), (F.count("*") - F.count_distinct(key)).alias("repeated"), F.count_distinct(F.when(F.col("__known"), F.col(key))).alias("__there"),
        (F.count("*") - F.count_distinct(F.when(F.col(place).between(0, F.lit(2**62)), F.col(place)))).alias("__same_place"), F.max(place).alias("__last"), F.count("*").alias("__rows"),
    )
    return per.crossJoin(F.broadcast(n)).select(epoch, (F.col("__n") - F.col("__there")).alias("missing"), "unknown", "repeated", ((F.col("__same_place") > 0) | (F.col("__last") != F.col("__rows") - 1)).alias("misplaced"))  # one row


def repeats_agree(runs: DataFrame, path: str, key: str, repeat: str, digest: str) -> DataFrame:
    """F8: per path, whether every key has one digest over all repeats."""
    keys = runs.groupBy(path, key).agg((F.count_distinct(digest) == 1).alias("same"), F.count_distinct(repeat).alias("repeats"))
    return keys.groupBy(path).agg(F.bool_and("same").alias("stable"), F.count("*").alias("keys"), F.min("repeats").alias("least_repeats"))


def rank_of(vectors: DataFrame, key: str, array: str) -> DataFrame:
    """rank of every element of its vector: 1 + how many are greater; positions from 0."""
    cells = vectors.select(key, F.posexplode(array).alias("pos", "value"))
    return cells.withColumn("rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc("value"))))


def discontinuities(runs: DataFrame, group: str, order: str, before: str, after: str) -> DataFrame:
    """runs that don't begin with what the previous one left."""
    last = F.lag(after).over(Window.partitionBy(group).orderBy(order))
    return runs.withColumn("previous_after", last).where(F.col("previous_after").isNotNull() & ~F.col("previous_after").eqNullSafe(F.col(before)))


def changed_fields(left: list[tuple[str, Column]], right: list[tuple[str, Column]]) -> Column:
    """I11 on flat structs: names of the fields that differ, in order."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for (name, a), (_, b) in zip(left, right, strict=True))))


def strictly_decreasing(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Per series: strictly decreasing, the step with the least value (lowest on ties), overfit at the end."""
    w = Window.partitionBy(*group).orderBy(order)
    steps = rows.withColumn("__previous", F.lag(value).over(w))
    out = steps.groupBy(*group).agg(F.bool_and(F.col("__previous").isNull() | (F.col("__previous") > F.col(value))).alias("decreasing"), F.min(F.struct(value, order)).alias("__least"), F.max_by(value, order).alias("last"))
    return out.select(*group, "decreasing", F.col(f"__least.{order}").alias("best_step"), F.col(f"__least.{value}").alias("best"), "last", (F.col("last") > F.col(f"__least.{value}")).alias("overfit"))
