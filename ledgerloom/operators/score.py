"""Scoring of predictions.

Defaults of empty denominators differ by metric and are written where they apply:
precision and recall 1.0, F1 0.0, macro-F1 of an absent class 1.0, false refusals 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float | None) -> Column:
    """top / bottom as a double, or ``empty`` where bottom is 0."""
    found = F.try_divide(top.cast("double"), bottom.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def confusion(scored: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """One row a label: tp, fp, fn over rows with gold and (perhaps null) predicted; absent labels are zero rows."""
    g, p = F.col(gold), F.col(predicted)
    counts = F.array(*(F.struct(F.lit(x).alias("label"), F.count_if(g.eqNullSafe(F.lit(x)) & p.eqNullSafe(F.lit(x))).alias("tp"), F.count_if(~g.eqNullSafe(F.lit(x)) & p.eqNullSafe(F.lit(x))).alias("fp"), F.count_if(g.eqNullSafe(F.lit(x)) & ~p.eqNullSafe(F.lit(x))).alias("fn")) for x in labels))
    return scored.agg(counts.alias("c")).select(F.inline("c"))


def macro_f1(table: DataFrame) -> DataFrame:
    """Mean of 2tp / (2tp + fp + fn); an absent class counts 1.0."""
    return table.agg(F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 1.0)).alias("macro_f1"))


def field_f1(scored: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 over (key, value) items of two maps; a null prediction misses all gold items."""
    g = F.map_entries(gold)
    p = F.coalesce(F.map_entries(predicted), F.array().cast("array<struct<key:string,value:string>>"))
    per_row = scored.select(F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))
    total = per_row.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return total.withColumns({"precision": precision, "recall": recall}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def rates(scored: DataFrame, **metrics: tuple[Column, Column, float | None]) -> DataFrame:
    """name = (counted, among, empty): the share of ``among`` rows that are counted."""
    out = []
    for name, (counted, among, empty) in metrics.items():
        top, bottom = F.count_if(among & counted), F.count_if(among)
        out += [top.alias(f"{name}_n"), bottom.alias(f"{name}_of"), ratio(top, bottom, empty).alias(name)]
    return scored.agg(*out)


def first_rule(*rules: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out


def unique_best(candidates: DataFrame, group: str, key: str, shared: str, union: str, least: tuple[int, int] = (1, 2)) -> DataFrame:
    """Section 2.G: the candidate with the highest shared/union, if it reaches ``least`` and is the only one.

    Fractions are compared as doubles, which are equal for equal fractions and different for different ones
    whose unions are below 2**26 (boxes of up to 4096 have less).  Two aggregates with partial sums, no join.
    """
    score = F.try_divide(F.col(shared).cast("double"), F.col(union).cast("double"))
    each = candidates.select(group, key, score.alias("__score"), (F.col(shared) * least[1] >= F.col(union) * least[0]).alias("__reaches"))
    counted = each.groupBy(group, "__score").agg(F.count("*").alias("ties"), F.min(key).alias("best"), F.first("__reaches").alias("reaches"))
    top = counted.groupBy(group).agg(F.max_by(F.struct("ties", "best", "reaches"), "__score").alias("t"))
    return top.select(group, F.when((F.col("t.ties") == 1) & F.col("t.reaches"), F.col("t.best")).alias("best"), F.col("t.ties").cast("long").alias("ties"))


def events_of_change(joined: DataFrame, key: str, dimensions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each (record, dimension) on which reference and candidate differ: regression or improvement."""
    cells = F.array(*(F.struct(F.lit(name).alias("dimension"), F.coalesce(r, F.lit(False)).alias("reference"), F.coalesce(c, F.lit(False)).alias("candidate")) for name, (r, c) in dimensions.items()))
    rows = joined.select(key, F.inline(cells))
    return rows.where("reference <> candidate").select(key, "dimension", F.when(F.col("reference"), "regression").otherwise("improvement").alias("event"))


def metric_deltas(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """Delta and class of each metric; a null on either side stays not_applicable."""
    delta = F.col(after) - F.col(before)
    kind = F.when(delta.isNull(), "not_applicable").when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("equal")
    return metrics.withColumns({"delta": delta, "class": kind})
