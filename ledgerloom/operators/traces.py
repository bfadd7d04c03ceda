"""Run traces, references and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_counts(events: DataFrame, run: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row a run, a zero-filled count for each kind."""
    return events.groupBy(run).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def any_of(condition: Column) -> Column:
    """True if any row fulfils it; false for no rows and for nulls."""
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def tags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))


def ordered(*fields: str, order: list[str], where: Column | None = None) -> Column:
    """The fields of a group's rows in the order of the order columns; only rows with ``where``."""
    row = F.struct(*order, *(F.col(f).alias(f"v_{f}") for f in fields))
    rows = F.array_sort(F.collect_list(row if where is None else F.when(where, row)))
    return F.transform(rows, lambda x: F.struct(*(x[f"v_{f}"].alias(f) for f in fields)))


def limit_hit(used: str, limit: str) -> Column:
    """A limit is hit if it is set (over 0) and used up."""
    return (F.col(limit) > 0) & (F.col(used) >= F.col(limit))


def sequence_gaps(rows: DataFrame, group: str, sequence: str, first: int = 1) -> DataFrame:
    """rows whose number isn't their place; ``expected`` is the place."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(sequence)) + (first - 1)
    return rows.withColumn("expected", place.cast("long")).where(F.col("expected") != F.col(sequence))


def completeness(events: DataFrame, run: str, sequence: str, event_count: str) -> DataFrame:
    """one row a run: run, expected (the greatest count that its events state), seen (distinct numbers from 1 on), first_missing (null: 1 to expected are all there, and no more)."""
    stated = events.groupBy(F.col(run).cast("string").alias("run")).agg(F.max(F.col(event_count).cast("long")).alias("expected"))
    once = events.where(F.col(sequence) >= 1).select(F.col(run).cast("string").alias("__run"), F.col(sequence).cast("long").alias("__n")).distinct()
    placed = once.withColumn("__place", F.row_number().over(Window.partitionBy("__run").orderBy("__n")).cast("long"))
    seen = placed.groupBy("__run").agg(F.count("*").alias("__seen"), F.min(F.when(F.col("__n") != F.col("__place"), F.col("__place"))).alias("__gap"))
    both = stated.join(seen, F.col("run").eqNullSafe(F.col("__run")), "left").withColumn("seen", F.coalesce("__seen", F.lit(0)).cast("long"))
    due = F.coalesce("__gap", F.col("seen") + 1)
    return both.select("run", "expected", "seen", F.when((due == F.col("expected") + 1) & F.col("__gap").isNull(), None).otherwise(due).cast("long").alias("first_missing"))


def range_gaps(rows: DataFrame, group: str, start: str, size: str) -> DataFrame:
    """byte ranges that don't begin where the one before ended (0 for the first)."""
    before = Window.partitionBy(group).orderBy(start)
    expected = F.coalesce(F.lag(F.col(start) + F.col(size)).over(before), F.lit(0))
    return rows.withColumn("expected_start", expected.cast("long")).where(F.col("expected_start") != F.col(start))


def reference_issues(edges: DataFrame, nodes: DataFrame, ref: str, key: str, role: str, expected: str) -> DataFrame:
    """References to nothing, or to a node of another role than expected."""
    there = nodes.select(F.col(key).alias(ref), F.col(role).alias("__role"), F.lit(True).alias("__there"))
    joined = edges.join(there, ref, "left")
    issue = F.when(F.col("__there").isNull(), "UNKNOWN_ARTIFACT_REF").when(~F.col("__role").eqNullSafe(F.col(expected)), "ARTIFACT_ROLE_MISMATCH")
    return joined.withColumn("issue", issue).where("issue is not null").drop("__role", "__there")


def orphans(nodes: DataFrame, edges: DataFrame, key: str, ref: str) -> DataFrame:
    """Nodes that nothing refers to."""
    return nodes.join(edges.select(F.col(ref).alias(key)), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side alone; the sets are equal if there is none."""
    a, b = (df.select(*keys).distinct().withColumn(name, F.lit(True)) for df, name in ((left, "__l"), (right, "__r")))
    side = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "unexpected")
    return a.join(b, keys, "full_outer").withColumn("issue", side).where("issue is not null").select(*keys, "issue")


def outside_window(rows: DataFrame, steps: list[str]) -> DataFrame:
    """Rows whose times don't follow each other in the order of ``steps``; names the first step that is early."""
    issue = F.coalesce(*(F.when(F.col(b) < F.col(a), F.lit(f"{b} before {a}")) for a, b in zip(steps, steps[1:], strict=False)))
    return rows.withColumn("issue", issue).where("issue is not null")


def illegal_states(rows: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose combination of values isn't in the allowed table (small by nature)."""
    return rows.join(F.broadcast(allowed), columns, "left_anti")
