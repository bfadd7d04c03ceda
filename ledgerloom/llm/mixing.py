r"""Mixing sources to target weights by systematic sampling (operator 8).

A document is worth ``target / source_size`` expected copies.  Within a source the
expected copies are prefix-summed, one offset (a hash of seed and source name) is added,
and a document is emitted once for each integer boundary that its interval crosses, so
it gets floor or ceiling of its expectation and never more than ``most`` copies.
Documents stand in the order of their sizes: the words taken then differ from the target
by about one large document at most.

The prefix sum never gathers a source in one task.  A document's rank is the sum of three
parts: documents of smaller size (a running count over the source's distinct sizes), those
of the same size in lower salts (a running count over salts), and its row number among
those of its own size and salt.  There are about as many salts (doc_id modulo
their number) as the square root of the rows, so even a group of a third of all rows is
neither one long salt nor a long list of salts.  Where many rows have one id (or none), a salt
can still be long: groups of more than ``HOT`` rows are ranked by id and by part of an id, the
parts being runs of row numbers.  Either way rows stand by id and then by row number, so that
bound changes how a place is worked out, and no place.

Sizes count ``[^\x20\x09-\x0D]+`` in the text (null: 0).  A null source is a source, last
in order.  Repeated rows are documents of their own; an empty table gives no rows.  Texts of any
length are counted whole, and extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Rows of one source, size and salt that are ranked in one task; more are ranked in parts.
HOT = 1_000_000


def word_count(text: str = "text"):
    return F.coalesce(F.expr(rf"regexp_count({text}, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, target (double).

    Targets are weight * level, stopping at most * size; the level at which the targets
    add up to the whole is read off the sources in the order of most * size / weight:
    the first at which sharing what the earlier ones leave puts it below its own stop.
    Sources are few (a corpus names them), so these windows run over one short list.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(position, F.lit(len(weights))) + 1).cast("int"))
    weighed = named.withColumn("weight", weight).withColumn("stop", (F.col("source_size") * most).cast("long"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.withColumns({
        "words_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(earlier), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    })
    level = F.try_divide(F.col("words_left").cast("double"), F.col("weight_left").cast("double"))
    ranked = left.withColumn("level", F.when(level * F.col("weight") <= F.col("stop"), level))
    first = ranked.withColumn("first", F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("stop") / F.col("weight")).alias("at"), F.col("source").isNull().alias("unnamed"), "source", "level"))).over(everything)["level"])
    target = F.least(F.col("stop").cast("double"), F.col("weight") * F.coalesce("first", F.lit(0.0)))
    return first.select("source", "source_size", target.alias("target"))


def ranked_in_parts(rows: DataFrame, most: int) -> DataFrame:
    """``__own``: the place of each row among those of its source, size and salt, by doc_id; no window holds more than ``most`` rows of one id."""
    key = ["source", "size", "salt", "doc_id"]
    parted = rows.withColumn("__part", F.floor(F.col("__number") / most))
    counts = parted.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").withColumnsRenamed({c: f"__{c}" for c in key}).withColumnRenamed("__part", "__of")
    within = Window.partitionBy(*key, "__part").orderBy("__number")
    placed = parted.withColumn("__within", F.row_number().over(within) - 1)
    match = F.col("__part") == F.col("__of")
    for c in key:
        match &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.join(starts, match).withColumn("__own", (F.col("__start") + F.col("__within")).cast("int")).select(*rows.columns, "__own")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every document, then ``keep`` columns (kept through the shuffles: choose few)."""
    kept = [f"__keep{i}" for i in range(len(keep))]  # whatever their names are
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.monotonically_increasing_id().alias("__number")), "sizes")
    totals = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    salts = max(31, math.isqrt(sized.count()))
    salt = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(salts)).cast("int")
    salted = sized.withColumn("salt", salt)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    smaller = totals.select("source", "size", F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("size"))), F.lit(0)).alias("smaller"))
    counts = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    lower = counts.select("source", "size", "salt", F.coalesce(F.sum("n").over(before(Window.partitionBy("source", "size").orderBy("salt"))), F.lit(0)).alias("lower"))
    targets = source_targets(sized, weights, most)
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    large = F.broadcast(counts.where(F.col("n") > hot).select(F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("salt").alias("__salt")))  # at most rows / hot of them
    is_large = F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("salt") == F.col("__salt"))
    group = Window.partitionBy("source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "__number")
    ranked = salted.join(large, is_large, "left_anti").withColumn("__own", F.row_number().over(group) - 1)
    ranked = ranked.unionByName(ranked_in_parts(salted.join(large, is_large, "left_semi"), hot)).drop("__number")
    placed = ranked.alias("d").join(lower.alias("l"), same(ranked, lower, ["source", "size", "salt"])).select("d.*", "lower")
    placed = placed.alias("p").join(F.broadcast(targets.withColumnRenamed("source", "name")), F.col("p.source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.join(smaller.withColumnsRenamed({"source": "name", "size": "of"}), F.col("source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("of"))).drop("name", "of")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\0")))), 1, 4), 16, 10).cast("double") / 65536
    expected = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    rank = F.col("smaller") + F.col("lower") + F.col("__own")
    copies = F.least(F.floor((rank + 1) * expected + offset) - F.floor(rank * expected + offset), F.lit(most)).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))


def mix_sql(documents: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """DuckDB SQL for doc_id, size, source_size, target and taken."""
    return rf"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size from {documents}
), named as (
  select source, sum(size)::bigint as source_size, ([{", ".join(map(str, weights))}])[((row_number() over (order by source nulls last) - 1) % {len(weights)} + 1)::int] as weight from sized group by source
), stopped as (
  select *, source_size * {most} as stop, row_number() over (order by source_size * {most} / weight::double, source nulls last) as k from named
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(stop) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by k rows between unbounded preceding and 1 preceding), 0))::double as level from stopped
), targets as (
  select source, source_size, least(stop::double, weight * coalesce((select arg_min(level, k) from levels where level * weight <= stop), 0.0)) as target from levels
), ranked as (
  select d.*, t.source_size, t.target,
    row_number() over (partition by d.source order by size, ((coalesce(doc_id, 0) % s.n) + s.n) % s.n, doc_id nulls first) - 1 as r,
    coalesce(t.target / nullif(t.source_size::double, 0), 0.0) as c,
    ('0x' || substr(md5('{seed}:' || coalesce(d.source, chr(0))), 1, 4))::bigint::double / 65536 as u
  from sized d join targets t on d.source is not distinct from t.source, (select greatest(31, floor(sqrt(count(*)))::bigint) as n from sized) s
)
select doc_id, size, source_size, target, (least(floor((r + 1) * c + u) - floor(r * c + u), {most})::bigint * size)::bigint as taken from ranked
"""
