r"""Target-distribution importance resampling in Spark SQL (operator 13).

Documents are drawn so that their hashed n-grams resemble those of a target corpus.  The words of
a text are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased, its *features* all runs of
``widths`` consecutive words joined by one space, and a feature's bucket its crc32 modulo
``buckets``.  With S features of the raw corpus (s of them in the bucket) and T, t of the target,
a bucket's gain is ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``;
a document's weight is the sum of its features' gains.  Gumbel noise, a function of the seed and doc_id,
makes the highest scores a sample without replacement: ``score = weight + floor(-1000 * ln(-ln(u)))``.

Everything is DataFrame expressions.  N-gram arrays are exploded and counted by bucket with partial
sums, so the hottest word is ``tasks`` rows in the shuffle; the gain table has ``buckets`` rows,
which bounds what is broadcast; the sum of a document meets in the task that exploded it but for one
row.  Ranks come from one distributed sort: each sorted partition numbers its rows, and a prefix
sum over partitions gives where its numbers begin.  Ties of score and doc_id are parted by row, so
no value is one task's.

Null and empty texts and texts without words have no features, weight 0 and are not drawn while
``least_words`` is 1 or more.  Null doc_ids draw the noise of an empty id and come last among ties.
Repeated rows are documents of their own.  Texts of any length are read whole.  An empty table gives
no rows; an empty target counts as T = 0.  Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far

WIDTHS = (1, 1)
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() is the partition times this, plus the row's number in it.
PER_PARTITION = 1 << 33


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, widths: tuple[int, int] = WIDTHS) -> Column:
    """All runs of ``widths[0]`` to ``widths[1]`` consecutive words, joined by one space."""
    low, high = widths
    if not 1 <= low <= high:
        raise ValueError("widths are 1 or more")

    def runs(width: int) -> Column:
        if width == 1:
            return found
        starts = F.when(F.size(found) >= width, F.sequence(F.lit(1), F.size(found) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(found, i, width)))

    return runs(low) if low == high else F.concat(*(runs(w) for w in range(low, high + 1)))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all features of the column text."""
    exploded = texts.select(words(F.col("text")).alias("__words")).select(F.explode(features(F.col("__words"), widths)).alias("__feature"))
    return exploded.groupBy(bucket(F.col("__feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets, from the counts of both corpora."""
    total = lambda counts, name: counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    found = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    found = found.crossJoin(F.broadcast(total(raw, "S0"))).crossJoin(F.broadcast(total(target, "T0")))  # one row each
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (count("t") + 1) * (F.col("S0") + buckets) / ((count("s") + 1) * (F.col("T0") + buckets))
    return found.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scores(docs: DataFrame, target: DataFrame, widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document, then ``keep`` columns (they are part of the grouping: choose few)."""
    kept = [f"__keep{i}" for i in range(len(keep))]
    before = stored_so_far()
    raw, wanted = (stored(bucket_counts(df, widths, buckets), "bucket-counts") for df in (docs, target))  # each is read twice
    table = stored(gains(raw, wanted, buckets).withColumnRenamed("bucket", "__bucket"), "gains")
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").alias("__id"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), words(F.col("text")).alias("__words"))
    exploded = rows.select("__row", "__id", *kept, F.size("__words").cast("bigint").alias("__n"), F.explode_outer(features(F.col("__words"), widths)).alias("__feature"))
    weighed = exploded.join(F.broadcast(table), bucket(F.col("__feature"), buckets) == F.col("__bucket"), "left")
    summed = weighed.groupBy("__row", "__id", *kept, "__n").agg(F.count("__feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    found = stored(summed.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_words"), "n_features", "weight", (F.col("weight") + noise(F.col("__id"), seed)).alias("score"), *kept), "scores", "zstd")
    discard(docs.sparkSession, before, keep=[found])
    return found.withColumnsRenamed(dict(zip(kept, keep, strict=True))) if keep else found


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3... in the order given; rows that tie stand in any order.

    One range-partitioned sort, stored, so that a lost task can't deal the rows anew.
    """
    numbered = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie")
    sorted_rows = stored(dealt.withColumn("__place", F.monotonically_increasing_id()), "sorted", "zstd")
    part = F.floor(F.col("__place") / PER_PARTITION)
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.pmod(F.col("__place"), F.lit(PER_PARTITION)) + 1
    return sorted_rows.withColumn("__of", part).join(F.broadcast(starts), F.col("__of") == F.col("__part")).withColumn("rank", rank).drop("__of", "__part", "__start", "__place")


def resample(docs: DataFrame, target: DataFrame, widths: tuple[int, int] = WIDTHS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document, then ``keep`` columns.

    Of the N documents with ``least_words`` or more, the ``floor(percent * N / 100)`` highest scores are drawn, ties to the smaller doc_id.
    """
    kept = [f"__keep{i}" for i in range(len(keep))]
    found = scores(docs, target, widths, buckets, seed, keep)
    found = found.toDF(*found.columns[:5], *kept)
    enough = F.col("n_words") >= least_words
    drawn = found.where(enough).count() * percent // 100
    order = ranked(found.where(enough), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(found.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank", *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)))
