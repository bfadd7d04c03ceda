"""Split, family and identity audits.

Every audit lists all offenders; where a first offender is wanted, it is the least by the
order column, as rows of a DataFrame have no order of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalized, token_set
from ..sources.scratch import written_once


def exact_duplicates(records: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """records whose normalised text an earlier record has; ``previous`` is the first of them.

    The first of each text is an aggregate over its 256-bit digest, joined back, so a text that many share is no one task's.
    """
    marked = records.withColumn("__normal", F.unhex(F.sha2(normalized(F.col(text)), 256)))
    first = marked.groupBy("__normal").agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__normal", "__first")
    found = marked.join(first, "__normal").where((F.col(order) != F.col("__first.o")) | (F.col(key) != F.col("__first.k")))
    return found.withColumn("previous", F.col("__first.k")).drop("__normal", "__first")


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """D3, exact: every pair with a common token, and pairs of two empty token sets (similarity 1.0).

    An inverted index on tokens replaces the nested loop: tokens are made once a record, and
    pairs that share nothing are never formed.
    """
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        t = df.select(F.col(key).alias(key), token_set(F.col(text)).alias("t"))
        sides.append(t.select(key, "t", F.size("t").alias(f"{key}_n")))
    a, b = (s.select(k, f"{k}_n", F.explode("t").alias("token")) for s, k in zip(sides, (left_key, right_key), strict=True))
    shared = a.join(b, "token").groupBy(left_key, right_key, f"{left_key}_n", f"{right_key}_n").agg(F.count("*").alias("shared"))
    found = shared.withColumn("jaccard", jaccard(F.col("shared"), F.col(f"{left_key}_n"), F.col(f"{right_key}_n")))
    blank = [s.where(f"{k}_n = 0").select(k, F.lit("").alias("blank")) for s, k in zip(sides, (left_key, right_key), strict=True)]
    empties = blank[0].join(blank[1], "blank").select(left_key, right_key, F.lit(0).alias(f"{left_key}_n"), F.lit(0).alias(f"{right_key}_n"), F.lit(0).cast("long").alias("shared"), F.lit(1.0).alias("jaccard"))
    return found.unionByName(empties)


#: Tokens and item numbers of the smaller side are sent to the tasks up to this many (about 100 MB); beyond, both sides are joined.
MOST_SENT = 2_000_000
#: Postings of the smaller side that a task holds at a time (one token's list at least).
MOST_POSTINGS = 1 << 22


def similarity_summary(left: DataFrame, right: DataFrame, right_key: str, thresholds: list[float], text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """D3 without its pairs: for every right record that any left one shares a token with, the greatest similarity and how many are over each threshold.

    ``right_key``, max_jaccard, over_0, over_1, ... in the order of the thresholds.  A short right side goes to
    the tasks as an inverted index, so documents are read once and nothing of theirs is shuffled; a long one is joined.
    """
    items = right.select(right_key, token_set(F.col(text)).alias("t")).withColumn("n", F.size("t"))
    if items.agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).first()[0] > most_sent:
        pairs = similar_pairs(left.withColumn("__left", F.monotonically_increasing_id()), right, "__left", right_key, text)
        return pairs.groupBy(right_key).agg(F.max("jaccard").alias("max_jaccard"), *(F.count_if(F.col("jaccard") > x).alias(f"over_{k}") for k, x in enumerate(thresholds)))
    found = items.toArrow()
    keys, sizes = found.column(0).combine_chunks(), found.column(2).to_numpy().astype(np.int64)
    tokens = found.column(1).combine_chunks()
    vocabulary = pc.unique(tokens.flatten())
    of_token = pc.index_in(tokens.flatten(), vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(of_token, kind="stable")
    posting = np.repeat(np.arange(len(sizes)), sizes)[order]
    begin = np.searchsorted(of_token[order], np.arange(len(vocabulary) + 1))
    sent = left.sparkSession.sparkContext.broadcast((vocabulary, posting, begin, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, posting, begin, sizes = sent.value
        best, over, seen = np.zeros(len(sizes)), np.zeros((len(thresholds), len(sizes)), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
        step = max(1, (1 << 21) // max(1, len(sizes)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                lists = batch.column(0).slice(at, step)
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                place = pc.index_in(lists.flatten(), vocabulary).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(n)), n)[~np.isnan(place)]
                place = place[~np.isnan(place)].astype(np.int64)
                shared = np.zeros(len(n) * len(sizes), dtype=np.int64)
                before = np.concatenate([[0], np.cumsum(begin[place + 1] - begin[place])])
                low = 0
                while low < len(place):  # so many postings at a time, whatever the documents hold
                    high = max(low + 1, int(np.searchsorted(before, before[low] + MOST_POSTINGS, "right")) - 1)
                    some = place[low:high]
                    many = begin[some + 1] - begin[some]
                    cell = np.repeat(doc[low:high], many) * len(sizes) + posting[np.repeat(begin[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    found = np.bincount(cell)
                    shared[: len(found)] += found
                    low = high
                shared = shared.reshape(len(n), len(sizes))
                union = n[:, None] + sizes[None] - shared
                both_empty = union == 0
                jaccard = np.where(both_empty, 1.0, shared / np.maximum(union, 1))
                formed = (shared > 0) | both_empty
                seen |= formed.any(0)
                best = np.maximum(best, jaccard.max(0, initial=0.0))
                for k, x in enumerate(thresholds):
                    over[k] += (formed & (jaccard > x)).sum(0)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some]), *(pa.array(o[some]) for o in over)], names=["item", "max_jaccard", *(f"over_{k}" for k in range(len(thresholds)))])

    counts = [f"over_{k}" for k in range(len(thresholds))]
    partial = left.select(token_set(F.col(text)).alias("t")).mapInArrow(run, "item long, max_jaccard double, " + ", ".join(f"{c} long" for c in counts))
    summed = partial.groupBy("item").agg(F.max("max_jaccard").alias("max_jaccard"), *(F.sum(c).alias(c) for c in counts))
    names = left.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(len(sizes))), right_key: keys}))
    return summed.join(F.broadcast(names), "item").select(right_key, "max_jaccard", *counts)


def pairs_above(records: DataFrame, key: str, split: str, threshold: float, text: str = "text") -> DataFrame:
    """D3's gate, exact: pairs of different splits with similarity over ``threshold``.

    Equal token sets are one class (a 256-bit digest), and only classes are compared.  Tokens of a class are put
    in one order, the frequent ones last; a pair over the threshold must share a token among the first
    n - ceil(threshold * n) + 1 of either, sizes can't differ by more than the threshold allows, and the place of
    the first shared token bounds what is shared, so frequent tokens are hardly ever joined on.  What is left is
    compared on whole sets of token hashes, and the classes' members are put in at the end.
    Any order of all tokens gives the same pairs, so the counts of the most frequent ones alone go to the tasks, and only first tokens are shuffled.
    """
    # names of their own: the columns of the records may have any
    base = records.select(F.col(key).alias("__key"), F.col(split).alias("__split"), token_set(F.col(text)).alias("t")).where(F.size("t") > 0)
    base = base.select("__key", "__split", F.unhex(F.sha2(F.array_join(F.array_sort("t"), " "), 256)).alias("set"), F.array_sort(F.transform("t", lambda x: F.xxhash64(x))).alias("t"))
    # the texts are read twice, for the classes and for their members; all else reads these tables
    classes = written_once(base.groupBy("set").agg(F.any_value("t").alias("t")).withColumns({"n": F.size("t"), "id": F.monotonically_increasing_id()}), "token-sets")
    belonging = written_once(base.select("set", "__key", "__split"), "set-members").join(classes.select("set", "id"), "set").select("id", "__key", "__split")
    heads = _first_tokens(classes, threshold)
    a, b = (heads.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"p_{x}"), *(F.col(m).alias(f"{m}_{x}") for m in MARKS), "token") for x in ("a", "b"))
    most = 1 + F.least(F.col("n_a") - F.col("p_a") - 1, F.col("n_b") - F.col("p_b") - 1)
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")) & (most >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - most))
    # marks that differ are tokens that only one of the two has; a pair over the threshold can't have more of those than this
    apart = F.bit_count(F.col("m0_a").bitwiseXOR(F.col("m0_b"))) + F.bit_count(F.col("m1_a").bitwiseXOR(F.col("m1_b")))
    near &= apart <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6
    candidates = a.join(b, "token").where(near).select("a", "b", "n_a", "n_b").distinct()
    with_a = candidates.join(classes.select(F.col("id").alias("a"), F.col("t").alias("t_a")), "a")
    with_b = with_a.join(classes.select(F.col("id").alias("b"), F.col("t").alias("t_b")), "b")
    linked = with_b.withColumn("jaccard", jaccard(F.size(F.array_intersect("t_a", "t_b")), F.col("n_a"), F.col("n_b"))).where(F.col("jaccard") > threshold).select("a", "b", "jaccard")
    alike = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).where(F.lit(1.0) > threshold)
    both_ways = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(alike)
    members = lambda x: belonging.select(F.col("id").alias(x), F.col("__key").alias(f"key_{x}"), F.col("__split").alias(f"split_{x}"))
    found = both_ways.join(members("a"), "a").join(members("b"), "b").where(F.col("split_a") < F.col("split_b"))
    return found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "split_a", "split_b", "jaccard")


#: Tokens whose counts go to the tasks (16 bytes each); the rarer ones stand before them, by their hashes.
MOST_COUNTED = 1 << 19
#: Of each of 128 parts of the token hashes, whether the set holds an odd number of it.
MARKS = ("m0", "m1")


def _first_tokens(classes: DataFrame, threshold: float, most_counted: int = MOST_COUNTED) -> DataFrame:
    """id, n, marks, place and token of the first tokens of each class (id, n, t), the frequent ones last."""
    counts = classes.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = counts.orderBy(F.desc("df"), "token").limit(most_counted).toArrow()
    token, df = (known.column(c).to_numpy().astype(np.int64) for c in ("token", "df"))
    by_token = np.argsort(token)
    sent = classes.sparkSession.sparkContext.broadcast((token[by_token], df[by_token]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = sent.value
        for batch in batches:
            t = pc.list_flatten(batch.column("t")).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            count = np.zeros(len(t), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                count = np.where(known[at] == t, df[at], 0)
            order = np.lexsort((t, count, row))
            place = np.arange(len(t)) - start[row]
            first = place < (n - np.ceil(threshold * n).astype(np.int64) + 1)[row]
            odd = np.bincount(row * 128 + (t & 127), minlength=128 * len(n)).reshape(-1, 128) & 1
            marks = np.packbits(odd.astype(bool), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[first])), pa.array(n[row[first]].astype(np.int32)), *(pa.array(marks[row[first], k]) for k in range(2)), pa.array(place[first].astype(np.int32)), pa.array(t[order][first])], names=["id", "n", *MARKS, "place", "token"])

    return classes.select("id", "n", "t").mapInArrow(run, "id long, n int, m0 long, m1 long, place int, token long")


def member_check(families: DataFrame, records: DataFrame, key: str, agree: list[str]) -> DataFrame:
    """Family members against their records: ``missing``, or the names of fields that disagree."""
    there = records.select(key, *(F.col(c).alias(f"__{c}") for c in agree), F.lit(True).alias("__there"))
    joined = families.join(there, key, "left")
    differing = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in agree)))
    issue = F.when(F.col("__there").isNull(), F.array(F.lit("missing"))).otherwise(differing)
    return joined.select(*families.columns, issue.alias("issues")).where(F.size("issues") > 0)


def unmapped(records: DataFrame, families: DataFrame, key: str) -> DataFrame:
    """Records that no family names."""
    return records.join(families, key, "left_anti")


def crossing(groups: DataFrame, group: str, split: str) -> DataFrame:
    """H-1: groups that occur in more than one split, with the splits in order."""
    return groups.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def distribution_check(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose count differs from the expected grid, missing cells included."""
    counted = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    both = counted.join(expected, keys, "full_outer").select(*keys, F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.where("observed <> expected")


def coverage(df: DataFrame, column: str, required: list[str]) -> DataFrame:
    """E20, H-3, H-5: required values that are missing and observed ones that nobody asked for."""
    seen = F.collect_set(column)
    wanted = F.array(*map(F.lit, required))
    return df.agg(F.array_sort(F.array_except(wanted, seen)).alias("missing"), F.array_sort(F.array_except(seen, wanted)).alias("unexpected"))


def exclusion_hits(identities: DataFrame, registry: DataFrame, kind: str = "kind", value: str = "identity") -> DataFrame:
    """Identities that the registry excludes."""
    return identities.join(registry.select(kind, value).distinct(), [kind, value], "left_semi")


def pair_integrity(records: DataFrame, pair: str, variant: str, required: list[str], same: list[str]) -> DataFrame:
    """One row a pair: members, missing variants, and fields on which the members differ."""
    differing = F.array_compact(F.array(*(F.when(F.count_distinct(c) > 1, F.lit(c)) for c in same)))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.collect_set(variant)))
    return records.groupBy(pair).agg(F.count("*").alias("members"), missing.alias("missing"), differing.alias("differing"))


def prefix_mismatch(before: DataFrame, after: DataFrame, ordinal: str, digest: str) -> DataFrame:
    """whether ``before`` is an exact prefix of ``after``: counts, of mismatches too, and the first ordinal that differs (null: none)."""
    a = before.select(ordinal, F.col(digest).alias("__a"))
    joined = a.join(after.select(ordinal, F.col(digest).alias("__b")), ordinal, "full_outer")
    return joined.agg(
        F.count("__a").alias("n_before"), F.count("__b").alias("n_after"),
        F.count_if(F.col("__a").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_mismatched"), F.min(F.when(F.col("__a").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b")), F.col(ordinal))).alias("first_mismatch"),
    )


def split_of(key: Column) -> Column:
    """I17 on a running number: of each ten, the ninth is validation and the tenth eval."""
    return F.when(key % 10 == 8, "validation").when(key % 10 == 9, "eval").otherwise("train")
