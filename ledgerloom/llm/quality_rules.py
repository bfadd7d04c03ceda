"""Quality rules and a hashed n-gram log-likelihood ratio (operator 9).

Base rules are counted on the whole text: word_chars, n_symbols, n_dup_lines and
n_repeat_words.  The method's verdict compares two multinomials over hashed word unigrams
and bigrams: the *target*, counted on all trusted documents (label quality = 1), and the *raw*
corpus, counted on all documents.  A document's score is the sum of its n-grams' log ratios
divided by their number.  Every document with a score under the threshold is dropped, without
any randomness: the threshold stands midway between the mean scores of all trusted and all
untrusted documents of ten words or more (weights ``LEAN``), so it is a function of the data alone.

Counts are partial tables of ``BUCKETS`` numbers a task, so nothing that reaches the driver grows
with the corpus; labelled documents are found by a join, broadcast where the list of labels is short.  Null and empty texts have no words: all counts are 0, score 0.0, and base_failed is true.
Whole texts of any length are read.  Repeated rows get equal results, and count as often as they
stand.  An empty table gives no rows; extra columns are left alone.  Without labels of both
classes no document is dropped by the ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far
from .words import SPACES, U64, WordTable, mix, segment_sum, slices, windows, word_table

BUCKETS = 1 << 18
#: Where the threshold stands between the means of untrusted (0) and trusted (1) documents.
LEAN = 0.5
#: How many n-grams the raw model is worth in the target.
LEANING = 1000.0
#: Labels are broadcast up to this many (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SYMBOLS = b"#*$%&|<>"


def ngram_buckets(table: WordTable, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and every pair of neighbouring words."""
    pair, pair_doc, _ = windows(table, 2)
    h = np.concatenate([mix(table.hash ^ U64(0x5851F42D4C957F2D)), pair])
    return (h % U64(buckets)).astype(np.int64), np.concatenate([table.doc, pair_doc])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams by bucket over all texts: one partial table a task, then a sum by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(ngram_buckets(word_table(part.column(0), SPACES), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def scores(table: WordTable, ratio: np.ndarray) -> np.ndarray:
    bucket, doc = ngram_buckets(table, len(ratio))
    n = len(table.first) - 1
    count = np.bincount(doc, minlength=n)
    # sums in whole millionths: the same whatever else stands in the batch
    total = np.bincount(doc, np.rint(ratio[bucket] * 1e6), minlength=n)
    return total / 1e6 / np.maximum(count, 1)


def base_measures(part: pa.Array) -> tuple[WordTable, dict[str, np.ndarray]]:
    table = word_table(part, SPACES)
    n = len(table.first) - 1
    data, offsets = table.data, table.offsets
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[list(SYMBOLS)] = True
    symbol = np.concatenate([[0], np.cumsum(is_symbol[data])])
    lengths = leads[table.end] - leads[table.start]
    h, doc, first_word = windows(table, 5)
    order = np.lexsort((h, doc))
    again = np.zeros(len(h), dtype=bool)
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    cover = np.zeros(len(table.hash) + 6, dtype=np.int64)
    np.add.at(cover, first_word[again], 1)
    np.add.at(cover, first_word[again] + 5, -1)
    covered = (np.cumsum(cover)[: len(table.hash)] > 0).astype(np.int64)
    dup = np.zeros(n, dtype=np.int64)
    for k, text in enumerate(part.to_pylist()):
        if text and "\n" in text:
            seen: set[str] = set()
            for line in text.split("\n"):
                if line in seen:
                    dup[k] += 1
                elif line.strip(" \t\n\v\f\r"):
                    seen.add(line)
    return table, {
        "n_words": table.counts.astype(np.int64), "word_chars": segment_sum(lengths, table.first),
        "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]], "n_dup_lines": dup, "n_repeat_words": segment_sum(covered, table.first),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and quality of every labelled document; of several labels of one id, the least counts.

    Up to ``BROADCAST_IDS`` labels go to the documents; beyond, both are shuffled once, and what meets is stored.
    """
    known = stored(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")), "labels")
    texts = docs.select("doc_id", "text")
    if known.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(known), "doc_id").select("text", "quality")
    return stored(texts.join(known, "doc_id").select("text", "quality"), "labelled", "zstd")


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw by bucket; the target leans on the raw model, so buckets it hasn't seen say nothing."""
    raw_p = (raw + 1.0) / (raw.sum() + len(raw))
    return np.log((target + LEANING * raw_p) / (target.sum() + LEANING)) - np.log(raw_p)


def ratio_and_threshold(docs: DataFrame, labels: DataFrame, lean: float = LEAN, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    before = stored_so_far()
    known = labelled(docs, labels)
    target = bucket_counts(known.where("quality = 1"), buckets)
    if not target.sum():
        return np.zeros(buckets), -np.inf
    ratio = log_ratio(bucket_counts(docs, buckets), target)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                table = word_table(part.column(0), SPACES)
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(scores(table, sent.value) * 1e9).astype(np.int64)), part.column(1), pa.array(table.counts)], names=["score", "quality", "n_words"])

    # whole billionths, so no order of addition shows in the means
    scored = known.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "score long, quality int, n_words long").where("n_words >= 10 and quality in (0, 1)")
    mean = {r["quality"]: r["mean"] for r in scored.groupBy("quality").agg((F.sum(F.col("score").cast("decimal(38,0)")) / F.count("*")).cast("double").alias("mean")).collect()}
    discard(docs.sparkSession, before, keep=[])
    if len(mean) < 2:
        return ratio, -np.inf
    return ratio, float(np.round((lean * mean[1] + (1 - lean) * mean[0]) / 1e9, 9))


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), lean: float = LEAN, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns, the measures, score, base_failed and kept of every row."""
    ratio, threshold = ratio_and_threshold(docs, labels, lean, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    chosen = docs.select(*keep, docs["text"].alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in chosen.select(*keep).dtypes), *(f"{m} long" for m in MEASURES), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                table, found = base_measures(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(found[m]) for m in MEASURES), pa.array(scores(table, sent.value))], names=[*keep, *MEASURES, "score"])

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return chosen.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
