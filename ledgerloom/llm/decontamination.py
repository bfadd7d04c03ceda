"""Benchmark decontamination on a distributed positional inverted index (operator 10).

:func:`build_index` turns runs of training documents into index blocks, one row each: the
documents of the block and, for every term in it, the sorted word positions at which it stands.
It knows nothing of benchmarks: the stored table is the index of the training data and can be
searched by any number of them.

:func:`matches` searches it with tables only, whatever their sizes; nothing of the benchmark
passes the driver.  Every distinct window of the items is a row.  The index tells how often each
of their terms occurs in the whole corpus, so each window has its terms from the rarest on, and
goes to the blocks that have its ``PROBED`` rarest terms; one without postings for them fits
nowhere.  There the block's postings of terms that the benchmark has and its windows are
co-located by a shuffle and streamed, the postings before the windows: those of the rarest term give candidate starts (position minus the term's offset in the
window), and the offset-adjusted lists of the other terms are intersected, rarest first.  What is
left are the exact phrase matches; with ``slop`` the other terms may stand up to so many words
away from their place in the same document (proximity matches; a window may then begin or end
beyond the document, and its span is cut there).

Terms are 64-bit hashes (:func:`.words.word_hashes`: words of up to eight bytes and equal length
never collide), so a false exact match of a window takes as many chance collisions as the window
has words.

Null and empty texts have no words; texts without words are no windows and are never hit.  Null
item ids are written as ``null``; repeated items count once; repeated documents get equal results;
one very long document is a block of its own; a null doc_id is a document like any other.  Empty tables give no rows, or no hits.  Extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far
from .words import PUNCTUATION, slices, word_table

WIDTH = 13
#: Index blocks (about a megabyte of text each) a shuffle partition of the search.
BLOCKS_A_PARTITION = 32
#: A window goes to blocks that have so many of its rarest terms.
PROBED = 3
BLOCK = "block long, n_docs long, doc_ids binary, nulls binary, first binary, terms array<long>, steps array<binary>"
HEADER, POSTINGS, WINDOW = 0, 1, 2


def build_index(docs: DataFrame) -> DataFrame:
    """Index blocks of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            for part in slices(batch, "text"):
                table = word_table(part.column(1), PUNCTUATION, lower=True)
                h = table.hash.view(np.int64)
                order = np.argsort(h, kind="stable")
                terms, begin = np.unique(h[order], return_index=True)
                steps = np.diff(order, prepend=0)
                steps[begin] = order[begin]
                steps, ends = steps.astype("<i4"), np.append(begin, len(order)).astype(np.int32) * 4
                ids = part.column(0)
                cells = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), table.first.astype(np.int64)]
                one = pa.array([0, len(terms)], pa.int32())
                lists = [pa.ListArray.from_arrays(one, pa.array(terms)), pa.ListArray.from_arrays(one, pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(steps.tobytes())]))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([part.num_rows]), *(pa.array([c.tobytes()], pa.binary()) for c in cells), *lists], names=["block", "n_docs", "doc_ids", "nulls", "first", "terms", "steps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def stored_index(docs: DataFrame) -> DataFrame:
    return stored(build_index(docs), "postings", "zstd")


def documents_of(index: DataFrame) -> DataFrame:
    """block, row, doc_id, n_words of every indexed document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n), pa.array(np.arange(n)), ids, pa.array(np.diff(np.frombuffer(row["first"], np.int64)))], names=["block", "row", "doc_id", "n_words"])

    return index.select("block", "n_docs", "doc_ids", "nulls", "first").mapInArrow(run, "block long, row long, doc_id long, n_words long")


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, terms: every distinct window of every item (fewer than ``width`` terms: the whole item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                table = word_table(part.column(1), PUNCTUATION, lower=True)
                items, terms = [], []
                for name, a, b in zip(part.column(0).to_pylist(), table.first[:-1], table.first[1:], strict=True):
                    n = min(width, b - a)
                    if n:
                        own = np.lib.stride_tricks.sliding_window_view(table.hash[a:b], n).view(np.int64)
                        items += [name] * len(own)
                        terms += list(own)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return named.mapInArrow(run, "item string, terms array<long>").distinct()


def find_in_block(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first: np.ndarray, wanted: np.ndarray, offsets: np.ndarray, size: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of ``wanted``), the documents they are in, and the word positions where they start.

    ``wanted`` holds each window's terms from the rarest on and ``offsets`` their places in the window.
    """
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(wanted):
        return none, none, none
    real = np.arange(wanted.shape[1]) < size[:, None]
    place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    possible = np.flatnonzero(((terms[place] == wanted) | ~real).all(1))
    place, real, offsets, size = place[possible], real[possible], offsets[possible], size[possible]
    begin = np.concatenate([[0], np.cumsum(counts)])
    n_seen = counts[place[:, 0]] if len(possible) else none
    window = np.repeat(np.arange(len(possible)), n_seen)
    at = np.arange(len(window)) - np.repeat(np.cumsum(n_seen) - n_seen, n_seen)
    seen = positions[begin[place[window, 0]] + at]
    doc = np.searchsorted(first, seen, "right") - 1
    start = seen - offsets[window, 0]
    low, high = first[doc], first[doc + 1] - 1
    if not slop:
        fits = (start >= low) & (start + size[window] - 1 <= high)
        window, doc, start, low, high = (x[fits] for x in (window, doc, start, low, high))
    n = int(first[-1]) + 1
    keys = np.repeat(np.arange(len(terms)), counts) * n + positions
    for step in range(1, wanted.shape[1]):
        if not len(window):
            break
        base = place[window, step] * n
        expected = start + offsets[window, step]
        # the first posting from the earliest allowed place on is the only one that needs a look
        nearest = np.searchsorted(keys, base + np.maximum(expected - slop, low))
        found = keys[np.minimum(nearest, len(keys) - 1)]
        good = (nearest < len(keys)) & (found >= base) & (found <= base + np.minimum(expected + slop, high)) | ~real[window, step]
        window, doc, start, low, high = (x[good] for x in (window, doc, start, low, high))
    return possible[window], doc, start


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans joined; sorted."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def rarest_first(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """window, size, terms and offsets (rarest in the corpus first) of windows whose terms all occur."""
    each = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    often = postings.groupBy("term").agg(F.sum("n").alias("n"))
    known = each.join(often, "term").groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("found"))
    return known.where(F.size("found") == F.col("size")).select("window", "size", F.col("found.term").alias("terms"), F.col("found.offset").alias("offsets"))


def windows_by_block(postings: DataFrame, ordered: DataFrame) -> DataFrame:
    """block, window: where the window's ``PROBED`` rarest terms all are."""
    directory = postings.select("block", "term")
    found = ordered.select("window", "size", "terms").withColumn("term", F.element_at("terms", 1)).join(directory, "term").select("block", "window", "size", "terms")
    for k in range(2, PROBED + 1):
        there = directory.withColumnsRenamed({"block": "there", "term": "next"})
        short = F.col("size") < k
        found = found.where(short).unionByName(found.where(~short).join(there, (F.col("block") == F.col("there")) & (F.element_at("terms", F.lit(k)) == F.col("next")), "left_semi"))
    return found.select("block", "window")


def _matrix(column: pa.Array, size: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def matches(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """block, row, start, end of the spans hit (merged where they touch); and block, row, item."""
    owned = stored(item_windows(benchmark, width).withColumns({"w1": F.xxhash64("terms"), "w2": F.xxhash64(F.reverse("terms"), F.size("terms"))}), "windows")
    windows = owned.groupBy("w1", "w2").agg(F.first("terms").alias("terms")).select(F.struct("w1", "w2").alias("window"), "terms")
    asked = owned.select(F.explode("terms").alias("term")).distinct()
    each = index.select("block", F.explode(F.arrays_zip("terms", "steps")).alias("p")).select("block", F.col("p.terms").alias("term"), F.col("p.steps").alias("cell"))
    postings = stored(each.join(asked, "term", "left_semi").select("block", "term", "cell", (F.length("cell") / 4).cast("long").alias("n")), "asked-postings", "zstd")
    ordered = stored(rarest_first(postings, windows), "ordered-windows")
    placed = stored(windows_by_block(postings, ordered), "block-windows")
    blocks = placed.select("block").distinct()
    heads = index.select("block", F.lit(HEADER).alias("kind"), F.col("first").alias("cell")).join(blocks, "block", "left_semi")
    lists = postings.select("block", F.lit(POSTINGS).alias("kind"), "term", "cell").join(blocks, "block", "left_semi")
    asks = placed.join(ordered, "window").select("block", F.lit(WINDOW).alias("kind"), "window.w1", "window.w2", "size", "terms", "offsets")
    both = heads.unionByName(lists, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True).select("block", "kind", "term", "cell", "w1", "w2", "size", "terms", "offsets")
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // BLOCKS_A_PARTITION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known, cells, ready = None, [], [], None
        for batch in batches:
            kinds, blocks = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            edges = np.flatnonzero((kinds[1:] != kinds[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(kinds)]]).tolist()
            for at, to in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(at, to - at)
                if kinds[at] == HEADER:
                    first, known, cells, ready = np.frombuffer(part.column(3)[0].as_py(), np.int64), [], [], None
                elif kinds[at] == POSTINGS:
                    known += part.column(2).to_pylist()
                    cells += [np.frombuffer(c, "<i4") for c in part.column(3).to_pylist()]
                else:
                    if ready is None:
                        counts = np.array([len(c) for c in cells], dtype=np.int64)
                        steps = np.concatenate(cells).astype(np.int64)
                        total, begin = np.cumsum(steps), np.cumsum(counts) - counts
                        ready = np.array(known, dtype=np.int64), counts, total - np.repeat(total[begin] - steps[begin], counts)
                    yield from search(part, int(blocks[at]), ready, first)

    def search(part: pa.RecordBatch, block: int, postings: tuple, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = part.column(6).to_numpy().astype(np.int64)
        window, doc, start = find_in_block(*postings, first, _matrix(part.column(7), size, width), _matrix(part.column(8), size, width), size, slop)
        if not len(window):
            return
        # spans of one document lie apart from those of others, so all are merged at once on their own scale
        begin, end = np.maximum(start, first[doc]), np.minimum(start + size[window], first[doc + 1])
        s, e = merged(begin + doc, end + doc)
        of = np.searchsorted(first + np.arange(len(first)), s, "right") - 1
        hit = np.unique(np.stack([doc, window]), axis=1)
        n, m = len(s), hit.shape[1]
        w = pa.array(hit[1])
        ends = [pa.array([*(x - of - first[of]).tolist(), *[None] * m], pa.int64()) for x in (s, e)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n + m, block)), pa.array(np.concatenate([of, hit[0]])), *ends, *(pa.concat_arrays([pa.nulls(n, pa.int64()), part.column(k).take(w)]) for k in (4, 5))], names=["block", "row", "start", "end", "w1", "w2"])

    found = stored(both.repartition(parts, "block").sortWithinPartitions("block", "kind", "term").mapInArrow(run, "block long, row long, start long, end long, w1 long, w2 long"), "found", "zstd")
    items = found.where("w1 is not null").join(owned.select("w1", "w2", "item"), ["w1", "w2"]).select("block", "row", "item").distinct()
    return found.where("start is not null").select("block", "row", "start", "end"), items


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), spans, items; one row a document.

    ``index``: a :func:`stored_index` of the documents, if there is one already.
    """
    before = stored_so_far()
    index = stored_index(docs) if index is None else index
    hits, named = matches(index, benchmark, width, slop)
    spans = hits.groupBy("block", "row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"))
    items = named.groupBy("block", "row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stored(spans.join(items, ["block", "row"], "full_outer"), "hits")
    rows = stored(documents_of(index), "indexed-documents")
    discard(index.sparkSession, before, keep=[found, rows])
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)")
    all_docs = rows.join(found, ["block", "row"], "left").withColumns({"spans": F.coalesce("spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    out = all_docs.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans", "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
