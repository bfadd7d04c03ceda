"""MinHash near-duplicates with tensored banding (operator 3).

Two collections of ``groups`` small hashes (``rows`` minimum hashes each) are computed
per document; every pair of one hash from each side is a table key, so ``groups**2``
tables cost ``2 * groups * rows`` minimum hashes instead of ``groups**2 * 2 * rows``.
With 20 groups of 4, a pair of similarity 0.8 shares no key with probability 0.00005, one of
0.85 with 0.0000008; keys of 8 minimum hashes keep documents apart that only share a passage.
Only hashes that two documents share are made into keys, as no other key can be shared.

1. Documents with equal shingle sets fall into one class (a 128-bit digest of the set);
   only one of each class goes on, so groups of exact copies cost one row.
2. Within a bucket nothing like all pairs is made.  The member with the most company is
   the pivot, and every other member is compared with it on full shingle sets.  The counts of
   the two hashes bound a bucket before it is made: one that may hold more than ``part`` members
   is split by salt into parts with pivots of their own, and the pivots are compared with the
   first of them, so no task ever has a large bucket.
3. Linked members are contracted (connected components).  Members of buckets that still
   hold several components are joined exactly: with shingles in the order of their rarity,
   two sets of that similarity share one of the first n - ceil(percent * n) + 1 of either.
   The place of the first shared shingle bounds the intersection, so a text with many
   shingles of its own meets few of a large family's members, and pairs are formed from the
   smaller component's side only.  Rarity is read off ``RARITY`` counters; any order will do.

So every pair that shares a table key is compared, known to be too different, or already
connected: no cap, and no link between texts that share a key is dropped.  A link between
texts that share none (see above) is found only if both are open in step 3.

Shingle sets are stored once for the members of buckets and joined with the pairs; texts aren't.
Counts by key or shingle are aggregates joined back, which adaptive joins split where one key
holds a large share of the rows.

Null, empty and blank texts have no shingles and link with nothing; texts of fewer words
than a shingle are one shingle.  A null doc_id is never linked and always kept.  Rows
with one doc_id are one node, with the links of all their texts.  Whole texts of any length are
read.  An empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, stored, stored_so_far
from .words import SPACES, U64, mix, segment_sum, shingle_sets, slices, word_table

GROUPS, ROWS = 20, 4
#: Ids of documents to be compared are broadcast up to this many; beyond, a shuffle finds their texts.
BROADCAST_IDS = 1_000_000
#: Buckets that may hold more members are split.
PART = 20_000
#: Counters by which shingles are ordered from rare to frequent.
RARITY = 1 << 18


def set_digest(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's shingle set."""
    return segment_sum(mix(h ^ U64(0x51ED270B7A0D2F5B)), first), segment_sum(mix(h + U64(0x2545F4914F6CDD1D)), first)


def signatures(docs: DataFrame, width: int, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), left and right (the two hash collections)."""
    salts = mix(np.arange(1, 2 * groups * rows + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
    factors = mix(salts) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(word_table(part.column(1), SPACES, lower=True), width)
                n = np.diff(first)
                d1, d2 = set_digest(h, first)
                some = np.flatnonzero(n)
                hashes = np.zeros((len(n), 2 * groups), dtype=U64)
                for k in range(2 * groups * rows if len(some) else 0):
                    least = np.minimum.reduceat((h ^ salts[k]) * factors[k], first[:-1][some])
                    hashes[some, k // rows] = mix(hashes[some, k // rows] * U64(0x9FB21C651E98DF25) + least)
                sides = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)), groups).cast(pa.list_(pa.int64())) for x in (hashes[:, :groups], hashes[:, groups:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *sides], names=["doc_id", "n_shingles", "d1", "d2", "left", "right"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, left array<long>, right array<long>")


def shingle_table(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """node, d1, shingles: the sorted shingle hashes (8 bytes each) of the texts of all members' ids; rows may repeat."""
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(word_table(part.column(1), SPACES, lower=True), width)
                own = pa.array([h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_digest(h, first)[0].view(np.int64)), own], names=["node", "d1", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "node long, d1 long, shingles binary")


def compare(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, da, b, db, linked: whether 100 * intersection >= percent * union of the full shingle sets."""
    once = sets.groupBy("node", "d1").agg(F.any_value("shingles").alias("shingles"))
    sided = pairs.join(once.withColumnsRenamed({"node": "a", "d1": "da", "shingles": "mine"}), ["a", "da"]).join(once.withColumnsRenamed({"node": "b", "d1": "db", "shingles": "other"}), ["b", "db"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for mine, b in zip(batch.column(4), batch.column(5), strict=True):
                one = np.frombuffer(mine.as_buffer(), U64)
                two = np.frombuffer(b.as_buffer(), U64)
                both = np.concatenate([one, two])
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(n > 0 and 100 * n >= percent * (len(one) + len(two) - n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_())], names=["a", "da", "b", "db", "linked"])

    return sided.select("a", "da", "b", "db", "mine", "other").mapInArrow(run, "a long, da long, b long, db long, linked boolean")


def contracted(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, label after the links are added to what is labelled already."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("label").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    merged = components(links)
    onward = merged.select(F.col("node").alias("label"), F.col("label").alias("next"))
    old = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return stored(old.unionByName(merged.join(labels, "node", "left_anti").select("node", "label")), "labels")


def in_reach(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ by more can't reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def one_way(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, each in one direction."""
    a, b = (F.struct(F.col(x).alias("node"), F.col(d).alias("d1")) for x, d in (("a", "da"), ("b", "db")))
    both = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.struct("a", "da", "b", "db").alias("p"))
    return both.groupBy("x", "y").agg(F.first("p").alias("p")).select("p.*")


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components: node, label, crowd (of the component), minor (a larger component is in one of its buckets)."""
    crowds = labels.groupBy("label").agg(F.count("*").alias("crowd"))
    known = labels.join(crowds, "label")
    labelled = members.select("key", "node").join(known, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("crowd", F.lit(1)).alias("crowd"))
    buckets = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.struct("crowd", "label")).alias("top")).where("least <> most").select("key", "top")
    return labelled.join(buckets, "key").groupBy("node", "label", "crowd").agg(F.bool_or(F.struct("crowd", "label") < F.col("top")).alias("minor"))


def shingle_counters(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of ``RARITY`` residues stand in the sets; one partial table a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, dtype=np.int64)
        for batch in batches:
            for own in batch.column(0):
                np.add.at(total, (np.frombuffer(own.as_buffer(), U64) % U64(RARITY)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["residue", "n"])

    counted = sets.select("shingles").mapInArrow(run, "residue long, n long").groupBy("residue").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, dtype=np.int64)
    out[counted.column("residue").to_numpy()] = counted.column("n").to_numpy()
    return out


def rarest_shingles(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The first shingles, by rarity, that a set must share with any set of the similarity."""
    sent = sets.sparkSession.sparkContext.broadcast(shingle_counters(sets))
    once = sets.groupBy("node", "d1").agg(F.any_value("shingles").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            rows, heads, places, sizes = [], [], [], []
            for k, own in enumerate(batch.column(5)):
                h = np.frombuffer(own.as_buffer(), U64)
                n = len(h) - -(-len(h) * percent // 100) + 1
                heads.append(h[np.lexsort((h, often[(h % U64(RARITY)).astype(np.int64)]))[:n]])
                rows.append(np.full(n, k))
                places.append(np.arange(1, n + 1))
                sizes.append(np.full(n, len(h)))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (sizes, heads, places))], names=["node", "d1", "label", "crowd", "minor", "size", "shingle", "place"])

    return once.join(nodes, "node").select("node", "d1", "label", "crowd", "minor", "shingles").mapInArrow(run, "node long, d1 long, label long, crowd long, minor boolean, size long, shingle long, place long")


def sharing(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a rare shingle, from the smaller component's side."""
    names = lambda x: [F.col(a).alias(b) for a, b in (("node", x), ("d1", f"d{x}"), ("label", f"l{x}"), ("crowd", f"c{x}"), ("size", f"n{x}"), ("place", f"p{x}"))]
    a, b = heads.where("minor").select("shingle", *names("a")), heads.select("shingle", *names("b"))
    smaller = (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("la") < F.col("lb")))
    # what the first shared shingle and all later ones can add up to; true of the first of any pair that is similar
    enough = (100 + percent) * (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) >= percent * (F.col("na") + F.col("nb"))
    return a.join(b, "shingle").where(smaller & in_reach("na", "nb", percent) & enough).select("a", "da", "b", "db")


def table_keys(classes: DataFrame, groups: int, part: int) -> DataFrame:
    """node, d1, size, company, key, salt, split: the table keys made of hashes that more than one class has."""
    hashes = classes.select("node", "d1", "size", F.posexplode(F.concat("left", "right")).alias("side", "hash"))
    often = hashes.groupBy("side", "hash").agg(F.count("*").alias("n")).where("n > 1")
    shared = hashes.join(often, ["side", "hash"])
    one = F.struct("side", "hash", "n")
    sides = shared.groupBy("node", "d1", "size").agg(F.collect_list(F.when(F.col("side") < groups, one)).alias("left"), F.collect_list(F.when(F.col("side") >= groups, one)).alias("right"), F.sum("n").alias("company"))
    pair = lambda a, b: F.struct(F.xxhash64(a["hash"], b["hash"], a["side"] * groups + b["side"] - groups).alias("key"), F.least(a["n"], b["n"]).alias("most"))
    keys = sides.select("node", "d1", "size", "company", F.explode(F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: pair(a, b))))).alias("k")).select("node", "d1", "size", "company", "k.key", "k.most")
    parts = F.ceil(F.col("most") / part)
    return keys.select("node", "d1", "size", "company", "key", F.pmod(F.xxhash64("node", "d1", "key"), parts).cast("int").alias("salt"), (parts > 1).alias("split"))


def bucket_members(classes: DataFrame, groups: int, part: int) -> DataFrame:
    """Members of buckets with company (node, d1, size, key, split), and the pivot of their part or bucket (b, db, other)."""
    rank = F.struct("company", (-F.col("node")).alias("node"), "d1", "size")
    same = Window.partitionBy("key", "salt")
    keyed = table_keys(classes, groups, part).withColumns({"n": F.count("*").over(same), "pivot": F.max(rank).over(same)}).where("n > 1 or split")
    return keyed.select("node", "d1", "size", "company", "key", "split", (-F.col("pivot.node")).alias("b"), F.col("pivot.d1").alias("db"), F.col("pivot.size").alias("other"))


def pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, da, b, db: each member with its pivot, and the pivots of a split bucket with the first of them."""
    pairs = lambda df: df.where("a <> b").where(in_reach("size", "other", percent)).select("a", "da", "b", "db")
    within = members.select(F.col("node").alias("a"), F.col("d1").alias("da"), "size", "b", "db", "other")
    heads = members.where("split and node = b and d1 = db").select("key", F.col("node").alias("a"), F.col("d1").alias("da"), "size", "company")
    top = F.max(F.struct("company", (-F.col("a")).alias("a"), "da", "size")).over(Window.partitionBy("key"))
    above = heads.withColumn("top", top).select("a", "da", "size", (-F.col("top.a")).alias("b"), F.col("top.da").alias("db"), F.col("top.size").alias("other"))
    return one_way(pairs(within).unionByName(pairs(above)))


def links_by_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: nodes of different texts that have a doc_id in common."""
    digest = F.struct("d1", "d2")
    several = signed.groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("doc_id")
    nodes = signed.join(several, "doc_id").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = GROUPS, rows: int = ROWS, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    before = stored_so_far()
    signed = stored(signatures(docs, width, groups, rows), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("size"), F.any_value("left").alias("left"), F.any_value("right").alias("right")), "classes")
    members = stored(bucket_members(classes, groups, part), "members")
    sets = stored(shingle_table(docs, members, width), "shingle-sets")
    found = stored(compare(sets, pivot_pairs(members, percent), percent), "compared")
    links = found.where("linked").select("a", "b").unionByName(links_by_id(linkable, classes))
    labels = contracted(links, None)
    open_nodes = stored(still_open(members, labels), "open")
    if open_nodes.limit(1).count():
        heads = stored(rarest_shingles(sets, open_nodes, percent), "rarest-shingles")
        back = found.select(F.col("b").alias("a"), F.col("db").alias("da"), F.col("a").alias("b"), F.col("da").alias("db"))
        key = ["a", "da", "b", "db"]
        more = one_way(sharing(heads, percent)).join(found.select(*key), key, "left_anti").join(back, key, "left_anti")
        labels = contracted(stored(compare(sets, more, percent), "compared").where("linked").select("a", "b"), labels)
    known = stored(classes.select("d1", "d2", "node").join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component_id")), "class-components")
    discard(docs.sparkSession, before, keep=[signed, known])
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(known, ["d1", "d2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"))
