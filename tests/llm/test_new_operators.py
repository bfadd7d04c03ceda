"""Periodic runs, best-fit packing and importance resampling on small tables, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASH, sample_texts
from tokenizers import Tokenizer

from ledgerloom.llm import best_fit_packing, importance_resampling, periodic_runs, queries

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def repeating(rng, n):
    w = [rng.choice("abcdefg") for _ in range(n)]
    a = rng.randrange(n)
    p = 1 + (n - a) // rng.randint(2, 9)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = sample_texts() + [repeating(rng, rng.randint(12, 300)) for _ in range(60)] + ["x " * 40, "a b " * 30 + "c " + "a b " * 30, "a b c d e f a b c d e f", "w\tw\nw " * 9]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 1), (None, texts[3], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH, "'k' as __row", "1 as rank").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


# -- operator 11


def brute_runs(w, least=12, exponent=2):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and all(any(w[k] != w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("lags", [1 << 14, 7])
@pytest.mark.parametrize(("least", "exponent"), [(12, 2), (5, 3)])
def test_periodic_runs(docs, lags, least, exponent):
    found = periodic_runs.periodic_runs(docs, ("doc_id", "size", "__row"), least, exponent, lags_per_task=lags).collect()
    expected = []
    for r in docs.collect():
        w = re.findall(SPACED, r.text or "")
        runs = brute_runs(w, least, exponent) if len(w) < 2000 else [(0, 8000, 2)]
        expected.append((r.doc_id, r.size, r.__getitem__("__row"), len(w), runs, kept_words(w, runs)))
    order = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted(((r.doc_id, r.size, r["__row"], r.n_words, [tuple(x) for x in r.runs], r.text) for r in found), key=order) == sorted(expected, key=order)
    assert sum(len(e[4]) for e in expected) > 40


def test_no_periodic_runs_in_an_empty_table(none):
    assert periodic_runs.periodic_runs(none).collect() == []


def test_scan_of_many_documents_equals_each_alone():
    rng = random.Random(11)
    for _ in range(150):
        documents = [repeating(rng, rng.choice([12, 13, 40, 90, 200, 400])).encode().split() if rng.random() < 0.8 else [] for _ in range(rng.randint(1, 7))]
        together = [r.tolist() for r in periodic_runs.runs_of(documents)]
        assert together == [periodic_runs.runs_of([d])[0].tolist() for d in documents] == [[list(x) for x in brute_runs(d)] for d in documents]


def test_ranges_of_a_long_document_meet(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONG_RUN", 64)
    rng = random.Random(5)
    words = [f"w{rng.randrange(50)}" for _ in range(3000)]
    words[200:1400] = ["a", "b", "c"] * 400
    words[1500:2900] = words[1500:2200] * 2
    documents = [words, ["z"] * 2500]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(documents)], "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(df, lags_per_task=100).collect()}
    assert (200, 1200, 3) in found[0] and any(p == 700 for _, _, p in found[0]) and found[1] == [(0, 2500, 1)]
    assert found[0] == [tuple(x) for x in periodic_runs.runs_of([[w.encode() for w in words]])[0].tolist()]


def test_query_of_periodic_runs(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, " \n".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))) for k in range(150)] + [(150, None), (151, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, f"file://{tmp_path}").collect()}
    planted = 0
    for doc_id, text in rows:
        w, h = re.findall(SPACED, text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = found[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept_words(w, runs)))
    assert planted > 5


# -- operator 12


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece: how many sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_equals_best_fit_of_pieces():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        histogram = {n: rng.randint(0, 12) for n in rng.sample(range(1, capacity + 1), rng.randint(0, min(capacity, 15)))}
        entries = best_fit_packing.plan(histogram, capacity)
        placed = collections.Counter()
        for count, content in entries:
            assert count > 0 and sum(n * k for n, k in content) <= capacity
            for n, k in content:
                placed[n] += count * k
        assert placed == collections.Counter({n: c for n, c in histogram.items() if c})
        assert sum(count for count, _ in entries) == best_fit([n for n, c in histogram.items() for _ in range(c)], capacity)
        ranks = collections.defaultdict(set)
        for length, first, n, each, _, _ in best_fit_packing.slots(entries):
            assert n % each == 0 and not ranks[length] & set(range(first, first + n))
            ranks[length] |= set(range(first, first + n))
        assert all(ranks[n] == set(range(c)) for n, c in placed.items())


def test_plan_is_small_for_any_counts():
    rng = random.Random(4)
    entries = best_fit_packing.plan({n: rng.randint(0, 10**9) for n in range(1, 4097)}, 4096)
    assert len(entries) <= 3 * 4096
    with pytest.raises(ValueError):
        best_fit_packing.plan({5: 1}, 4)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(docs, none, capacity):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    packed = best_fit_packing.pack(docs, path, 1, capacity, keep=("doc_id", "size", "text"), with_ids=True)
    rows = packed.collect()
    found = collections.Counter((r.doc_id, r.text, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows)
    expected, lengths = collections.Counter(), []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            lengths.append(len(own))
            expected[(r.doc_id, r.text, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own))] += 1
    assert found == expected
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_sequence) == best_fit(lengths, capacity)
    for s in best_fit_packing.sequences(packed).collect():
        own = sorted(by_sequence[s.sequence_id], key=lambda r: r.offset)
        assert s.n_pieces == len(own) and s.ids == [i for r in own for i in r.ids] and s.starts == [r.offset for r in own]
    assert best_fit_packing.pack(none, path).collect() == []


# -- operator 13


def features(text, widths):
    words = re.findall(PLAIN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(widths[0], widths[1] + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("widths", "buckets", "percent"), [((1, 1), 10_000, 10), ((1, 2), 50, 100), ((2, 3), 7, 33)])
def test_resampling(docs, none, widths, buckets, percent):
    target = docs.where("doc_id % 4 = 1").select("text")
    found = importance_resampling.resample(docs, target, widths, buckets, 2024, 20, percent, keep=("text", "n")).collect()
    raw, wanted = (collections.Counter(zlib.crc32(f.encode()) % buckets for r in df.collect() for f in features(r.text, widths)[1]) for df in (docs, target))
    S, T = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in range(buckets)}
    expected = []
    for r in docs.collect():
        words, own = features(r.text, widths)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        expected.append((r.doc_id, r.text, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_features, r.weight, r.score) for r in found), key=order) == sorted(expected, key=order)
    enough = [e for e in expected if e[2] >= 20]
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, percent * len(enough) // 100 + 1))
    best = sorted(((-e[5], e[0] is None, e[0] or 0) for e in enough))[: len(drawn)]
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn] == best
    assert importance_resampling.resample(none, target, widths, buckets).collect() == []
    assert all(r.weight is not None for r in importance_resampling.resample(docs, none, widths, buckets).collect())


def test_sampling_follows_the_target(spark):
    rng = random.Random(1)
    near, far = [f"n{k}" for k in range(40)], [f"f{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(near if k % 5 == 0 else far) for _ in range(30))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(near),)], "text string")
    drawn = [r.doc_id for r in importance_resampling.resample(docs, target).where("rank is not null").collect()]
    assert len(drawn) == 60 and all(k % 5 == 0 for k in drawn)


def test_ranks_of_ties_are_parted(spark):
    rows = spark.range(1000).select(F.lit(7).alias("score"), F.lit(None).cast("long").alias("doc_id")).repartition(6)
    found = importance_resampling.ranked(rows, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 1001))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_importance_resampling"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, sf).toArrow()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = con.sql(queries.ORACLES[name]).to_arrow_table()
    names = sorted(found.column_names)
    assert names == sorted(expected.column_names)
    rows = lambda t: sorted(repr([r[c] for c in names]) for r in t.to_pylist())
    assert rows(found) == rows(expected) and found.num_rows > 0
