"""run() against the stages' brute-force forms on a small fixture."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import mixing

COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def fixture(folder):
    rng = random.Random(11)
    names = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choice(names) for _ in range(60)) for _ in range(120)]
    items = [" ".join(rng.choice(names) for _ in range(20)) for _ in range(3)]
    for i in range(0, 40):
        texts[i] = texts[i] + (" idiot" if i % 2 else " moron idiot")
    texts[60] = texts[50]
    texts[61] = texts[51] + " tail"
    texts[70] = texts[70][:100] + " " + items[0]
    ids = list(range(len(texts)))
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * 120, "source": [f"s{i % 3}" for i in ids], "n_chars": [len(t) for t in texts]}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1, 2], "text": items}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": pa.array([1] * 120, pa.int32()), "toxic": pa.array([int(i < 40) for i in ids], pa.int32())}), f"{folder}/labels.parquet")
    return texts


def test_run_equals_brute_force(spark, tmp_path):
    texts = fixture(tmp_path)
    left = [i for i in range(40, 120) if i not in (60, 61, 70)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == COLUMNS, name
    assert sorted(r.doc_id for r in docs.collect()) == left
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for i in left:
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        for _ in range(copies[i]):
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected


def test_decisions_are_of_rows(spark, tmp_path):
    """Null, repeated and clashing ids, null, empty and very long texts, repeated rows, extra columns."""
    rng = random.Random(5)
    names = [f"w{k}" for k in range(5000)]
    text = lambda n=40: " ".join(rng.choice(names) for _ in range(n))
    item, copied = text(20), text()
    rows = [(i, text()) for i in range(30)] + [(None, copied), (None, copied), (7, copied), (7, copied), (None, text()), (None, item + " x"), (8, item + " y z " + item), (None, None), (None, ""), (50, None), (50, ""), (51, text(60_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)], schema).selectExpr("*", "1 as copies", "2 as __row", "'x' as component_id", "true as kept", "3 as copy").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), list(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path))
        if k == 1:  # of the five rows with the copied text, one row of id 7 stays
            left = [r for r in left if r[1] != copied] + [(7, copied)]
        if k == 2:
            left = [r for r in left if item not in (r[1] or "")]
        assert sorted(docs.columns) == COLUMNS, name
        assert sorted([(r.doc_id, r.text) for r in docs.collect()], key=key) == sorted(left, key=key), name
    wanted = mixing.mix(docs.withColumn("own", F.xxhash64("doc_id", "text")), keep=("own",)).groupBy().agg(F.sum("copies")).first()[0]
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.count() == wanted and sorted(mixed.columns) == COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == wanted
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_each_row_of_an_id_has_its_own_copies(spark):
    rows = [(None, f"a{k} " * (k + 1), "en", "x", 1) for k in range(9)] + [(1000, f"b{k} " * (k + 1), "en", "y", 1) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    wanted = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    assert {r.doc_id: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, "").groupBy("doc_id").count().collect()} == wanted


def test_stages_name_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "token files"]
