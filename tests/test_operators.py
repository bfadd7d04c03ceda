"""Reference operators on small cases: defaults, ties, nulls, mutations."""

import hashlib
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import geometry, identity, text
from ledgerloom.operators import audit, diverge, gates, generate, rules, score, traces, walk
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import runs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- text and identities


def test_normalised_text_and_labels(spark):
    df = spark.createDataFrame([("Ünïcode A-1  b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normalized(F.col("t"))).collect()] == ["n code a 1 b", "", ""]
    assert spark.range(1).select(text.partition_label(F.lit("x | y | z"))).first()[0] == "x"


def test_identities(spark):
    one = spark.range(1)
    canonical = identity.canonical_struct(b=F.lit("é\n"), a=F.lit(None).cast("string"))
    assert one.select(canonical).first()[0] == '{"a":null,"b":"é\\n"}'
    assert one.select(identity.digest(F.lit("x"))).first()[0] == "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert one.select(identity.digest(F.lit("x"), newline=True)).first()[0] == "sha256:" + hashlib.sha256(b"x\n").hexdigest()
    assert one.select(identity.domain_digest("k:v1", F.lit("{}"))).first()[0] == hashlib.sha256(b"k:v1\0{}\n").hexdigest()
    assert one.select(identity.git_blob_sha1(F.lit("hello"))).first()[0] == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    assert one.select(identity.token_digest(F.array(F.lit(5), F.lit(12)))).first()[0] == hashlib.sha256(b"5,12").hexdigest()
    found = spark.createDataFrame([('{"b":1.5e-7,"a":[1,2.0]}',), ("{",), ('{"a":NaN}',)], "j string").select(identity.canonical_json("j")).collect()
    assert [r[0] for r in found] == ['{"a":[1,2.0],"b":1.5e-07}', None, None]


# -- audits


def test_similarity_gate_equals_brute_force(spark):
    rng = random.Random(4)
    records = []
    for i in range(120):
        words = [f"t{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))] if i % 3 else (records[rng.randint(0, len(records) - 1)][1].split() if records else ["a"])
        records.append((i, " ".join(words), "abc"[i % 3]))
    df = spark.createDataFrame(records, "id long, text string, split string")
    sets = {i: set(t.split()) for i, t, _ in records}
    split = {i: s for i, _, s in records}
    expected = {tuple(sorted((a, b), key=lambda x: split[x])) for a in sets for b in sets if split[a] < split[b] and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8}
    assert {(r.a, r.b) for r in audit.pairs_above(df, "id", "split", 0.8).collect()} == expected and expected


def test_empty_token_sets_are_equal(spark):
    left = spark.createDataFrame([(1, ""), (2, "a b")], "l long, text string")
    right = spark.createDataFrame([(7, "!!"), (8, "b c")], "r long, text string")
    assert rows(audit.similar_pairs(left, right, "l", "r").select("l", "r", "jaccard")) == [(1, 7, 1.0), (2, 8, 1 / 3)]


def test_audit_offenders(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, "a  B!", "y"), (3, "c", "x")], "id long, text string, split string")
    assert [(r.id, r.previous) for r in audit.exact_duplicates(df, "id", "id", "text").collect()] == [(2, 1)]
    assert rows(audit.crossing(df.withColumn("g", F.col("id") % 2), "g", "split")) == []
    families = spark.createDataFrame([(1, "x"), (2, "x"), (9, "x")], "id long, split string")
    assert sorted((r.id, r.issues) for r in audit.member_check(families, df, "id", ["split"]).collect()) == [(2, ["split"]), (9, ["missing"])]
    assert rows(audit.unmapped(df.select("id"), families, "id")) == [(3,)]
    a = spark.createDataFrame([(0, "h0"), (1, "h1")], "k long, h string")
    b = spark.createDataFrame([(0, "h0"), (1, "hX"), (2, "h2")], "k long, h string")
    assert rows(audit.prefix_mismatch(a, b, "k", "h")) == [(2, 3, 1, 1)] and rows(audit.prefix_mismatch(a, a, "k", "h")) == [(2, 2, 0, None)]
    pairs = spark.createDataFrame([("p", "clean", "i", 1), ("p", "hard", "i", 2), ("q", "clean", "j", 3)], "p string, v string, i string, c int")
    assert rows(audit.pair_integrity(pairs, "p", "v", ["clean", "hard"], ["i", "c"])) == [("p", 2, [], ["c"]), ("q", 1, ["hard"], [])]


# -- traces


def test_traces(spark):
    steps = spark.createDataFrame([("r", 1), ("r", 2), ("r", 4), ("s", 1)], "run string, seq long")
    assert rows(traces.sequence_gaps(steps, "run", "seq")) == [("r", 4, 3)]
    ranges = spark.createDataFrame([("f", 0, 4), ("f", 4, 4), ("f", 9, 1)], "f string, start long, size long")
    assert rows(traces.range_gaps(ranges, "f", "start", "size")) == [("f", 9, 1, 8)]
    nodes = spark.createDataFrame([("n1", "image"), ("n2", "text")], "id string, role string")
    edges = spark.createDataFrame([("n1", "image"), ("n2", "image"), ("n9", "text")], "ref string, wanted string")
    assert rows(traces.reference_issues(edges, nodes, "ref", "id", "role", "wanted").select("ref", "issue")) == [("n2", "ARTIFACT_ROLE_MISMATCH"), ("n9", "UNKNOWN_ARTIFACT_REF")]
    assert rows(traces.orphans(nodes.select("id"), edges.where("ref = 'n1'"), "id", "ref")) == [("n2",)]
    assert traces.set_difference(nodes, nodes, ["id", "role"]).count() == 0
    runs_ = spark.createDataFrame([("a", 0, 5), ("b", 3, 3), ("c", 3, 2)], "k string, cap long, used long")
    assert rows(runs_.select("k", traces.limit_hit("used", "cap"))) == [("a", False), ("b", True), ("c", False)]
    assert spark.range(0).agg(traces.any_of(F.col("id") == 1)).first()[0] is False


# -- scores


def test_score_defaults(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 0)], "g int, p int")
    table = score.confusion(df, "g", "p", [0, 1, 2])
    assert rows(table) == [(0, 1, 1, 1), (1, 0, 0, 1), (2, 0, 0, 0)]
    assert score.macro_f1(table).first()[0] == pytest.approx((0.5 + 0 + 1) / 3)
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3"}), ({"a": "1"}, None)], "g map<string,string>, p map<string,string>")
    r = score.field_f1(maps, "g", "p").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 2, 0.5, 1 / 3) and r.f1 == pytest.approx(0.4)
    empty = score.field_f1(maps.where("false"), "g", "p").first()
    assert (empty.precision, empty.recall, empty.f1) == (1.0, 1.0, 1.0)
    assert score.rates(df, x=(F.col("p") == 0, F.col("g") == 9, 1.0), y=(F.col("p") == 0, F.col("g") == 9, None)).first().asDict() == {"x_n": 0, "x_of": 0, "x": 1.0, "y_n": 0, "y_of": 0, "y": None}


def test_unique_best_needs_a_single_maximum(spark):
    df = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 4), ("b", 1, 1, 3), ("c", 1, 2, 3), ("c", 2, 1, 3)], "g string, k int, shared long, u long")
    assert rows(score.unique_best(df, "g", "k", "shared", "u")) == [("a", None, 2), ("b", None, 1), ("c", 1, 1)]


def test_iou(spark):
    box = lambda *c: F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)))
    one = lambda a, b: tuple(spark.range(1).select(geometry.iou(a, b).alias("i")).first().i)
    assert one(box(0, 0, 4, 4), box(2, 2, 6, 6)) == (4, 28) and one(box(0, 0, 4, 4), box(4, 4, 5, 5)) == (0, 17)
    assert one(box(3, 0, 1, 4), box(0, 0, 4, 4)) == (0, 1)


def test_changes_and_deltas(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, False)], "id int, r boolean, c boolean")
    assert rows(score.events_of_change(df, "id", {"d": (F.col("r"), F.col("c"))})) == [(1, "d", "regression"), (2, "d", "improvement")]
    m = spark.createDataFrame([("a", 0.5, 0.75), ("b", 0.5, 0.5), ("c", None, 1.0), ("d", 1.0, 0.0)], "m string, b double, a double")
    assert {r.m: r["class"] for r in score.metric_deltas(m, "b", "a").collect()} == {"a": "improved", "b": "equal", "c": "not_applicable", "d": "regressed"}


# -- divergence and gates


def test_first_difference(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, 2]), ([], [])], "l array<int>, r array<int>")
    assert [r[0] for r in df.select(diverge.first_difference(F.col("l"), F.col("r"))).collect()] == [None, 1, 1, None]


def test_delta_statistics_take_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 3.0, 1.0], [0.0, 3.0, 1.0, 1.0])], "k int, l array<double>, r array<double>")
    r = diverge.delta_statistics(df, ["k"], "l", "r").first()
    assert (r.elements, r.n_different, r.max_delta, r.first_max, r.first_different, r.mean_delta) == (4, 2, 2.0, 1, 1, 1.0)


def test_series_and_ranks(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 2.5), ("b", 1, 2.0), ("b", 2, 1.0)], "g string, e int, v double")
    assert rows(diverge.strictly_decreasing(df, ["g"], "e", "v")) == [("a", False, 2, 2.0, 2.5, True), ("b", True, 2, 1.0, 1.0, False)]
    vectors = spark.createDataFrame([(1, [5.0, 7.0, 5.0])], "k int, v array<double>")
    assert rows(diverge.rank_of(vectors, "k", "v").select("pos", "rank")) == [(0, 2), (1, 1), (2, 2)]


def test_gates(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, bytes long, sha string")
    o = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("d", 3, "z")], "path string, bytes long, sha string")
    assert rows(gates.manifest_diff(e, o, "path", [("bytes", "size"), ("sha", "hash")])) == [("b", "size"), ("c", "missing"), ("d", "unexpected")]
    g = spark.createDataFrame([("p", "x", True), ("p", "y", None), ("q", "x", True)], "c string, g string, ok boolean")
    assert rows(gates.requirements(g, ["c"], "g", "ok")) == [("p", False, ["y"]), ("q", True, [])]


# -- contracts


@pytest.mark.parametrize(("raw", "code"), [('{"a":{"b":1}}', None), ('{"a":1,"a":2}', "DUPLICATE_JSON_KEY"), ('[{"x":NaN}]', "NONFINITE_NUMBER"), ('{"a":1} x', "MALFORMED_JSON"), ("", "MALFORMED_JSON"), (None, "MALFORMED_JSON")])
def test_strict_json(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "j string").select(rules.strict_json_code("j")).first()[0] == code


def test_each_rule_fires_alone(spark):
    good = {"id": 1, "kind": "a", "n": 3}
    contract = [("MISSING_FIELD", "$", F.size(rules.missing_fields(F.col("j"), ["id", "kind", "n"])) > 0), ("UNKNOWN_FIELD", "$", F.size(rules.unknown_fields(F.col("j"), ["id", "kind", "n"])) > 0), ("BAD_KIND", "$.kind", ~F.get_json_object("j", "$.kind").isin("a", "b")), ("BAD_N", "$.n", ~rules.is_strict_integer(F.try_parse_json("j"), "$.n"))]
    cases = [(good, None), ({"id": 1, "kind": "a"}, "MISSING_FIELD"), (good | {"x": 1}, "UNKNOWN_FIELD"), (good | {"kind": "z"}, "BAD_KIND"), (good | {"n": True}, "BAD_N"), (good | {"n": 1.5}, "BAD_N")]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in enumerate(cases)], "k long, j string")
    assert [r.code for r in rules.first_violation(df, "k", contract).orderBy("k").collect()] == [c for _, c in cases]
    assert {r.code for r in rules.violations(df.where("k = 1"), "k", contract).collect()} == {"MISSING_FIELD", "BAD_N"}


def test_paths_and_leaves(spark):
    paths = {"a/b.txt": False, "/a": True, "a/../b": True, "a//b": True, "C:/x": True, "a\\b": True, "": True, "./a": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.u for r in df.select("p", rules.unsafe_path(F.col("p")).alias("u")).collect()} == paths
    deep = "[" * 200 + "1" + "]" * 200
    a = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":null}]},"d":{}}'), (2, deep)], "k long, j string")
    assert [(r.path, r.value) for r in walk.leaves(a, "k", "j").where("k = 1").collect()] == [("$.a.b[0]", "1"), ("$.a.b[1].c", "null"), ("$.d", "{}")]
    b = a.withColumn("j", F.replace("j", F.lit("[1,"), F.lit("[2,")))
    assert rows(walk.changed_leaves(a, b, "k", "j", ["$.a.b[0]"])) == [(1, "$.a.b[0]", "1", "2", True)]


# -- generators


def test_loss_mask(spark):
    df = spark.createDataFrame([([5, 6, 7], 1), ([5, 6, 7, 8, 9], 2)], "ids array<int>, p int")
    assert [r[0] for r in df.select(generate.loss_mask(F.col("ids"), F.col("p"), 4, -100)).collect()] == [[-100, 6, 7, -100], [-100, -100, 7, 8]]


def test_ordered_digest_depends_on_order(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b")], "g string, o int, d string")
    swapped = df.withColumn("o", -F.col("o"))
    assert generate.ordered_digest(df, ["g"], "o", "d").first().digest == hashlib.sha256(b"a\nb").hexdigest() != generate.ordered_digest(swapped, ["g"], "o", "d").first().digest


# -- files and streams


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name, content in {"good.json": b'{"a":1}', "dup.json": b'{"a":1,"a":1}', "bad.json": b"\xff\xfe", "big.json": b"[" + b"1," * 100 + b"1]", "empty.json": b"", "twice.json": b"{}"}.items():
        (tmp_path / "j" / name).write_bytes(content)
    (tmp_path / "j" / "link.json").symlink_to(tmp_path / "j" / "good.json")
    (tmp_path / "j" / "second.json").hardlink_to(tmp_path / "j" / "twice.json")
    found = {r.path.rpartition("/")[2]: r.code for r in files.json_documents(spark, str(tmp_path / "j"), most_bytes=100).collect()}
    assert found == {"good.json": None, "dup.json": "DUPLICATE_JSON_KEY", "bad.json": "MALFORMED_JSON", "big.json": "INPUT_TOO_LARGE", "empty.json": "EMPTY_JSON", "link.json": "UNSAFE_INPUT_PATH", "twice.json": "UNSAFE_INPUT_PATH", "second.json": "UNSAFE_INPUT_PATH"}
    receipts = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in files.receipts(spark, str(tmp_path / "j"), "*.json").collect()}
    assert receipts["good.json"] == (7, hashlib.sha256(b'{"a":1}').hexdigest())
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "b": {"dtype": "F32", "shape": [], "data_offsets": [16, 20]}}).encode()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + struct.pack("<5f", 1, 2, 3, 4, float("nan")))
    tensors = files.safetensors_headers(spark, str(tmp_path / "t"))
    assert rows(tensors.select("name", "shape", "start", "size", "data_bytes")) == [("b", [], 16, 4, 20), ("w", [2, 2], 0, 16, 20)]
    assert rows(files.safetensors_issues(tensors, ["w", "z"]).select("name", "issue")) == [("z", "MISSING_TENSOR")]
    (tmp_path / "t" / "y.safetensors").write_bytes(b"12")
    assert rows(files.safetensors_issues(files.safetensors_headers(spark, str(tmp_path / "t"))).select("name", "issue")) == [("MALFORMED_HEADER", "MALFORMED_HEADER")]
    (tmp_path / "raw.bin").write_bytes(struct.pack("<3f", 1, float("inf"), 2))
    records = spark.createDataFrame([("a", 0, 4), ("b", 4, 4), ("c", 8, 3)], "tensor_id string, byte_offset long, byte_length long")
    kept = records.where("tensor_id <> 'c'")
    found = files.tensor_records(spark, str(tmp_path / "raw.bin"), records).orderBy("tensor_id").collect()
    assert [(r.tensor_id, r.aligned, r.whole, r.finite, r.elements) for r in found] == [("a", True, True, True, 1), ("b", True, True, False, 1), ("c", False, True, True, 0)]
    raw = hashlib.sha256(struct.pack("<f", 1))
    assert (found[0].sha256, found[0].bound_sha256) == (raw.hexdigest(), hashlib.sha256(struct.pack(">QQ", 0, 4) + raw.digest()).hexdigest())
    (tmp_path / "zero.bin").write_bytes(struct.pack("<f", -0.0))
    assert files.tensor_records(spark, str(tmp_path / "zero.bin"), kept.where("tensor_id = 'a'")).first().canonical_sha256 == hashlib.sha256(struct.pack("<f", 0.0)).hexdigest()
    pointer = "version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 12\n"
    assert [r[0] and tuple(r[0]) for r in spark.createDataFrame([(pointer,), ("x",)], "t string").select(files.lfs_pointer(F.col("t"))).collect()] == [("a" * 64, 12), None]
    sinks.write_jsonl(spark.createDataFrame([(2, "b"), (1, None)], "k int, a string").coalesce(1), str(tmp_path / "out"), ["k"])
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"a":null,"k":1}', '{"a":"b","k":2}']
    with pytest.raises(FileExistsError):
        sinks.write_jsonl(spark.createDataFrame([(2, "b")], "k int, a string"), str(tmp_path / "out"), ["k"])
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.write_exclusive(spark.range(3).selectExpr("1 / (id - 1) as x"), str(tmp_path / "half"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("half")]


def test_images_are_readable(spark):
    boxes = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2", "colour", "stroke"), b, strict=True))) for b in [(1, 1, 4, 3, 0xFF0000, 0), (-2, 0, 9, 5, 0x0000FF, 1)]))
    raw = bytes(spark.range(1).select(sinks.png(F.lit(6), F.lit(5), F.lit(0x102030), boxes)).first()[0])
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        kind, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert int.from_bytes(raw[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
        chunks[kind], at = data, at + 12 + n
    assert struct.unpack(">IIBBBBB", chunks[b"IHDR"]) == (6, 5, 8, 2, 0, 0, 0)
    lines = zlib.decompress(chunks[b"IDAT"])
    pixel = lambda x, y: lines[y * 19 + 1 + 3 * x : y * 19 + 4 + 3 * x]
    assert pixel(2, 2) == b"\xff\0\0" and pixel(2, 0) == b"\0\0\xff" and pixel(5, 2) == b"\x10\x20\x30" and pixel(0, 2) == b"\0\0\xff"


def test_streaming_counts_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "error"), (1, "2024-01-01 00:20:00", "view"), (2, "2024-01-01 02:00:00", "view")], "run int, t string, kind string").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "in"))
    stream = runs.read_events(spark, str(tmp_path / "in"), "run int, kind string, ts timestamp")
    for name, df, mode in (("counts", runs.run_counts(stream, "run", "kind", ["error", "view"]), "complete"), ("windows", runs.windowed_errors(stream, "ts", "kind"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.table("counts")) == rows(runs.run_counts(events, "run", "kind", ["error", "view"]))
    assert sorted((r.events, r.errors, r.failed) for r in spark.table("windows").collect()) == [(1, 0, False), (2, 1, True)]


def test_ordered_digest_holds_no_group_in_a_row(spark):
    n = 30_000
    df = spark.range(n).selectExpr("if(id % 3 = 0, null, 'a') as g", "id as o", "sha2(cast(id as string), 256) as d").repartition(5)
    found = generate.ordered_digest(df, ["g"], "o", "d")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    lines = lambda keep: "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n) if (i % 3 == 0) == keep)
    assert {r.g: (r.n, r.digest) for r in found.collect()} == {g: (n // 3 if keep else n - n // 3, hashlib.sha256(lines(keep).encode()).hexdigest()) for g, keep in ((None, True), ("a", False))}


def test_first_tokens_need_not_know_every_count(spark):
    import itertools
    import random

    from ledgerloom.operators import audit

    rng = random.Random(3)
    sets = [rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 12)) for _ in range(120)]
    rows = spark.createDataFrame([(i, "ab"[i % 2], " ".join(s)) for i, s in enumerate(sets)], "k int, s string, text string")
    classes = spark.createDataFrame([(i, len(s), sorted(hash(w) for w in s)) for i, s in enumerate(map(set, sets))], "id long, n int, t array<long>")
    for most in (1, 4, 100):
        heads = {}
        for r in audit._first_tokens(classes, 0.6, most).collect():
            heads.setdefault(r["id"], []).append(r["token"])
        of = {r["id"]: (set(r["t"]), set(heads[r["id"]])) for r in classes.collect()}
        assert all(of[x][1] & of[y][1] for x, y in itertools.combinations(of, 2) if len(of[x][0] & of[y][0]) > 0.6 * len(of[x][0] | of[y][0]))
    exact = {(x, y) for x, y in itertools.product(range(0, 120, 2), range(1, 120, 2)) if len(set(sets[x]) & set(sets[y])) > 0.6 * len(set(sets[x]) | set(sets[y]))}
    assert {(r["a"], r["b"]) for r in audit.pairs_above(rows, "k", "s", 0.6).collect()} == exact
