"""Contracts, scores and generators on small cases: strictness against Python's parser, every predicate, exact fractions, outcomes."""

import collections
import json
import math
import os
import random
import types
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import consent, contracts, exports, generate, grounding, isolation, manifests, remediation, router, rules
from ledgerloom.sources import scratch


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_strictness_equals_the_plain_parser(spark):
    rng = random.Random(3)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-0.5", "1e3", "null", "true", " ", '"\\"', "NaN", "x", '"a":1']
    sound = ['{"a":[1,{"b":null}]}', "[]", "{}", "1", '"x"', "null", ' {"a" : 1} ', '[1,2]', '{"a":{"a":1}}']
    texts = [*sound, '{"a":1} ', '{"a":1}{', '{"a":1}]', "1],[2", '1}, "w":{"v":2', '{"a":1}, {"b":2}', "1,2", "", " ", '{"a":1,"a":2}', "[NaN]", "[Infinity]", None, "tru", '{"a":1}\n\n']
    for _ in range(1500):
        text = rng.choice(sound)
        at = rng.randint(0, len(text))
        texts.append(text[:at] + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) + text[at + rng.randint(0, 2) :])
    df = spark.createDataFrame(list(enumerate(texts)), "k long, raw string").withColumn("doc", contracts.document("raw"))
    found = df.select("k", contracts.parse_code("raw", F.col("doc")).alias("code"), F.to_json("doc").alias("text")).collect()
    for r in found:
        assert r.code == rules.json_code(texts[r.k]), texts[r.k]
        if r.code is None:
            assert json.loads(r.text) == json.loads(texts[r.k]), texts[r.k]


def test_predicates(spark):
    doc = {"i": 3, "neg": -1, "big": 2**70, "f": 1.0, "t": "x", "e": "", "b": False, "n": None, "o": {}, "l": ["a", "a", ""], "deep": [{"Secret": 1, "say": 'the "secret": no'}]}
    v = contracts.opened(F.parse_json(F.lit(json.dumps(doc))))
    is_true = lambda column: one(spark, column)
    at = lambda f: contracts.at(v, f)
    assert is_true(contracts.is_integer(at("i"), 0)) and is_true(contracts.is_integer(at("big"), 0)) and not is_true(contracts.is_integer(at("neg"), 0)) and is_true(contracts.is_integer(at("neg")))
    assert not any(is_true(contracts.is_integer(at(f))) for f in ("f", "t", "b", "n", "o", "l", "gone"))
    assert is_true(contracts.is_exactly(at("i"), 3)) and not is_true(contracts.is_exactly(at("f"), 1)) and not is_true(contracts.is_exactly(at("b"), 0))
    assert is_true(contracts.is_flag(at("b"))) and is_true(contracts.is_false(at("b"))) and not is_true(contracts.is_true(at("b"))) and not is_true(contracts.is_flag(at("i")))
    assert is_true(contracts.is_null(at("n"))) and is_true(contracts.is_null(at("gone"))) and not is_true(contracts.is_null(at("e")))
    assert is_true(contracts.is_text(at("t"))) and not is_true(contracts.is_text(at("e"))) and not is_true(contracts.is_text(at("i")))
    assert is_true(contracts.is_object(at("o"))) and is_true(contracts.is_list(at("l"))) and not is_true(contracts.is_object(at("l")))
    assert is_true(contracts.repeats(contracts.strings(at("l")))) and not is_true(contracts.all_texts(at("l")))
    assert is_true(contracts.has_key(at("deep"), ["secret"])) and not is_true(contracts.has_key(at("deep"), ["secret"], fold_case=False)) and not is_true(contracts.has_key(at("deep"), ["no"]))
    assert is_true(contracts.is_number(at("f"), 0, 1)) and not is_true(contracts.is_number(at("i"), 0, 1)) and not is_true(contracts.is_number(at("b"), 0, 1))


@pytest.mark.parametrize(("text", "seconds"), [("1970-01-01T00:01:00Z", 60), ("2024-02-29T00:00:00Z", 1709164800), ("2023-02-29T00:00:00Z", None), ("2024-01-01T00:00:60Z", None), ("2024-01-01T00:00:00z", None), (" 2024-01-01T00:00:00Z", None), ("2024-01-01T00:00:00.5Z", None), (None, None)])
def test_utc_seconds(spark, text, seconds):
    assert one(spark, F.unix_seconds(consent.utc_seconds(F.lit(text).cast("string")))) == seconds


def test_null_and_empty_documents_are_malformed(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, "7")], "k long, raw string")
    found = {r.k: (r.code, r.location) for r in exports.run_violations(df, "k", "raw", F.lit("d")).collect()}
    assert found == {1: ("MALFORMED_JSON", "run_export"), 2: ("MALFORMED_JSON", "run_export"), 3: ("INVALID_TYPE", "run_export"), 4: ("INVALID_TYPE", "run_export")}
    assert exports.run_violations(df.where("false"), "k", "raw", F.lit("d")).count() == 0


def test_answers_and_records_must_meet(spark):
    record = json.dumps({"available_tools": ["file_read"], "category": "approval", "decision": {"selected_tool": "file_read", "arguments": {}, "risk_level": "low", "requires_approval": False, "should_reject": False, "should_fallback": False, "expected_result": "tool_candidate"}})
    gold = spark.createDataFrame([("a", record), ("b", record)], "example_id string, raw string").select("example_id", contracts.document("raw").alias("record"))
    answers = spark.createDataFrame([("a", json.dumps(json.loads(record)["decision"])), ("c", "{}")], "example_id string, raw_output string")
    judged = router.judged_answers(gold, answers)
    assert {r.example_id: r.error for r in judged.collect()} == {"a": None, "b": "MODEL_OUTPUT_ID_MISMATCH", "c": "MODEL_OUTPUT_ID_MISMATCH"}
    report = router.answer_report(judged).first()
    assert (report.records, report.valid_outputs, report.tool_hits, report.argument_field_f1, report.fallback_recall, report.false_refusal_rate) == (3, 1, 1, 1.0, 1.0, 0.0)
    none = router.answer_report(judged.where("false")).first()
    assert none.records == 0 and none.tool_accuracy is None and none.rejection_recall == 1.0


def test_exact_means(spark):
    rng = random.Random(1)
    parts = [[(rng.randint(0, 9), rng.randint(1, 10**6)) for _ in range(n)] for n in (0, 1, 5, 40)]
    df = spark.createDataFrame(list(enumerate(parts)), "k long, parts array<struct<n:long,d:long>>")
    for r in df.select("k", grounding.exact_mean("parts").alias("m")).collect():
        mean = sum(Fraction(n, d) for n, d in parts[r.k]) / len(parts[r.k]) if parts[r.k] else None
        assert (r.m.numerator, r.m.denominator) == ((None, None) if mean is None else (str(mean.numerator), str(mean.denominator)))


def test_a_tie_or_a_small_overlap_points_nowhere(spark):
    catalog = F.expr("array(named_struct('target_id', 'a', 'ref', 'r', 'bbox', array(0, 0, 10, 10)), named_struct('target_id', 'b', 'ref', 'r', 'bbox', array(10, 0, 20, 10)))")
    points = lambda *b: one(spark, grounding.resolved_box(F.array(*map(F.lit, b)), catalog, (1, 2)))
    assert points(0, 0, 10, 10) == "a" and points(5, 0, 15, 10) is None and points(0, 0, 10, 5) == "a" and points(0, 0, 10, 4) is None and points(9, 9, 9, 9) is None
    assert one(spark, grounding.resolved_ref(F.lit("r"), catalog)) == "a" and one(spark, grounding.resolved_ref(F.lit("z"), catalog)) is None


def test_isolation(spark):
    df = spark.createDataFrame([("train", 1, "x", ["i", "j"]), ("eval", 2, "x", None), ("eval", 3, None, ["j", "j"])], "split string, k long, name string, images array<string>")
    ids = isolation.identities(df, ["split", "k"], {"family_ids": F.col("name"), "image_sha256": F.col("images")})
    assert ids.count() == 6
    found = isolation.overlaps(ids, "split", ["train"], ["eval"])
    assert {(r.kind, r.identity) for r in found.collect()} == {("family_ids", "x"), ("image_sha256", "j")}
    report = {r.kind: (r.overlaps, r.first, r.passed) for r in isolation.isolation_report(found).collect()}
    assert report["image_sha256"] == (1, "j", False) and report["case_ids"] == (0, None, True) and len(report) == 6
    registry = spark.createDataFrame([("case_ids", 0, "a"), ("case_ids", 1, "a"), ("case_ids", 2, "b"), ("family_ids", 0, "Z"), ("odd", 0, "x"), ("image_sha256", 0, "ab")], "kind string, place long, identity string")
    assert {(r.kind, r.place, r.code) for r in isolation.registry_issues(registry).collect()} == {("case_ids", 1, "EXCLUSION_REGISTRY_NOT_CANONICAL"), ("family_ids", 0, "EXCLUSION_ID_INVALID"), ("odd", 0, "EXCLUSION_REGISTRY_SHAPE_INVALID"), ("image_sha256", 0, "EXCLUSION_HASH_INVALID")}


def test_outcomes(spark):
    schema = "k int, full_eval boolean, safety boolean, per_example_regression boolean, core_quality boolean, resource boolean, improvements array<string>"
    rows = [(1, True, True, True, True, True, ["m"]), (2, True, True, True, True, True, []), (3, False, True, False, True, True, ["m"]), (4, True, False, True, True, False, None), (5, True, True, True, True, None, None)]
    found = {r.k: (r.outcome, r.classification, r.failure_reasons) for r in remediation.gate_outcome(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: ("favorable", "improves", []), 2: ("neutral", "preserves", []), 3: ("adverse", "quality", ["full_eval_gate_failed", "per_example_regression_gate_failed"]), 4: ("adverse", "multiple", ["safety_gate_failed", "resource_gate_failed"]), 5: ("adverse", "resource", ["resource_gate_failed"])}
    claims, runs = spark.createDataFrame([("a", 5, 3.0), ("b", 4, 3.0), ("c", 5, 2.5), ("d", 1, 1.0)], "k string, peak long, elapsed double"), spark.createDataFrame([(k, p, e) for k in "abc" for p, e in ((5, 1.0), (2, 2.0))], "k string, peak long, elapsed double")
    assert {r.k: r.issue for r in remediation.resource_rollup(claims, runs, "k", "peak", "elapsed").collect()} == {"a": None, "b": "PEAK_MISMATCH", "c": "ELAPSED_TOO_SHORT", "d": "NO_RUNS"}


def test_registry_rows_and_trees(spark):
    values = [f"{math.sin(k):.9f}" for k in range(500)] * 2
    df = spark.createDataFrame([("x" if k % 3 else "y", v) for k, v in enumerate(values)], "kind string, v string")
    for kind in "xy":
        expected = sorted({v for k, v in enumerate(values) if ("x" if k % 3 else "y") == kind})
        assert [r.v for r in generate.registry_rows(df, "kind", "v").where(F.col("kind") == kind).orderBy("place").collect()] == expected
    rows = spark.range(2500).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    whole = generate.tree_digest(rows, ["g"], "o", "d").first()
    assert whole.n == 2500 and whole.digest == generate.tree_digest(rows.repartition(7), ["g"], "o", "d").first().digest
    assert whole.digest != generate.tree_digest(rows.withColumn("o", F.when(F.col("o") == 5, 6).when(F.col("o") == 6, 5).otherwise(F.col("o"))), ["g"], "o", "d").first().digest


def test_remote_files(spark):
    listing = json.dumps({"siblings": [{"rfilename": "b", "size": 2, "blobId": "x"}, {"rfilename": "a", "size": None, "blobId": None, "lfs": {"pointerSize": 134, "sha256": "s", "size": 9}}]})
    found = one(spark, manifests.remote_files(F.parse_json(F.lit(listing))))
    assert [(f.name, f.size, f.blob_id, f.lfs and tuple(f.lfs)) for f in found] == [("a", None, None, (134, "s", 9)), ("b", 2, "x", None)]


def test_a_file_that_changes_is_not_taken(tmp_path, monkeypatch):
    place = tmp_path / "f.json"
    place.write_text("{}")
    assert scratch.read_once(f"file://{place}", 100) == (b"{}", None)

    def replaced(path, *more):
        assert path == str(place)  # the module's own view of os, and this one file: nothing else may be replaced
        (tmp_path / "other").write_text("[]")
        (tmp_path / "other").replace(place)
        return os.lstat(path, *more)

    monkeypatch.setattr(scratch, "os", types.SimpleNamespace(**{name: getattr(os, name) for name in ("open", "fdopen", "fstat", "close", "O_RDONLY", "O_NOFOLLOW")}, lstat=replaced))
    assert scratch.read_once(str(place), 100) == (None, "INPUT_CHANGED")
    monkeypatch.undo()
    assert scratch.read_once(str(tmp_path / "gone"), 100) == (None, "UNSAFE_INPUT_PATH") == scratch.read_once(str(tmp_path), 100)


def test_commands(spark, tmp_path, capsys):
    from ledgerloom.__main__ import main
    from ledgerloom.plans import contracts as made

    (tmp_path / "runs").mkdir()
    for k in (1, 2):
        (tmp_path / "runs" / f"{k}.json").write_text(made.RUN.replace("@id", str(k)))
    assert main(["runs", str(tmp_path / "runs")], spark) == 0 == main(["records", str(tmp_path / "runs"), str(tmp_path / "out")], spark)
    lines = [json.loads(line) for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert sorted(r["source"]["run_id"] for r in lines) == ["run-1", "run-2"] and [r["record_id"] for r in lines] == sorted(r["record_id"] for r in lines)
    (tmp_path / "runs" / "3.json").write_text(made.RUN.replace("@id", "2"))
    assert main(["records", str(tmp_path / "runs"), str(tmp_path / "more")], spark) == 2 and "DUPLICATE_DATASET_RUN" in capsys.readouterr().err
    (tmp_path / "runs" / "0.json").write_text("{")
    assert main(["runs", str(tmp_path / "runs")], spark) == 2 and '"code":"MALFORMED_JSON"' in capsys.readouterr().err
    (tmp_path / "none").mkdir()
    assert main(["cases", str(tmp_path / "none")], spark) == 2 and "EMPTY_DATASET_INPUT" in capsys.readouterr().err


def test_exact_means_of_any_size(spark):
    n, primes = F.col("id") % 97, [d for d in range(2, 3000) if all(d % k for k in range(2, int(d**0.5) + 1))]
    d = F.element_at(F.array(*map(F.lit, primes)), (F.col("id") % len(primes) + 1).cast("int"))
    rows = spark.range(300_000).select(F.when(F.col("id") < 5, "few").otherwise("many").alias("g"), F.when(F.col("id") % 11 != 0, F.struct(n.alias("n"), d.cast("long").alias("d"))).alias("part"))
    rows = rows.unionByName(spark.sql("select 'huge' as g, named_struct('n', 9223372036854775807L, 'd', 3L) as part from range(40)")).unionByName(spark.sql("select 'none' as g, cast(null as struct<n: bigint, d: bigint>) as part"))
    found = {r.g: r for r in grounding.exact_means(rows, "g", "part").collect()}
    assert found.keys() == {"few", "many", "huge"}
    for g, ids in (("few", range(5)), ("many", range(5, 300_000))):
        parts = collections.Counter()
        used = [k for k in ids if k % 11]
        for k in used:
            parts[primes[k % len(primes)]] += k % 97
        mean = sum((Fraction(a, b) for b, a in parts.items()), Fraction(0)) / len(used)
        r = found[g]
        assert r.n == len(used) and Fraction(int(r.numerator, 0), int(r.denominator, 0)) == mean and r.value == float(mean)
    assert (found["huge"].n, found["huge"].numerator, found["huge"].denominator) == (40, str(2**63 - 1), "3")


def test_exact_means_in_one_pass(spark):
    rng = random.Random(7)
    parts = {"short": [(rng.randint(-9, 9), rng.randint(1, 800)) for _ in range(5)], "wide": [(rng.randint(-(2**62), 2**62), rng.randint(2**40, 2**62)) for _ in range(90)], "zero": [(0, 7)] * 3, "none": [None, None]}
    rows = spark.createDataFrame([(g, p) for g, ps in parts.items() for p in ps], "g string, part struct<n: long, d: long>")
    for most in (None, 1, 90, 5000):
        found = {r.g: r for r in grounding.exact_means(rows, "g", "part", {"odd": F.col("part.n") % 2 != 0}, most).collect()}
        assert found.keys() == parts.keys() and (found["none"].n, found["none"].odd, found["none"].numerator, found["none"].value) == (0, 0, None, None)
        for g in ("short", "wide", "zero"):
            mean, r = sum((Fraction(*p) for p in parts[g]), Fraction(0)) / len(parts[g]), found[g]
            assert (r.n, r.odd) == (len(parts[g]), sum(n % 2 for n, _ in parts[g])) and Fraction(int(r.numerator, 0), int(r.denominator, 0)) == mean and r.value == float(mean)


def test_cases_are_joined_with_their_predictions(spark):
    gold = "named_struct('disposition', 'act', 'tool', 'click', 'arguments', map('n', '1', 'm', '2'), 'ref', 'r', 'bbox', array(0, 0, 10, 10), 'target_id', 'a', 'reason', cast(null as string), 'target_catalog', array(named_struct('target_id', 'a', 'ref', 'r', 'bbox', array(0, 0, 10, 10)), named_struct('target_id', 'b', 'ref', 'q', 'bbox', array(2, 0, 12, 10))))"
    cases = spark.sql(f"select 's' as suite, id as case_id, 'fused_grounding' as capability, 'none' as perturbation, {gold} as gold from range(3)")
    said = "named_struct('disposition', 'act', 'tool', 'click', 'arguments', map('m', '2', 'n', '1'), 'ref', 'r', 'bbox', array(int(id), 0, int(id) + 10, 10), 'reason', cast(null as string))"
    predictions = spark.sql(f"select 's' as suite, id as case_id, {said} as prediction from range(10) where id <> 2")
    found = {r.case_id: r for r in grounding.scored_cases(cases, predictions, "suite", "case_id").collect()}
    assert found.keys() == {0, 1, 2}
    assert found[0].grounding_accuracy.hit and found[0].argument_exact_match.hit and (found[0].box_target, tuple(found[0].overlap)) == ("a", (100, 100))
    assert not found[1].grounding_accuracy.hit and (found[1].ref_target, found[1].box_target, tuple(found[1].overlap)) == ("a", None, (90, 110)) and found[1].tool_accuracy.hit
    assert not found[2].action_accuracy.hit and (found[2].ref_target, found[2].box_target, tuple(found[2].overlap)) == (None, None, (0, 1)) and found[2].tool_accuracy.of and not found[2].prediction_coordinate_ref_disagreement_rate.of


def test_grounding_scores_reads_lines_once(spark, tmp_path):
    from ledgerloom.plans.grounding import grounding_scores

    spark.sql("select id div 3 as l_orderkey, int(id % 3 + 1) as l_linenumber, id * 7 as l_partkey, id * 5 as l_suppkey from range(60)").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = grounding_scores(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert found.count() == 20 * 8


def test_tree_digests_of_several_levels(spark):
    import hashlib

    def node(digests):
        return hashlib.sha256("\n".join(digests).encode()).hexdigest()

    def digest(rows, fan):
        level = {}
        for o, d in sorted(rows):
            level.setdefault(o // fan, []).append(d)
        level = {k: node(v) for k, v in level.items()}
        while max(level) >= fan:
            up = {}
            for k in sorted(level):
                up.setdefault(k // fan, []).append(level[k])
            level = {k: node(v) for k, v in up.items()}
        return node([level[k] for k in sorted(level)])

    data = {"big": [(k, f"h{k}") for k in range(0, 700, 3)], "mid": [(k, f"m{k}") for k in range(30)], "one": [(0, "x")], None: [(5, "y")]}
    rows = spark.createDataFrame([(g, o, d) for g, own in data.items() for o, d in own], "g string, o long, d string").repartition(5)
    found = {r.g: (r.n, r.digest) for r in generate.tree_digest(rows, ["g"], "o", "d", chunk=6).collect()}
    assert found == {g: (len(own), digest(own, 6)) for g, own in data.items()}


def test_consents_state_their_version_under_any_name(spark):
    from ledgerloom.plans import consent as made

    text = made.CONSENT.replace("@id", "1")
    df = spark.createDataFrame([(1, text), (2, text.replace('"consent_version"', '"terms"')), (3, text.replace('"consent_version": 1', '"terms": 2'))], "k long, j string")
    found = grounding.document_violations(df, ["k"], "j", lambda doc, scope: consent.consent_rules(doc, scope, version_field="terms"))
    assert {r.k: (r.code, r.location) for r in found.collect()} == {1: ("MISSING_FIELD", "$.consent"), 2: (None, None), 3: ("UNSUPPORTED_VERSION", "$.consent.terms")}


def test_rows_of_one_row_group_are_judged_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans.registry import spread

    rows = spread(spark.range(0, 5000, numPartitions=1), "id")
    held = rows.groupBy(F.spark_partition_id()).count()
    assert held.count() >= 32 and held.agg(F.max("count")).first()[0] < 1000
    assert rows.agg(F.count_distinct("id")).first()[0] == 5000


def test_a_text_that_closes_or_fills_the_list_around_it_is_no_document(spark):
    from ledgerloom.operators import contracts as c

    texts = ['{"a": 1}', " [1] ", "1", "1], [1", "1, 2", '1, "x"], [1, "x"', '{"a": 1} {}', "", " ", "1]", '"a', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    found = rows.select("k", c.document("raw").isNotNull().alias("d"), c.is_strict(rows["raw"]).alias("s")).orderBy("k").collect()
    assert [r.d for r in found] == [r.s for r in found] == [True] * 3 + [False] * 9


def test_a_filter_on_the_semantic_error_does_not_hold_what_leads_to_it(spark):
    step = F.concat(F.col("k"), F.lit("CONFLICTING"))
    for _ in range(3):
        step = F.when(F.length(step) > 4, F.concat(step, F.lit("x"))).otherwise(step)
    answer = F.struct(F.create_map(F.lit("n"), F.struct(F.lit("1").alias("json"))).alias("fields"))
    judged = spark.createDataFrame([("a",), ("b",)], "k string").select("k", step.alias("semantic_error"), answer.alias("answer"))
    cohort = remediation.conflict_cohort(judged, "k", {"n": "1"}, "aCONFLICTINGxxx")
    assert [tuple(r) for r in cohort.collect()] == [("a", True)]
    filters = [x for x in cohort._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("CONFLICTING," in x or "length" in x for x in filters)


def test_fixture_of_more_records_than_a_file_holds(spark, tmp_path):
    from ledgerloom.plans.router import fixture_files

    k = F.col("id")
    spark.range(1, 1201).select(k.alias("s_suppkey"), (k % 1).cast("int").alias("s_nationkey"), F.when(k == 1150, 10.0).otherwise(2000.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in fixture_files(spark, str(tmp_path)).collect()] == [(0, "INVALID_ENUM", "$[1149].category")]


def test_an_answer_is_parsed_once_and_python_sees_what_is_refused(spark):
    decision = {"selected_tool": "file_read", "arguments": {"a\n": 'q"\\', "n": None}, "risk_level": "low", "requires_approval": False, "should_reject": False, "should_fallback": False, "expected_result": "tool_candidate"}
    record = json.dumps({"available_tools": ["file_read", 5], "category": "approval", "decision": decision})
    texts = [json.dumps(decision), json.dumps(decision).replace("{", '{"risk_level": "none", ', 1), json.dumps({**decision, "arguments": {"n": 10**20, "x": 1.5}}), json.dumps({**decision, "arguments": {"": 1}}), "[]", None, json.dumps(decision)[:-1], json.dumps({**decision, "selected_tool": 5})]
    gold = spark.createDataFrame([(k, record) for k in range(len(texts))], "example_id int, raw string").select("example_id", contracts.document("raw").alias("record"))
    judged = router.judged_answers(gold, spark.createDataFrame(list(enumerate(texts)), "example_id int, raw_output string"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 3  # the record, the answer, and what Python gave instead of a refused one
    found = [(r.error, r.hits) for r in judged.select("example_id", "error", (contracts.at(F.col("answer"), "arguments")["json"] == contracts.at(F.col("gold"), "arguments")["json"]).alias("hits")).orderBy("example_id").collect()]
    assert found == [(None, True), (None, True), ("INVALID_ARGUMENT_VALUE", None), ("INVALID_STRING", None), ("MODEL_OUTPUT_NOT_OBJECT", None), ("INVALID_RAW_OUTPUT", None), ("MALFORMED_MODEL_JSON", None), ("INVALID_ENUM", None)]


def test_decisions_of_one_key_are_compiled_one_by_one(spark):
    decision = {"selected_tool": "file_read", "arguments": {}, "risk_level": "low", "requires_approval": True, "should_reject": 0, "should_fallback": 0, "expected_result": 0}
    rows = [(1, json.dumps(decision)), (1, json.dumps({**decision, "selected_tool": "reject_request"})), (None, json.dumps(decision)), (2, "{")]
    found = router.compiled_decisions(spark.createDataFrame(rows, "k int, raw string"), "k", "raw")
    assert sorted((str(r.k), r.code, r.expected_result) for r in found.collect()) == [("1", None, "approval_required"), ("1", None, "rejection"), ("2", "MALFORMED_JSON", None), ("None", None, "approval_required")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rules_write_no_value_as_json_again(spark):
    from ledgerloom.operators import consent, exports, grounding, manifests
    from ledgerloom.plans import contracts as made

    rows = spark.createDataFrame([(0, "{}")], "k int, raw string")
    judged = [
        exports.run_violations(rows, "k", "raw", F.lit(made.DIGEST)), grounding.document_violations(rows, ["k"], "raw", consent.consent_rules),
        grounding.document_violations(rows, ["k"], "raw", lambda doc, scope: manifests.taxonomy_rules(doc, scope, ["a"], 1)), router.record_violations(rows, "k", "raw"),
    ]
    for df in judged:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("to_json") <= 12  # where a rule is about the size or a key of a part


def test_a_digest_of_digits_is_no_long_number(spark):
    from ledgerloom.functions import lexical

    long, far = "9" * 46, "1e999"
    texts = ['{"a": "sha256:%s"}' % ("0" * 64), '{"a": "%s"}' % ("ab3e45" * 9), '{"a": %s}' % long, "[-%s]" % long, long, '{"a": [1, %s\n]}' % far, far, '{"a": 1.5E+0400}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    rows = df.select("k", "j", lexical.with_bounded_numbers(F.col("j")).alias("b"), lexical._may_have_unbounded_numbers(F.col("j")).alias("m"), lexical.may_be_nonfinite(F.col("j")).alias("n")).orderBy("k").collect()
    assert [r.m for r in rows] == [False] * 2 + [True] * 6 and [r.n for r in rows] == [False] * 5 + [True] * 3
    assert [r.b == r.j for r in rows] == [True] * 2 + [False] * 6


def test_the_first_object_is_found_at_any_depth(spark):
    from ledgerloom.functions import lexical

    deep = '{"a": ' + "[" * 20 + "]" * 20 + "}"
    cases = {'so {"a": "}\\"]", "b": [1, {"c": []}]} and {"d": 1}': '{"a": "}\\"]", "b": [1, {"c": []}]}', f"x {deep} y": deep, '{"a": 1': None, 'none "at all"': None, '{"open: 1}': '{"open: 1}', 'a ] { "x": "\n" }': '{ "x": "\n" }'}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", lexical.first_object(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_records_are_judged_once_to_find_repeated_ids(spark):
    from ledgerloom.plans import router as made

    texts = [made.RECORD.replace("@id", "7"), made.RECORD.replace("@id", "7"), "{", "{", made.RECORD.replace("@id", "8").replace('"low"', '"tiny"'), made.RECORD.replace("@id", "8"), '{"split": "x", ' + made.RECORD.replace("@id", "9")[1:], None]
    found = router.record_violations(spark.createDataFrame(list(enumerate(texts)), "k int, raw string"), "k", "raw")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parseJson") == 2  # the text, and what Python gave instead of a refused one
    assert [r.code for r in found.orderBy("k").collect()] == [None, "DUPLICATE_EXAMPLE_ID", "MALFORMED_JSON", "MALFORMED_JSON", "INVALID_ENUM", "DUPLICATE_EXAMPLE_ID", None, "MALFORMED_JSON"]
