"""Run exports to records: a denied run with a used-up budget, an unknown outcome, and defaults."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from ledgerloom.operators import documents, reliability


def export(run_id="r", phase="FAILED", events=(), used=2, recovery="stopped", action="inspect_trace_then_start_new_run", **more):
    budgets = {f"max_{b}": 0 for b in reliability.BUDGETS} | {f"{b}_used": 0 for b in reliability.BUDGETS} | {"max_tool_calls": 2, "tool_calls_used": used}
    point = {"checkpoint_version": 1, "phase": phase, "policy_version": "trace-v1", "recovery_status": recovery, "recovery_action": action, "event_count": len(events), "budgets": budgets, **more}
    return {"run_export_version": 1, "manifest_digest": "sha256:m", "run_id": run_id, "data_class": "d", "training_use": "t", "checkpoint": point, "events": [{"sequence": k + 1, **e} for k, e in enumerate(events)]}


DENIED = [{"kind": "user_task"}, {"kind": "tool_call", "tool": "click"}, {"kind": "policy_decision", "decision": "deny"}, {"kind": "tool_result", "tool": "click", "status": "rejected", "dispatch": "not_dispatched", "code": "POLICY_DENIED"}, {"kind": "recovery", "status": "stopped"}]


def test_records(spark):
    runs = [
        export("a", events=DENIED, failure_code="POLICY_DENIED"),
        export("b", "SUCCESS", [{"kind": "tool_result", "tool": "x", "status": "ok", "dispatch": "unknown", "code": None}], used=1, recovery="ready", action="none"),
        export("c", "RUNNING", (), used=0, recovery="ready", action="none"),
    ]
    found = {r.source.run_id: r for r in reliability.reliability_records(spark.createDataFrame([(json.dumps(r, indent=2),) for r in runs], "raw string")).collect()}
    a = found["a"]
    assert a.labels.outcome_class == "failure" and a.labels.verifier_tags == ["failure", "policy_denial", "recovery_required", "budget_limit", "tool_sequence_available"]
    assert [tuple(t) for t in a.features.tool_sequence] == [(2, "click")] and [tuple(t) for t in a.features.recovery_events] == [(5, "stopped")]
    assert a.features.event_kind_counts.asDict() == {"user_task": 1, "observation": 0, "model_turn": 0, "tool_call": 1, "policy_decision": 1, "tool_result": 1, "recovery": 1}
    assert a.features.budgets.limit_hit.asDict() == {"model_turns": False, "tool_calls": True, "side_effects": False, "input_tokens": False}
    canonical = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    run_digest = "sha256:" + hashlib.sha256(canonical(runs[0])).hexdigest()
    identity = {"reliability_dataset_schema_version": 1, "manifest_digest": "sha256:m", "run_export_digest": run_digest}
    assert a.source.run_export_digest == run_digest and a.record_id == "sha256:" + hashlib.sha256(canonical(identity)).hexdigest()
    assert found["b"].labels.verifier_tags == ["unknown_outcome"] and found["b"].labels.outcome_class == "success"
    assert found["c"].labels.outcome_class == "in_progress" and found["c"].labels.verifier_tags == [] and found["c"].features.tool_sequence == []
    twice = spark.createDataFrame([(json.dumps(r),) for r in [runs[0], runs[0], runs[1]]], "raw string")
    assert [tuple(r) for r in reliability.repeated_runs(twice).collect()] == [("a", 2)]


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"a":[{"Secret":1,"b":{"c":"/etc/x"}}],"d":"https://h/x"}'), (2, "nope"), (3, None)], "k long, j string")
    assert [r[0] for r in df.select(documents.all_keys(F.col("j"))).collect()] == [["Secret", "a", "b", "c", "d"], [], []]
    assert [r[0] for r in df.select(documents.forbidden_keys(F.col("j"), ["secret"], True), documents.forbidden_keys(F.col("j"), ["secret"], False)).limit(1).collect()] == [["secret"]]
    assert [tuple(r) for r in documents.absolute_paths(df.where("k = 1"), "k", "j").collect()] == [(1, "$.a[0].b.c", "/etc/x")]
    answers = spark.createDataFrame([('Sure: {"a":1} and more',), ("no json",), ('{"a":',), (None,)], "t string")
    assert [r[0] for r in answers.select(documents.prefix_document(F.col("t"))).collect()] == ['{"a":1}', None, None, None]
    pairs = spark.createDataFrame([('{"a":[1,2]}', '{"a":[1,3]}'), ('{"a":1}', '{"a":true}'), ("[0.0]", "[-0.0]"), ('{"a":1}', '{"b":1}'), ("[1]", "[1]")], "l string, r string")
    assert [r[0] for r in pairs.select(documents.first_difference(F.col("l"), F.col("r"))).collect()] == ["$.a[1]", "$.a", "$[0]", "$", None]
    steps = spark.createDataFrame([("g", 2, "h2", "é"), ("g", 1, "h", "p")], "g string, o int, h string, p string")
    raw = b"".join(len(x).to_bytes(8, "big") + x for x in (b"h", b"p", b"h2", "é".encode()))
    assert documents.chained_digest(steps, "g", "o", "h", "p").first().digest == hashlib.sha256(raw).hexdigest()
    expected = list(range(9))
    random.Random(45).shuffle(expected)
    assert spark.range(1).select(documents.epoch_order(F.lit(9), F.lit(45))).first()[0] == expected
