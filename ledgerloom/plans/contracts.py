"""Contract queries: documents made from the driver's tables, one defect each, against the rule that each must break.

The SQL states the code and location that follow from the defect itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import exports
from .registry import query, spread, table

#: (what is replaced in a sound document, by what, code, location); the first is no defect.
Defect = tuple[str, str, str | None, str | None]


def with_defect(template: str, defects: list[Defect], number: Column) -> Column:
    """The template for the number, with the defect that it chooses."""
    chosen = F.pmod(number, F.lit(len(defects))).cast("int") + 1
    pick = lambda k: F.element_at(F.array(*(F.lit(d[k]) for d in defects)), chosen)
    named = F.replace(F.lit(template), F.lit("@id"), number.cast("string"))
    return F.replace(named, F.replace(pick(0), F.lit("@id"), number.cast("string")), pick(1))


def with_two_defects(template: str, defects: list[Defect], number: Column, unreadable: int) -> Column:
    """The template with the two defects that the number chooses, the earlier one first; ``defects`` stand in the order of the rules.

    The first ``unreadable`` of them leave no document to judge: the second defect is none of those.
    """
    n = len(defects)
    a, b = F.pmod(number, F.lit(n)), unreadable + F.pmod(F.floor(number / n), F.lit(n - unreadable))
    pick = lambda k, at: F.element_at(F.array(*(F.lit(d[k]) for d in defects)), at.cast("int") + 1)
    named = lambda text: F.replace(text, F.lit("@id"), number.cast("string"))
    out = named(F.lit(template))
    first, second = F.least(a, b), F.greatest(a, b)
    out = F.replace(out, named(pick(0, first)), pick(1, first))
    return F.when(a == b, out).otherwise(F.replace(out, named(pick(0, second)), pick(1, second)))


def two_defects_sql(source: str, key: str, defects: list[Defect], unreadable: int) -> str:
    """Of the two defects the one that stands first in the rules' order is reported; the last of the list is none."""
    values = ", ".join(f"({k}, {sql_text(code)}, {sql_text(location)})" for k, (_, _, code, location) in enumerate(defects))
    n = len(defects)
    return f"select {key}, code, location from {source} join (values {values}) v(d, code, location) on least({key} % {n}, {unreadable} + ({key} // {n}) % {n - unreadable}) = d"


def sql_text(value: str | None) -> str:
    return "null::varchar" if value is None else "'" + value.replace("'", "''") + "'"


def defects_sql(source: str, key: str, defects: list[Defect]) -> str:
    values = ", ".join(f"({k}, {sql_text(code)}, {sql_text(location)})" for k, (_, _, code, location) in enumerate(defects))
    return f"select {key}, code, location from {source} join (values {values}) v(d, code, location) on {key} % {len(defects)} = d"


TOOL = {"name": "look", "description": "Looks", "input_schema": {"type": "object"}, "effect": "observation", "result_content": "text", "result_sensitivity": "normal", "redaction_policy": "none", "grounding": "none", "requires_host_approval": False, "invalidates_observation": False, "sensitive_arguments": [], "required_safety_baselines": ["b1"]}
MANIFEST = json.dumps({"manifest_version": 1, **exports.MANIFEST_VERSIONS, "tools": [TOOL, {**TOOL, "name": "press", "effect": "side_effect"}], "automatic_export": dict.fromkeys(exports.EXPORT_DECLARATIONS, False)})
MANIFEST_DEFECTS: list[Defect] = [
    ("{", "[", "MALFORMED_JSON", "manifest"), ('"tools": [', '"tools": [], "tools": [', "DUPLICATE_JSON_KEY", "manifest"), ('"trace_version": 1', '"trace_version": -Infinity', "NONFINITE_NUMBER", "manifest"),
    (', "checkpoint_version": 1', "", "MISSING_FIELD", "manifest"), ('"tools"', '"extra": null, "tools"', "UNKNOWN_FIELD", "manifest"), ('"manifest_version": 1', '"manifest_version": 2', "UNSUPPORTED_VERSION", "manifest.manifest_version"),
    ('"agent_contract_version": "0.1.0"', '"agent_contract_version": "0.2.0"', "UNSUPPORTED_VERSION", "manifest.agent_contract_version"), ('"trace_version": 1', '"trace_version": 1.5', "UNSUPPORTED_VERSION", "manifest.trace_version"),
    ('"contains_images": false', '"contains_images": true', "UNSAFE_AUTOMATIC_EXPORT", "manifest.automatic_export"), (', "contains_memory": false', "", "UNSAFE_AUTOMATIC_EXPORT", "manifest.automatic_export"),
    ('"name": "look", "description": "Looks", ', '"name": "look", ', "MISSING_FIELD", "manifest.tools[0]"), ('"name": "look"', '"name": 5', "INVALID_TYPE", "manifest.tools[0].name"), ('"type": "object"', '"type": [0, -2e400]', "NONFINITE_NUMBER", "manifest.tools[0].input_schema.type[1]"),
    ('"requires_host_approval": false', '"requires_host_approval": 0', "INVALID_TYPE", "manifest.tools[0].requires_host_approval"), ('["b1"]', '["b1", "b1"]', "DUPLICATE_VALUE", "manifest.tools[0].required_safety_baselines"),
    ('"name": "press"', '"name": "look"', "DUPLICATE_TOOL", "manifest.tools[1].name"), ('"name": "press"', '"name": ""', "INVALID_TYPE", "manifest.tools[1].name"), ('"effect": "side_effect"', '"effect": "none"', "INVALID_VALUE", "manifest.tools[1].effect"), ("", "", None, None),
]


@query(two_defects_sql("part", "p_partkey", MANIFEST_DEFECTS, 3))
def manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each manifest breaks, of two defects the one whose rule comes first."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", with_two_defects(MANIFEST, MANIFEST_DEFECTS, F.col("p_partkey"), 3).alias("raw"))
    return exports.manifest_violations(rows, "p_partkey", "raw")


DIGEST = "sha256:" + "0" * 64
EVENTS = [
    {"kind": "user_task", "task_length": 12}, {"kind": "observation", "tool": "look", "observation_epoch": 1},
    {"kind": "model_turn", "text_length": 3, "tool_call_count": 1, "input_tokens": 9, "output_tokens": 4, "latency_ms": 80}, {"kind": "policy_decision", "decision": "allow"},
    {"kind": "tool_call", "tool": "press", "arguments": {"where": {"x": [1, 2.5, None, "say \"text\": no"]}}, "redacted_fields": ["title"]},
    {"kind": "tool_result", "tool": "press", "status": "success", "dispatch": "dispatched", "text_length": 0, "image_count": 1, "code": "OK"}, {"kind": "recovery", "status": "ready"},
]
RUN = json.dumps({
    "run_export_version": 1, "manifest_digest": DIGEST, "run_id": "run-@id", "data_class": "redacted_runtime_evidence", "training_use": "reliability_and_verifier_only",
    "checkpoint": {
        "checkpoint_version": 1, "checkpoint_sequence": 3, "run_id": "run-@id", "phase": "SUCCESS", "policy_version": "p1", "recovery_status": "ready", "task_length": 12, "observation_epoch": 1, "verified_observation_epoch": None,
        "event_count": 7, "budgets": {"max_model_turns": 5, "model_turns_used": 1, "max_tool_calls": 5, "tool_calls_used": 1, "max_side_effects": 2, "side_effects_used": 1, "max_input_tokens": 900, "input_tokens_used": 9},
        "updated_at": "2026-01-01T00:00:00Z", "metrics": dict.fromkeys(exports.METRICS, 1), "resume_allowed": False, "recovery_action": "none", "failure_code": "NONE",
    },
    "events": [{"trace_version": 1, "sequence": k, "run_id": "run-@id", **e} for k, e in enumerate(EVENTS, 1)],
})
#: An integer that no machine word holds, and one greater.
LONG = "9" * 46
RUN_DEFECTS: list[Defect] = [
    ('"code": "OK"}', '"code": "OK"}]}, {"a": [{}', "MALFORMED_JSON", "run_export"), ('{"run_export_version"', '[] {"run_export_version"', "MALFORMED_JSON", "run_export"), ('{"run_export_version"', '{"x": 1}] {"run_export_version"', "MALFORMED_JSON", "run_export"), ('"run_id"', '"run_id', "MALFORMED_JSON", "run_export"),
    ('"phase"', '"phase": "SUCCESS", "phase"', "DUPLICATE_JSON_KEY", "run_export"), ('"text_length": 3', '"text_length": NaN', "NONFINITE_NUMBER", "run_export"),
    (', "training_use": "reliability_and_verifier_only"', "", "MISSING_FIELD", "run_export"), ('"data_class"', '"more": 1, "data_class"', "UNKNOWN_FIELD", "run_export"), ('"run_export_version": 1', '"run_export_version": 2', "UNSUPPORTED_VERSION", "run_export.run_export_version"),
    ('"run_export_version": 1', '"run_export_version": true', "UNSUPPORTED_VERSION", "run_export.run_export_version"), ('"sha256:0', '"sha256:1', "MANIFEST_DIGEST_MISMATCH", "run_export.manifest_digest"), ('"redacted_runtime_evidence"', '"raw"', "INVALID_DATA_CLASS", "run_export.data_class"),
    ('"reliability_and_verifier_only"', '"any"', "INVALID_TRAINING_USE", "run_export.training_use"), ('"policy_version": "p1", ', "", "MISSING_FIELD", "run_export.checkpoint"),
    ('"checkpoint_sequence": 3, "run_id": "run-@id"', '"checkpoint_sequence": 3, "run_id": "run-x"', "RUN_ID_MISMATCH", "run_export.checkpoint.run_id"), ('"checkpoint_sequence": 3', '"checkpoint_sequence": 1e999', "INVALID_TYPE", "run_export.checkpoint.checkpoint_sequence"),
    ('"phase": "SUCCESS"', '"phase": "DONE"', "INVALID_VALUE", "run_export.checkpoint.phase"), ('"resume_allowed": false', '"resume_allowed": "no"', "INVALID_TYPE", "run_export.checkpoint.resume_allowed"), ('"failure_code": "NONE"', '"failure_code": ""', "INVALID_TYPE", "run_export.checkpoint.failure_code"),
    ('"max_side_effects": 2', f'"max_side_effects": -{LONG}', "INVALID_TYPE", "run_export.checkpoint.budgets.max_side_effects"), ('"max_tool_calls": 5, "tool_calls_used": 1', f'"max_tool_calls": {LONG}, "tool_calls_used": {LONG}1', "INVALID_VALUE", "run_export.checkpoint.budgets.tool_calls_used"), ('"retry_count": 1', f'"retry_count": {LONG}.5', "INVALID_TYPE", "run_export.checkpoint.metrics.retry_count"),
    ('"event_count": 7', '"event_count": 8', "INCOMPLETE_EVENTS", "run_export.events"), ('"kind": "observation"', '"kind": "glance"', "UNKNOWN_EVENT_KIND", "run_export.events[1].kind"), (', "latency_ms": 80', "", "MISSING_FIELD", "run_export.events[2]"),
    ('"decision": "allow"', '"decision": "allow", "note": 1', "UNKNOWN_FIELD", "run_export.events[3]"), ('"sequence": 4', '"sequence": 5', "INCOMPLETE_EVENTS", "run_export.events[3].sequence"), ('"decision": "allow"', '"decision": "perhaps"', "INVALID_VALUE", "run_export.events[3].decision"),
    ("2.5", "1e999", "NONFINITE_NUMBER", "run_export.events[4].arguments.where.x[1]"), ('["title"]', '["title", "title"]', "DUPLICATE_VALUE", "run_export.events[4].redacted_fields"),
    ('"dispatch": "dispatched"', '"dispatch": "sent"', "INVALID_VALUE", "run_export.events[5].dispatch"), ('"code": "OK"', '"code": 0', "INVALID_TYPE", "run_export.events[5].code"), ('"kind": "user_task", "task_length": 12', '"kind": "user_task", "task_length": 13', "INCOMPLETE_EVENTS", "run_export.events[0]"),
    ('"arguments": {', '"arguments": {"Raw_Task": 0, ', "FORBIDDEN_RICH_FIELD", "run_export.events[4].arguments.Raw_Task"), ('{"x":', '{"s\\u0063reenshot": 1, "x":', "FORBIDDEN_RICH_FIELD", "run_export.events[4].arguments.where.screenshot"),
    ('"retry_count": 1', f'"retry_count": {LONG}', None, None), ("", "", None, None),
]


@query(two_defects_sql("orders", "o_orderkey", RUN_DEFECTS, 6))
def run_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each run export breaks, malformed documents included; of two defects the one whose rule comes first."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_two_defects(RUN, RUN_DEFECTS, F.col("o_orderkey"), 6).alias("raw"))
    return exports.run_violations(rows, "o_orderkey", "raw", F.lit(DIGEST))


@query("select doc_id, doc_id % 5 = 0 as too_deep, case doc_id % 5 when 1 then ['memory'] when 2 then ['Memory', 'image'] else [] end as found, case when doc_id % 5 = 2 then ['image'] when doc_id % 5 = 1 then ['memory'] else [] end as found_exact from documents")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys at any depth, with and without regard to case, and on documents that are no JSON."""
    from ..operators import documents

    texts = F.array(F.lit("{"), F.lit('{"a":[{"memory":1}]}'), F.lit('{"a":{"image":[{"Memory":null}]}}'), F.lit('{"a":"memory"}'), F.lit("[]"))
    raw = F.element_at(texts, (F.col("doc_id") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    folded = F.filter(documents.all_keys(F.col("raw")), lambda k: F.lower(k).isin("memory", "image"))
    return df.select("doc_id", F.try_parse_json("raw").isNull().alias("too_deep"), folded.alias("found"), documents.forbidden_keys(F.col("raw"), ["image", "memory"], fold_case=False).alias("found_exact"))


@query("select doc_id, sha256('{\"a\":' || (doc_id % 8) || '.5,\"doc_id\":' || doc_id || '}') as digest from documents")
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of documents whose keys, spaces and floats are written in another way than the canonical one."""
    raw = F.concat(F.lit('{ "doc_id" : '), F.col("doc_id").cast("string"), F.lit(', "a": '), (F.col("doc_id") % 8).cast("string"), F.lit(".500}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(identity.digest(identity.canonical_json(raw)), 8, 64).alias("digest"))
