"""Consent, action, verifier and governance queries: documents with one defect each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consent, grounding
from .contracts import Defect, defects_sql, with_defect
from .registry import query, spread, table

CONSENT = json.dumps({
    "consent_version": 1, "consent_id": "c-@id", "session_id": "s-@id", "decision": "granted",
    "operator_action": {"granted_at_utc": "2026-02-01T10:00:00Z", "expires_at_utc": "2026-02-01T12:00:00Z", "visible_indicator_acknowledged": True},
    "scope": {"data_classes": list(consent.DATA_CLASSES), "purposes": list(consent.PURPOSES), "application_scope": ["editor", "browser"], "network_upload_allowed": False},
    "capture_controls": {**dict.fromkeys(consent.TRUE_CONTROLS, True), **dict.fromkeys(consent.FALSE_CONTROLS, False)},
    "retention": {"policy_id": "p1", "max_days": 30, "delete_by_utc": "2026-03-03T10:00:00Z", "operator_delete_on_request": True},
    "forbidden_content": dict.fromkeys(consent.FORBIDDEN_CONTENT, True), "authority": {**dict.fromkeys(consent.NO_AUTHORITY, False), "state_verifier_required": True},
})
P = "$.consent"
CONSENT_DEFECTS: list[Defect] = [
    ("", "", None, None), ("}", "", "MALFORMED_JSON", "$"), ('"consent_version": 1', '"consent_version": 2', "UNSUPPORTED_VERSION", f"{P}.consent_version"), ('"decision": "granted"', '"decision": "refused"', "VALUE_MISMATCH", f"{P}.decision"), ('"c-@id"', '"C-@id"', "INVALID_IDENTIFIER", f"{P}.consent_id"),
    ('"expires_at_utc": "2026-02-01T12:00:00Z"', '"expires_at_utc": "2026-02-01T10:00:00Z"', "INVALID_CONSENT_WINDOW", f"{P}.operator_action"), ('"2026-02-01T12:00:00Z"', '"2026-02-30T12:00:00Z"', "INVALID_TIMESTAMP", f"{P}.operator_action.expires_at_utc"), ('"2026-02-01T10:00:00Z"', '"2026-02-01 10:00:00"', "INVALID_TIMESTAMP", f"{P}.operator_action.granted_at_utc"),
    ('"visible_indicator_acknowledged": true', '"visible_indicator_acknowledged": 1', "EXPECTED_TRUE", f"{P}.operator_action.visible_indicator_acknowledged"), ('"purposes": [', '"purposes": ["sale", ', "INVALID_VALUE", f"{P}.scope.purposes"), ('["editor", "browser"]', '["editor", "edit*"]', "WILDCARD_SCOPE_FORBIDDEN", f"{P}.scope.application_scope"),
    ('["editor", "browser"]', '["ALL"]', "WILDCARD_SCOPE_FORBIDDEN", f"{P}.scope.application_scope"), ('["editor", "browser"]', "[]", "EMPTY_ARRAY", f"{P}.scope.application_scope"), ('["editor", "browser"]', '["editor", "editor"]', "DUPLICATE_ARRAY_ITEM", f"{P}.scope.application_scope"), ('"network_upload_allowed": false', '"network_upload_allowed": true', "EXPECTED_FALSE", f"{P}.scope.network_upload_allowed"),
    ('"run_scoped": true', '"run_scoped": false', "EXPECTED_TRUE", f"{P}.capture_controls.run_scoped"), ('"background_capture": false', '"background_capture": true', "EXPECTED_FALSE", f"{P}.capture_controls.background_capture"), ('"max_days": 30', '"max_days": 91', "INVALID_INTEGER", f"{P}.retention.max_days"),
    ('"2026-03-03T10:00:00Z"', '"2026-03-03T10:00:01Z"', "INVALID_RETENTION_WINDOW", f"{P}.retention"), ('"2026-03-03T10:00:00Z"', '"2026-02-01T11:59:59Z"', "INVALID_RETENTION_WINDOW", f"{P}.retention"), ('"memory_database": true', '"memory_database": null', "EXPECTED_TRUE", f"{P}.forbidden_content.memory_database"),
    ('"grants_execution_permission": false', '"grants_execution_permission": true', "EXPECTED_FALSE", f"{P}.authority.grants_execution_permission"), ('"authority": {', '"authority": {"extra": 1, ', "UNKNOWN_FIELD", f"{P}.authority"),
]


@query(defects_sql("orders", "o_orderkey", CONSENT_DEFECTS))
def consent_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, retention, wildcards and control sets of a consent."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_defect(CONSENT, CONSENT_DEFECTS, F.col("o_orderkey")).alias("raw"))
    return grounding.document_violations(rows, ["o_orderkey"], "raw", consent.consent_rules)


A, B, R, V = (f"sha256:{x * 64}" for x in "abcd")
ACTION = json.dumps({"record_ref": R, "next_tool": "click", "arguments": {"n": 1}, "bbox": [1, 1, 5, 5], "ref": "r1", "risk_level": "low", "requires_approval": False, "confidence": 0.5, "should_reject": False, "should_fallback": False, "evidence_refs": [A, B], "execution_authority": "none"})
ENDS = ACTION.replace('"next_tool": "click", "arguments": {"n": 1}, "bbox": [1, 1, 5, 5], "ref": "r1"', '"next_tool": null, "arguments": {}, "bbox": null, "ref": null').replace('"should_reject": false', '"should_reject": true')
C = "$.candidate_action"
ACTION_DEFECTS: list[Defect] = [
    ("", "", None, None), (ACTION, ENDS, None, None), (ACTION, "7", "EXPECTED_OBJECT", C), (f'"record_ref": "{R}"', f'"record_ref": "{A}"', "ARTIFACT_ROLE_MISMATCH", f"{C}.record_ref"), (f'"record_ref": "{R}"', '"record_ref": "gone"', "UNKNOWN_ARTIFACT_REF", f"{C}.record_ref"),
    ('"next_tool": "click"', '"next_tool": "fly"', "UNAVAILABLE_TOOL", f"{C}.next_tool"), ('"n": 1', '"n": {}', "INVALID_ARGUMENT_VALUE", f"{C}.arguments"), ("[1, 1, 5, 5]", "[1, 1, 1, 5]", "INVALID_BBOX", f"{C}.bbox"), ('"confidence": 0.5', '"confidence": 1.5', "INVALID_CONFIDENCE", f"{C}.confidence"), ('"confidence": 0.5', '"confidence": true', "INVALID_CONFIDENCE", f"{C}.confidence"),
    (f'["{A}", "{B}"]', f'["{A}", "{A}"]', "DUPLICATE_ARRAY_ITEM", f"{C}.evidence_refs"), (f'["{A}", "{B}"]', f'["{A}", "sha256:{"e" * 64}"]', "UNKNOWN_ARTIFACT_REF", f"{C}.evidence_refs"), (f'["{A}", "{B}"]', f'["{A}", "{B}", "{V}"]', "CANDIDATE_EVIDENCE_NOT_PRE_OBSERVATION", f"{C}.evidence_refs"), (f'["{A}", "{B}"]', "[]", "EMPTY_ARRAY", f"{C}.evidence_refs"),
    ('"should_reject": false, "should_fallback": false', '"should_reject": true, "should_fallback": true', "INVALID_CANDIDATE_MODE", C), ('"should_fallback": false', '"should_fallback": true', "TERMINAL_ACTION_HAS_EXECUTION_FIELDS", C), (ACTION, ENDS.replace('"requires_approval": false', '"requires_approval": true'), "TERMINAL_ACTION_REQUIRES_APPROVAL", C),
    (ACTION, ENDS.replace('"should_reject": true', '"should_reject": false'), "ACTION_TOOL_REQUIRED", f"{C}.next_tool"), ('"next_tool": "click"', '"next_tool": "type"', "BBOX_NOT_SUPPORTED", f"{C}.bbox"), (f'["{A}", "{B}"]', f'["{A}"]', "BBOX_IMAGE_EVIDENCE_REQUIRED", f"{C}.evidence_refs"), ('"next_tool": "click"', '"next_tool": "point"', "REF_NOT_SUPPORTED", f"{C}.ref"),
    (f'["{A}", "{B}"]', f'["{B}"]', "REF_TEXT_EVIDENCE_REQUIRED", f"{C}.evidence_refs"), ('"execution_authority": "none"', '"execution_authority": "full"', "VALUE_MISMATCH", f"{C}.execution_authority"),
]
ROLES = {A: "uia_tree", B: "screenshot_or_crop", R: "model_candidate_action", V: "state_verifier_evidence"}


def roles():
    return F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))


@query(defects_sql("orders", "o_orderkey", ACTION_DEFECTS))
def candidate_action_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes, execution fields, tool support and evidence of a candidate action."""
    able = lambda box, ref: F.struct(F.lit(box).alias("supports_bbox"), F.lit(ref).alias("supports_ref"))
    tools = F.create_map(F.lit("click"), able(True, True), F.lit("type"), able(False, True), F.lit("point"), able(True, False))
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_defect(ACTION, ACTION_DEFECTS, F.col("o_orderkey")).alias("raw"))
    return grounding.document_violations(rows, ["o_orderkey"], "raw", lambda doc, scope: consent.action_rules(doc, scope, roles(), F.array(F.lit(A), F.lit(B)), tools))


VERIFIER = json.dumps({"source": "state_based", "label": "success", "evidence_refs": [B, V], "model_self_report_used": False})
W = "$.verifier"
VERIFIER_DEFECTS: list[Defect] = [
    ("", "", None, None), ('"state_based"', '"model"', "VALUE_MISMATCH", f"{W}.source"), ('"success"', '"fine"', "INVALID_ENUM", f"{W}.label"), (f'["{B}", "{V}"]', f'["{V}"]', "VERIFIER_EVIDENCE_INCOMPLETE", f"{W}.evidence_refs"), (f'["{B}", "{V}"]', f'["{B}", "{A}"]', "VERIFIER_EVIDENCE_INCOMPLETE", f"{W}.evidence_refs"),
    (f'["{B}", "{V}"]', f'["{A}", "{B}", "{V}"]', None, None), ('"model_self_report_used": false', '"model_self_report_used": true', "EXPECTED_FALSE", f"{W}.model_self_report_used"), (f'"{B}"', '"abc"', "INVALID_SHA256", f"{W}.evidence_refs"),
]


@query(defects_sql("orders", "o_orderkey", VERIFIER_DEFECTS))
def verifier_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was seen after the action is in the verifier's evidence, and its own too."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_defect(VERIFIER, VERIFIER_DEFECTS, F.col("o_orderkey")).alias("raw"))
    return grounding.document_violations(rows, ["o_orderkey"], "raw", lambda doc, scope: consent.verifier_rules(doc, scope, roles(), F.array(F.lit(B))))


GOVERNANCE = json.dumps(consent.GOVERNANCE)
Q = "$.governance"
GOVERNANCE_DEFECTS: list[Defect] = [
    ("", "", None, None), ('"synthetic_only": true', '"synthetic_only": false', "EXPECTED_TRUE", f"{Q}.synthetic_only"), ('"unassigned"', '"train"', "VALUE_MISMATCH", f"{Q}.dataset_split"), ('"training_eligible": false', '"training_eligible": true', "EXPECTED_FALSE", f"{Q}.training_eligible"),
    ('"execution_eligible": false', '"execution_eligible": "no"', "EXPECTED_FALSE", f"{Q}.execution_eligible"), ('"license_status": "pending_review", ', "", "MISSING_FIELD", Q), ("{", '{"claims": [], ', "UNKNOWN_FIELD", Q),
]


@query(defects_sql("orders", "o_orderkey", GOVERNANCE_DEFECTS))
def governance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance fields have the one value that each may have."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_defect(GOVERNANCE, GOVERNANCE_DEFECTS, F.col("o_orderkey")).alias("raw"))
    return grounding.document_violations(rows, ["o_orderkey"], "raw", lambda doc, scope: consent.constant_rules(scope.open(doc, consent.GOVERNANCE), consent.GOVERNANCE, Q))


@query("""
with t as (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 1 then '2026-02-29T00:00:00Z' when 2 then '2024-02-29T23:59:59Z' when 3 then '2026-01-01T00:00:00+00:00' else '2026-01-01T24:00:00Z' end as text from orders)
select o_orderkey, case o_orderkey % 5 when 0 then epoch(strptime(text, '%Y-%m-%dT%H:%M:%SZ'))::bigint when 2 then epoch(timestamp '2024-02-29 23:59:59')::bigint end as seconds from t""")
def utc_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of strict UTC times; other forms and days that don't exist are null."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, "2026-02-29T00:00:00Z").when(k == 2, "2024-02-29T23:59:59Z").when(k == 3, "2026-01-01T00:00:00+00:00").otherwise("2026-01-01T24:00:00Z")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(consent.utc_seconds(text)).alias("seconds"))
