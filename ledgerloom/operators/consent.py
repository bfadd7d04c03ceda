"""Consent, candidate actions, runtime decisions and governance of captured episodes.

One JSON document a row; see :mod:`.contracts`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import contracts as c
from .rules import Rule

#: Fixed values of the contract.
DATA_CLASSES = ("sanitized_instruction", "uia_document_ocr_observation", "screenshot_or_crop_reference", "model_candidate_action", "runtime_policy_or_approval_decision", "tool_result_and_post_action_observation", "state_verifier_label")
PURPOSES = ("multimodal_training_and_evaluation_review",)
TRUE_CONTROLS = ("disabled_by_default", "run_scoped", "separate_adapter", "separate_storage_namespace", "visible_indicator_required", "local_sanitization_before_write", "image_redaction_before_write", "content_addressed_artifacts", "deletion_supported")
FALSE_CONTROLS = ("automatic_runtime_export", "background_capture")
FORBIDDEN_CONTENT = ("api_keys_or_tokens", "assigned_secret_plaintext", "memory_database", "continuation_data", "cooperative_control_record", "authority_handoff_or_resume_state", "unredacted_sensitive_content")
NO_AUTHORITY = ("model_output_is_authority", "grants_execution_permission", "runtime_policy_bypass_allowed", "runner_mcp_desktop_bypass_allowed")
PART_FIELDS = {
    "operator_action": ("granted_at_utc", "expires_at_utc", "visible_indicator_acknowledged"), "scope": ("data_classes", "purposes", "application_scope", "network_upload_allowed"), "capture_controls": (*TRUE_CONTROLS, *FALSE_CONTROLS),
    "retention": ("policy_id", "max_days", "delete_by_utc", "operator_delete_on_request"), "forbidden_content": FORBIDDEN_CONTENT, "authority": (*NO_AUTHORITY, "state_verifier_required"),
}
IDENTIFIER, DIGEST = "[a-z0-9][a-z0-9._-]{0,127}", "sha256:[0-9a-f]{64}"
MOST_DAYS, MOST_ARGUMENTS, MOST_TEXT = 90, 20, 4096
RISKS = ("low", "medium", "high", "critical")
TEXT_ROLES, IMAGE_ROLE = ("uia_tree", "document_text", "ocr_text"), "screenshot_or_crop"
ACTION_FIELDS = ("record_ref", "next_tool", "arguments", "bbox", "ref", "risk_level", "requires_approval", "confidence", "should_reject", "should_fallback", "evidence_refs", "execution_authority")
GOVERNANCE = {"synthetic_only": True, "lane_b_capture_required_for_real_data": True, "dataset_split": "unassigned", "license_status": "pending_review", "training_eligible": False, "execution_eligible": False, "human_review_required": True}


def utc_seconds(text: Column) -> Column:
    """The time of ``2026-01-31T23:59:59Z``, to the second and in UTC; null for any other form or no such day."""
    good = F.coalesce(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"), F.lit(False))
    return F.when(good, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def _object(value: Column, fields, place: str) -> list[Rule]:
    return [("EXPECTED_OBJECT", place, ~c.is_object(value)), *c.exact(value, fields, place)]


def _flags(value: Column, true, false, place: str) -> list[Rule]:
    return [*(("EXPECTED_TRUE", f"{place}.{f}", ~c.is_true(c.at(value, f))) for f in true), *(("EXPECTED_FALSE", f"{place}.{f}", ~c.is_false(c.at(value, f))) for f in false)]


def _named(value: Column, field: str, place: str) -> list[Rule]:
    return [("INVALID_IDENTIFIER", f"{place}.{field}", ~c.matches(c.at(value, field), IDENTIFIER))]


def _time(value: Column, field: str, place: str) -> tuple[Column, list[Rule]]:
    at = utc_seconds(c.text_at(value, field))
    return at, [("INVALID_TIMESTAMP", f"{place}.{field}", at.isNull())]


def consent_rules(consent: Column, scope: c.Scope, place: str = "$.consent", version_field: str = "consent_version") -> list[Rule]:
    """A grant with a window, a scope without wildcards, control sets, and a retention window inside what it grants."""
    fields = (version_field, "consent_id", "session_id", "decision", *PART_FIELDS)
    consent = scope.open(consent, fields)
    get = lambda f: c.at(consent, f)
    operator, granted_scope, controls, retention, forbidden, authority = (scope.open(get(f), names) for f, names in PART_FIELDS.items())
    granted, is_granted = _time(operator, "granted_at_utc", f"{place}.operator_action")
    expires, is_expiry = _time(operator, "expires_at_utc", f"{place}.operator_action")
    delete_by, is_deletion = _time(retention, "delete_by_utc", f"{place}.retention")
    applications = scope.keep(c.strings(c.at(granted_scope, "application_scope")))
    listed = lambda f, values: [("INVALID_VALUE", f"{place}.scope.{f}", ~F.coalesce(c.strings(c.at(granted_scope, f)) == F.array(*map(F.lit, values)), F.lit(False)))]
    days = c.number_at(retention, "max_days")
    return [
        *_object(consent, fields, place),
        ("UNSUPPORTED_VERSION", f"{place}.{version_field}", ~c.is_exactly(get(version_field), 1)), *_named(consent, "consent_id", place), *_named(consent, "session_id", place), ("VALUE_MISMATCH", f"{place}.decision", ~c.is_exactly(get("decision"), "granted")),
        *_object(operator, PART_FIELDS["operator_action"], f"{place}.operator_action"), *is_granted, *is_expiry, *_flags(operator, ["visible_indicator_acknowledged"], [], f"{place}.operator_action"), ("INVALID_CONSENT_WINDOW", f"{place}.operator_action", expires <= granted),
        *_object(granted_scope, PART_FIELDS["scope"], f"{place}.scope"), *listed("data_classes", DATA_CLASSES), *listed("purposes", PURPOSES),
        ("EMPTY_ARRAY", f"{place}.scope.application_scope", F.size(applications) == 0), ("INVALID_STRING", f"{place}.scope.application_scope", ~c.all_texts(c.at(granted_scope, "application_scope"))), ("DUPLICATE_ARRAY_ITEM", f"{place}.scope.application_scope", c.repeats(applications)),
        ("WILDCARD_SCOPE_FORBIDDEN", f"{place}.scope.application_scope", F.exists(applications, lambda a: a.rlike(r"\*|\A(?i:all)\z"))), *_flags(granted_scope, [], ["network_upload_allowed"], f"{place}.scope"),
        *_object(controls, PART_FIELDS["capture_controls"], f"{place}.capture_controls"), *_flags(controls, TRUE_CONTROLS, FALSE_CONTROLS, f"{place}.capture_controls"),
        *_object(retention, PART_FIELDS["retention"], f"{place}.retention"), *_named(retention, "policy_id", f"{place}.retention"), ("INVALID_INTEGER", f"{place}.retention.max_days", ~c.is_integer(c.at(retention, "max_days"), 1, MOST_DAYS)),
        *is_deletion, *_flags(retention, ["operator_delete_on_request"], [], f"{place}.retention"), ("INVALID_RETENTION_WINDOW", f"{place}.retention", (delete_by < expires) | (delete_by > granted + F.make_dt_interval(days.try_cast("int")))),
        *_object(forbidden, FORBIDDEN_CONTENT, f"{place}.forbidden_content"), *_flags(forbidden, FORBIDDEN_CONTENT, [], f"{place}.forbidden_content"),
        *_object(authority, PART_FIELDS["authority"], f"{place}.authority"), *_flags(authority, ["state_verifier_required"], NO_AUTHORITY, f"{place}.authority"),
    ]


def evidence_rules(refs: Column, roles: Column, place: str) -> list[Rule]:
    """A list of distinct digests, each of a known artifact (``roles``: map of id to role)."""
    return [
        ("EMPTY_ARRAY", place, F.coalesce(F.size(refs), F.lit(0)) == 0), ("INVALID_SHA256", place, ~F.forall(refs, lambda r: F.coalesce(r.rlike(rf"\A{DIGEST}\z"), F.lit(False)))),
        ("DUPLICATE_ARRAY_ITEM", place, c.repeats(refs)), ("UNKNOWN_ARTIFACT_REF", place, F.exists(refs, lambda r: ~F.map_contains_key(roles, r))),
    ]


def outside(refs: Column, sources: Column) -> Column:
    """Some reference isn't among the sources."""
    return F.size(F.array_except(refs, sources)) > 0


def action_rules(action: Column, scope: c.Scope, roles: Column, before: Column, tools: Column, place: str = "$.candidate_action") -> list[Rule]:
    """C20: one mode, an end without execution fields, and grounding that the tool and its evidence support.

    ``roles``: role by artifact id; ``before``: ids seen before the action; ``tools``: struct(supports_bbox, supports_ref) by name.
    """
    action = scope.open(action, ACTION_FIELDS)
    get = lambda f: c.at(action, f)
    tool, box, ref = c.text_at(action, "next_tool"), ~c.is_null(get("bbox")), ~c.is_null(get("ref"))
    chosen = scope.keep(F.try_element_at(tools, tool))
    reject, fallback = c.is_true(get("should_reject")), c.is_true(get("should_fallback"))
    refs = scope.keep(c.strings(get("evidence_refs")))
    role = lambda wanted: F.exists(refs, lambda r: F.try_element_at(roles, r).isin(*wanted))
    n = F.transform(c.items_at(action, "bbox"), lambda x: F.when(c.is_integer(x, 0), x["said"].cast("bigint")))
    good_box = F.coalesce((F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull()) & (F.get(n, F.lit(2)) > F.get(n, F.lit(0))) & (F.get(n, F.lit(3)) > F.get(n, F.lit(1))), F.lit(False))
    values = c.values(get("arguments"))
    long = lambda x: F.coalesce(F.length(c.text(x)) > MOST_TEXT, F.lit(False))
    terminal = reject | fallback
    return [
        *_object(action, ACTION_FIELDS, place), ("UNKNOWN_ARTIFACT_REF", f"{place}.record_ref", ~F.map_contains_key(roles, c.text_at(action, "record_ref"))),
        ("ARTIFACT_ROLE_MISMATCH", f"{place}.record_ref", ~F.try_element_at(roles, c.text_at(action, "record_ref")).eqNullSafe(F.lit("model_candidate_action"))), ("UNAVAILABLE_TOOL", f"{place}.next_tool", ~c.is_null(get("next_tool")) & chosen.isNull()),
        ("EXPECTED_OBJECT", f"{place}.arguments", ~c.is_object(get("arguments"))), ("TOO_MANY_ARGUMENTS", f"{place}.arguments", F.size(c.keys_of(get("arguments"))) > MOST_ARGUMENTS), ("INVALID_ARGUMENT_VALUE", f"{place}.arguments", F.exists(values, lambda x: c.is_object(x) | c.is_list(x) | long(x))),
        ("INVALID_BBOX", f"{place}.bbox", box & ~good_box), ("INVALID_STRING", f"{place}.ref", ref & ~c.is_text(get("ref"))), ("INVALID_ENUM", f"{place}.risk_level", ~c.is_member(get("risk_level"), RISKS)),
        *(("EXPECTED_BOOLEAN", f"{place}.{f}", ~c.is_flag(get(f))) for f in ("requires_approval", "should_reject", "should_fallback")), ("INVALID_CONFIDENCE", f"{place}.confidence", ~c.is_number(get("confidence"), 0, 1)),
        *evidence_rules(refs, roles, f"{place}.evidence_refs"), ("CANDIDATE_EVIDENCE_NOT_PRE_OBSERVATION", f"{place}.evidence_refs", outside(refs, before)), ("VALUE_MISMATCH", f"{place}.execution_authority", ~c.is_exactly(get("execution_authority"), "none")),
        ("INVALID_CANDIDATE_MODE", place, reject & fallback), ("TERMINAL_ACTION_HAS_EXECUTION_FIELDS", place, terminal & (tool.isNotNull() | (F.size(c.keys_of(get("arguments"))) > 0) | box | ref)), ("TERMINAL_ACTION_REQUIRES_APPROVAL", place, terminal & c.is_true(get("requires_approval"))),
        ("ACTION_TOOL_REQUIRED", f"{place}.next_tool", ~terminal & chosen.isNull()), ("BBOX_NOT_SUPPORTED", f"{place}.bbox", box & ~F.coalesce(chosen["supports_bbox"], F.lit(False))), ("BBOX_IMAGE_EVIDENCE_REQUIRED", f"{place}.evidence_refs", box & ~role([IMAGE_ROLE])),
        ("REF_NOT_SUPPORTED", f"{place}.ref", ref & ~F.coalesce(chosen["supports_ref"], F.lit(False))), ("REF_TEXT_EVIDENCE_REQUIRED", f"{place}.evidence_refs", ref & ~role(TEXT_ROLES)),
    ]


def verifier_rules(verifier: Column, scope: c.Scope, roles: Column, after: Column, place: str = "$.verifier") -> list[Rule]:
    """A state-based label whose evidence holds all that was seen after the action, and the verifier's own."""
    fields = ("source", "label", "evidence_refs", "model_self_report_used")
    verifier = scope.open(verifier, fields)
    get = lambda f: c.at(verifier, f)
    refs = scope.keep(c.strings(get("evidence_refs")))
    own = F.exists(refs, lambda r: F.try_element_at(roles, r).eqNullSafe(F.lit("state_verifier_evidence")))
    return [
        *_object(verifier, fields, place), ("VALUE_MISMATCH", f"{place}.source", ~c.is_exactly(get("source"), "state_based")), ("INVALID_ENUM", f"{place}.label", ~c.is_member(get("label"), ("success", "failure", "unknown"))),
        *evidence_rules(refs, roles, f"{place}.evidence_refs"), ("VERIFIER_EVIDENCE_INCOMPLETE", f"{place}.evidence_refs", outside(after, refs) | ~own), *_flags(verifier, [], ["model_self_report_used"], place),
    ]


def constant_rules(value: Column, constants: dict[str, bool | str], place: str) -> list[Rule]:
    """Every field has the one value that it may have."""
    one = lambda f, x: c.is_exactly(c.at(value, f), x) if isinstance(x, str) else c.is_true(c.at(value, f)) if x else c.is_false(c.at(value, f))
    code = lambda x: "VALUE_MISMATCH" if isinstance(x, str) else "EXPECTED_TRUE" if x else "EXPECTED_FALSE"
    return [*_object(value, tuple(constants), place), *((code(x), f"{place}.{f}", ~one(f, x)) for f, x in constants.items())]
