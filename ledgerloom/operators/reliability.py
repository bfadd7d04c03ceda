"""Run exports to reliability records.

A run export is one JSON document with a bounded list of events, so a record is made from
its own row alone: higher-order functions over the event array, no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_json, canonical_struct, digest
from .traces import tags

#: Fixed values of the record contract, version 1.
SCHEMA_VERSION = 1
KINDS = ("user_task", "observation", "model_turn", "tool_call", "policy_decision", "tool_result", "recovery")
OUTCOMES = {"SUCCESS": "success", "FAILED": "failure", "UNKNOWN_OUTCOME": "unknown_outcome", "CANCELLED": "cancelled", "PAUSED": "paused"}
RECOVERY_ACTIONS = ("human_reobserve_then_start_new_run", "inspect_trace_then_start_new_run")
BUDGETS = ("model_turns", "tool_calls", "side_effects", "input_tokens")

RUN_EXPORT = f"""
manifest_digest string, run_id string, data_class string, training_use string,
checkpoint struct<checkpoint_version:int, phase:string, policy_version:string, recovery_status:string, recovery_action:string, failure_code:string, event_count:long,
  budgets:struct<{", ".join(f"max_{b}:long, {b}_used:long" for b in BUDGETS)}>>,
events array<struct<sequence:long, kind:string, tool:string, status:string, dispatch:string, code:string, decision:string>>"""


def events_of(kind: str, *fields: str) -> Column:
    """The events of a kind with the given fields, in the order of the trace."""
    chosen = F.filter("run.events", lambda e: e["kind"] == kind)
    return F.transform(chosen, lambda e: F.struct(*(e[f].alias(f) for f in fields)))


def some(array: Column, condition) -> Column:
    """True if any element fulfils it; nulls and empty arrays don't."""
    return F.coalesce(F.exists(array, lambda e: F.coalesce(condition(e), F.lit(False))), F.lit(False))


def reliability_records(exports: DataFrame, raw: str = "raw", manifest_version: int = 1, trace_version: int = 1, version_field: str = "run_export_version", runtime_commit: str | None = None, consumer_version: str | None = None) -> DataFrame:
    """One record for each run export (JSON text in ``raw``): identities, features and labels.

    ``version_field``: the top-level key under which the exports state their own version; ``runtime_commit`` and
    ``consumer_version``: what the records say they were made from and by.  Exports are to be valid (:mod:`.exports`);
    of others a missing phase is no failure, and a missing recovery status not ready.
    """
    version = F.get_json_object(raw, f"$.{version_field}").cast("int")
    runs = exports.select(F.from_json(raw, RUN_EXPORT).alias("run"), version.alias("version"), digest(canonical_json(raw)).alias("run_export_digest"))
    point = F.col("run.checkpoint")
    outcomes = events_of("tool_result", "sequence", "tool", "status", "dispatch", "code")
    decisions, recoveries = events_of("policy_decision", "sequence", "decision"), events_of("recovery", "sequence", "status")
    budget = lambda f: F.struct(*(f(b).alias(b) for b in sorted(BUDGETS)))
    most, used = (lambda b: point["budgets"][f"max_{b}"]), (lambda b: point["budgets"][f"{b}_used"])
    hit = lambda b: F.coalesce((most(b) > 0) & (used(b) >= most(b)), F.lit(False))
    outcome = F.coalesce(*(F.when(point["phase"] == phase, F.lit(name)) for phase, name in OUTCOMES.items()), F.lit("in_progress"))
    made = runs.withColumns({
        "outcome_class": outcome,
        "is_failure": F.coalesce(point["phase"].isin("FAILED", "UNKNOWN_OUTCOME"), F.lit(False)),
        "is_unknown_outcome": point["phase"].eqNullSafe(F.lit("UNKNOWN_OUTCOME")) | some(outcomes, lambda e: (e["status"] == "unknown_outcome") | (e["dispatch"] == "unknown")),
        "policy_denied": some(decisions, lambda e: e["decision"] == "deny") | some(outcomes, lambda e: e["code"] == "POLICY_DENIED"),
        "recovery_required": ~point["recovery_status"].eqNullSafe(F.lit("ready")) | F.coalesce(point["recovery_action"].isin(*RECOVERY_ACTIONS), F.lit(False)) | some(recoveries, lambda e: e["status"] != "ready"),
        "budget_limit_hit": F.lit(False) | hit(BUDGETS[0]) | hit(BUDGETS[1]) | hit(BUDGETS[2]) | hit(BUDGETS[3]),
    })
    identity = canonical_struct(reliability_dataset_schema_version=F.lit(SCHEMA_VERSION), manifest_digest=F.col("run.manifest_digest"), run_export_digest=F.col("run_export_digest"))
    calls = events_of("tool_call", "sequence", "tool")
    features = F.struct(
        point["phase"].alias("phase"), point["recovery_status"].alias("recovery_status"), point["recovery_action"].alias("recovery_action"), point["failure_code"].alias("failure_code"), point["event_count"].alias("event_count"),
        F.struct(*(F.size(events_of(k, "sequence")).cast("long").alias(k) for k in sorted(KINDS))).alias("event_kind_counts"),
        calls.alias("tool_sequence"), outcomes.alias("tool_outcomes"), decisions.alias("policy_decisions"), recoveries.alias("recovery_events"),
        F.struct(budget(most).alias("limits"), budget(used).alias("used"), budget(hit).alias("limit_hit")).alias("budgets"),
    )
    labels = F.struct(
        "outcome_class", "is_failure", "is_unknown_outcome", "policy_denied", "recovery_required", "budget_limit_hit",
        tags(failure=F.col("is_failure"), unknown_outcome=F.col("is_unknown_outcome"), policy_denial=F.col("policy_denied"), recovery_required=F.col("recovery_required"), budget_limit=F.col("budget_limit_hit"), tool_sequence_available=F.size(calls) > 0).alias("verifier_tags"),
    )
    source = F.struct(
        F.lit(runtime_commit).cast("string").alias("runtime_git_commit"), F.lit(consumer_version).cast("string").alias("consumer_schema_version"), F.lit(manifest_version).alias("manifest_version"), F.col("version").alias("run_export_version"), F.col("run.manifest_digest").alias("manifest_digest"), "run_export_digest",
        F.col("run.run_id").alias("run_id"), F.lit(trace_version).alias("trace_version"), point["checkpoint_version"].alias("checkpoint_version"), point["policy_version"].alias("policy_version"),
    )
    return made.select(F.lit(SCHEMA_VERSION).alias("reliability_dataset_schema_version"), digest(identity).alias("record_id"), source.alias("source"), F.col("run.data_class").alias("data_class"), F.col("run.training_use").alias("training_use"), features.alias("features"), labels.alias("labels"))


def repeated_runs(exports: DataFrame, raw: str = "raw") -> DataFrame:
    """Run ids that more than one export claims."""
    return exports.groupBy(F.get_json_object(raw, "$.run_id").alias("run_id")).agg(F.count("*").alias("n")).where("n > 1")
