"""Family manifests, bad-case taxonomies and remote listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contracts as c
from .router import CATEGORIES
from .rules import Rule

#: Fixed values of the contracts.
SPLITS = ("train", "validation")
MANIFEST_FIELDS, FAMILY_FIELDS = ("dataset_manifest_version", "tool_router_schema_version", "frozen_eval_digest", "families"), ("family_id", "split", "category", "description", "example_ids")
TAXONOMY_FIELDS = ("taxonomy_version", "source_eval_digest", "source_prediction_sha256", "source_report_sha256", "badcases", "overfitting", "repair_policy")
BADCASE_FIELDS = ("example_id", "repair_target", "failure_codes", "classification")
OVERFITTING_FIELDS = ("lowest_validation_loss_epoch", "lowest_validation_loss", "final_validation_loss", "classification")
POLICY = {"train_validation_only": True, "eval_answers_included": False, "frozen_eval_must_match": True, "training_performed": False}
DIGEST = "sha256:[0-9a-f]{64}"


def _object(value: Column, fields, place) -> list[Rule]:
    return [("EXPECTED_OBJECT", place, ~c.is_object(value)), *c.closed(value, c.literal(fields), c.literal(fields), place, "INVALID_KEYS", "INVALID_KEYS")]


def _at(place: str, i: Column, field: str = "") -> Column:
    return F.concat(F.lit(f"{place}["), i.cast("string"), F.lit("]" + (f".{field}" if field else "")))


def family_rules(manifest: Column, scope: c.Scope, place: str = "$") -> list[Rule]:
    """A5: versions, digest, families with distinct ids, and examples that are their split's and no other family's."""
    manifest = scope.open(manifest, MANIFEST_FIELDS)
    families = scope.open_items(c.at(manifest, "families"), FAMILY_FIELDS)
    ids = scope.keep(F.transform(families, lambda f: c.text_at(f, "family_id")))
    examples = scope.keep(F.transform(families, lambda f: F.coalesce(c.strings(c.at(f, "example_ids")), F.array().cast("array<string>"))))
    root = f"{place}.families"

    def family(f: Column, i: Column) -> list[Rule]:
        own = c.strings(c.at(f, "example_ids"))
        earlier = F.flatten(F.slice(examples, F.lit(1), i))
        prefix = F.concat(c.text_at(f, "split"), F.lit("-"))
        return [
            *_object(f, FAMILY_FIELDS, _at(root, i)), ("INVALID_FAMILY_ID", _at(root, i, "family_id"), ~c.matches(c.at(f, "family_id"), "family-[0-9]{3}")), ("DUPLICATE_FAMILY_ID", _at(root, i, "family_id"), F.array_contains(F.slice(ids, F.lit(1), i), c.text_at(f, "family_id"))),
            ("INVALID_FAMILY_SPLIT", _at(root, i, "split"), ~c.is_member(c.at(f, "split"), SPLITS)), ("INVALID_FAMILY_CATEGORY", _at(root, i, "category"), ~c.is_member(c.at(f, "category"), CATEGORIES)), ("INVALID_FAMILY_DESCRIPTION", _at(root, i, "description"), ~c.is_text(c.at(f, "description"))),
            ("INVALID_FAMILY_EXAMPLES", _at(root, i, "example_ids"), F.coalesce(F.size(own), F.lit(0)) == 0), ("INVALID_FAMILY_EXAMPLE_ID", _at(root, i, "example_ids"), ~F.forall(own, lambda e: F.coalesce(F.startswith(e, prefix), F.lit(False)))),
            ("DUPLICATE_FAMILY_EXAMPLE", _at(root, i), c.repeats(own) | F.arrays_overlap(own, earlier)),
        ]

    return [
        *_object(manifest, MANIFEST_FIELDS, place), *(("UNSUPPORTED_VERSION", f"{place}.{f}", ~c.is_exactly(c.at(manifest, f), 1)) for f in MANIFEST_FIELDS[:2]),
        ("INVALID_EVAL_DIGEST", f"{place}.frozen_eval_digest", ~c.matches(c.at(manifest, "frozen_eval_digest"), DIGEST)), ("INVALID_FAMILIES", root, F.coalesce(F.size(families), F.lit(0)) == 0), *c.nested(c.first_of_items(families, family)),
    ]


def taxonomy_rules(taxonomy: Column, scope: c.Scope, targets: list[str], epoch: int, place: str = "$") -> list[Rule]:
    """One bad case for each repair target, overfitting facts, and a policy of constants."""
    taxonomy = scope.open(taxonomy, TAXONOMY_FIELDS)
    cases = scope.open_items(c.at(taxonomy, "badcases"), BADCASE_FIELDS)
    ids = scope.keep(F.transform(cases, lambda b: c.text_at(b, "example_id")))
    root, fit = f"{place}.badcases", scope.open(c.at(taxonomy, "overfitting"), OVERFITTING_FIELDS)
    number = lambda f: c.double(c.at(fit, f))
    is_number = lambda f: c.is_any_number(c.at(fit, f))

    def case(b: Column, i: Column) -> list[Rule]:
        codes = c.at(b, "failure_codes")
        return [
            *_object(b, BADCASE_FIELDS, _at(root, i)), ("INVALID_BADCASE_ID", _at(root, i, "example_id"), ~c.matches(c.at(b, "example_id"), "eval-[0-9]{3}")), ("DUPLICATE_BADCASE_ID", _at(root, i, "example_id"), F.array_contains(F.slice(ids, F.lit(1), i), c.text_at(b, "example_id"))),
            ("INVALID_REPAIR_TARGET", _at(root, i, "repair_target"), ~c.is_member(c.at(b, "repair_target"), targets)), ("INVALID_FAILURE_CODES", _at(root, i, "failure_codes"), ~c.all_texts(codes) | (F.size(c.strings(codes)) == 0)), ("INVALID_BADCASE_CLASSIFICATION", _at(root, i, "classification"), ~c.is_text(c.at(b, "classification"))),
        ]

    policy = scope.open(c.at(taxonomy, "repair_policy"), POLICY)
    as_said = F.lit(True)
    for f, value in POLICY.items():
        as_said &= c.is_true(c.at(policy, f)) if value else c.is_false(c.at(policy, f))
    return [
        *_object(taxonomy, TAXONOMY_FIELDS, place), ("UNSUPPORTED_BADCASE_TAXONOMY", f"{place}.taxonomy_version", ~c.is_exactly(c.at(taxonomy, "taxonomy_version"), 1)),
        *(("INVALID_BADCASE_SOURCE_DIGEST", f"{place}.{f}", ~c.matches(c.at(taxonomy, f), DIGEST)) for f in TAXONOMY_FIELDS[1:4]), ("INVALID_BADCASE_COUNT", root, F.coalesce(F.size(cases), F.lit(0)) != len(targets)), *c.nested(c.first_of_items(cases, case)),
        ("INCOMPLETE_REPAIR_TARGETS", root, F.size(F.array_except(c.literal(targets), F.transform(cases, lambda b: c.text_at(b, "repair_target")))) > 0), *_object(fit, OVERFITTING_FIELDS, f"{place}.overfitting"),
        ("INVALID_OVERFITTING_EPOCH", f"{place}.overfitting.lowest_validation_loss_epoch", ~c.is_exactly(c.at(fit, "lowest_validation_loss_epoch"), epoch)),
        ("INVALID_OVERFITTING_EVIDENCE", f"{place}.overfitting", ~is_number("lowest_validation_loss") | ~is_number("final_validation_loss") | (number("final_validation_loss") <= number("lowest_validation_loss"))),
        ("INVALID_OVERFITTING_CLASSIFICATION", f"{place}.overfitting.classification", ~c.is_exactly(c.at(fit, "classification"), f"validation_overfitting_after_epoch_{epoch}")), *_object(policy, tuple(POLICY), f"{place}.repair_policy"), ("UNSAFE_REPAIR_POLICY", f"{place}.repair_policy", ~as_said),
    ]


def remote_files(listing: Column) -> Column:
    """The files of a remote listing by name: name, size, blob_id, and size and digest of what a pointer stands for."""
    files = F.transform(F.try_variant_get(listing, "$.siblings", "array<variant>"), lambda f: c.opened(f))
    large = lambda f, path, kind: F.try_variant_get(f["v"], path, kind)
    return F.array_sort(F.transform(files, lambda f: F.struct(
        c.text_at(f, "rfilename").alias("name"), c.number_at(f, "size").try_cast("bigint").alias("size"), c.text_at(f, "blobId").alias("blob_id"),
        F.when(c.is_object(c.at(f, "lfs")), F.struct(large(f, "$.lfs.pointerSize", "bigint").alias("pointer_size"), large(f, "$.lfs.sha256", "string").alias("sha256"), large(f, "$.lfs.size", "bigint").alias("size"))).alias("lfs"),
    )))


def content_bindings(expected: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """What each expected path (path, binding_kind) is bound to: local bytes of a blob, or the remote entry of a large file.

    ``local``: path, content (binary); ``remote``: name, blob_id, lfs.  A missing side gives null values.
    """
    there = expected.join(local.select("path", F.length("content").cast("long").alias("__bytes"), F.sha2("content", 256).alias("__sha"), F.sha1(F.concat(F.to_binary(F.concat(F.lit("blob "), F.length("content").cast("string"), F.char(F.lit(0))), F.lit("utf-8")), "content")).alias("__blob")), "path", "left")
    both = there.join(remote.select(F.col("name").alias("path"), "blob_id", "lfs"), "path", "left")
    blob = F.col("binding_kind") == "git_blob"
    return both.select("path", "binding_kind", F.when(blob, F.col("__bytes")).otherwise(F.col("lfs.size")).alias("bytes"), F.concat(F.lit("sha256:"), F.when(blob, F.col("__sha")).otherwise(F.col("lfs.sha256"))).alias("sha256"), F.when(blob, F.col("__blob")).otherwise(F.col("blob_id")).alias("git_blob_sha1"), F.when(~blob, F.col("lfs.pointer_size")).alias("pointer_bytes"))
