"""Grounding cases and predictions: contracts and exact scores.

A case is one JSON text a row, of a suite and with its place in it.  Suites that are read as files are
short by contract (``MOST_CASES``, ``plans`` and :func:`suite_violations` hold them to it); scores hold for suites of any size.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import lexical
from ..functions.geometry import iou, valid_box
from . import contracts as c
from .rules import Rule
from .score import ratio

#: Fixed values of the contract.
MODES, CAPABILITIES, OCR = ("uia_only", "screenshot_only", "fused"), ("ref_grounding", "bbox_grounding", "fused_grounding"), ("clean", "missing", "noisy")
PERTURBATIONS = ("none", "moved", "occluded", "stale_ref", "coordinate_ref_disagreement")
TERMINAL = {"stale_ref": ("reject", "stale_ref"), "coordinate_ref_disagreement": ("reject", "coordinate_ref_disagreement"), "occluded": ("fallback", "insufficient_visual_evidence")}
IDENTIFIER = "[a-z0-9][a-z0-9._-]{0,95}"
MOST_CASES, MOST_ITEMS, MOST_TOOLS, MOST_ARGUMENTS, MOST_TEXT, MOST_PLACE = 64, 32, 16, 16, 2048, 4096
CASE_FIELDS = ("case_id", "family_id", "capability", "observation_mode", "ocr_condition", "perturbation", "model_input", "gold")
GOLD_FIELDS = ("disposition", "tool", "arguments", "ref", "bbox", "target_id", "reason", "target_catalog")
PREDICTION_FIELDS = ("case_id", "disposition", "tool", "arguments", "ref", "bbox", "reason")
DISPOSITIONS = ("act", "reject", "fallback")

BOX = "array<int>"
GOLD = f"struct<disposition:string, tool:string, arguments:map<string,string>, ref:string, bbox:{BOX}, target_id:string, reason:string, target_catalog:array<struct<target_id:string, ref:string, bbox:{BOX}>>>"
PREDICTION = f"struct<disposition:string, tool:string, arguments:map<string,string>, ref:string, bbox:{BOX}, reason:string>"


def is_box(value: Column) -> Column:
    """Four integers from 0 to 4096 that span an area."""
    place = lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    good = lambda n: (F.size(n) == 4) & F.forall(n, lambda x: F.coalesce(x.between(0, MOST_PLACE), F.lit(False))) & (F.get(n, F.lit(0)) < F.get(n, F.lit(2))) & (F.get(n, F.lit(1)) < F.get(n, F.lit(3)))
    return F.coalesce(c.bound(F.transform(F.try_variant_get(value["v"], "$", "array<variant>"), place), good), F.lit(False))


def _text(value: Column, place) -> list[Rule]:
    short = F.coalesce(F.length(c.text(value)) <= MOST_TEXT, F.lit(False))
    return [("EXPECTED_STRING", place, ~c.is_string(value)), ("INVALID_STRING", place, ~(c.is_text(value) & short))]


def _identifier(value: Column, place) -> list[Rule]:
    return [("EXPECTED_STRING", place, ~c.is_string(value)), ("INVALID_IDENTIFIER", place, ~c.matches(value, IDENTIFIER))]


def _enum(value: Column, allowed, place) -> list[Rule]:
    return [("EXPECTED_STRING", place, ~c.is_string(value)), ("INVALID_ENUM", place, ~c.is_member(value, allowed))]


def _object(value: Column, fields, place) -> list[Rule]:
    return [("EXPECTED_OBJECT", place, ~c.is_object(value)), *c.exact(value, fields, place)]


def _unless_null(value: Column, rules: list[Rule]) -> list[Rule]:
    return [(code, place, ~c.is_null(value) & broken) for code, place, broken in rules]


def _box(value: Column, place) -> list[Rule]:
    return [("EXPECTED_ARRAY", place, ~c.is_list(value)), ("INVALID_BBOX", place, ~is_box(value))]


def _where(condition: Column, rules: list[Rule]) -> list[Rule]:
    return [(code, place, condition & broken) for code, place, broken in rules]


def _null(value: Column, fields, place: str) -> list[Rule]:
    return [("EXPECTED_NULL", f"{place}.{f}", ~c.is_null(c.at(value, f))) for f in fields]


def _arguments(value: Column, place: str) -> list[Rule]:
    values = c.values(value)
    long = lambda x: F.coalesce(F.length(c.text(x)) > MOST_TEXT, F.lit(False))
    return [
        ("EXPECTED_OBJECT", place, ~c.is_object(value)), ("TOO_MANY_ARGUMENTS", place, F.size(c.keys_of(value)) > MOST_ARGUMENTS),
        ("INVALID_IDENTIFIER", f"{place}.key", ~F.forall(c.keys_of(value), lambda k: k.rlike(rf"\A(?:{IDENTIFIER})\z"))),
        ("STRING_TOO_LONG", place, F.exists(values, long)), ("INVALID_ARGUMENT_VALUE", place, F.exists(values, lambda x: c.is_object(x) | c.is_list(x))),
    ]


def _shape(capability: Column, ref: Column, box: Column) -> Column:
    """Whether a reference and a box are as the capability asks."""
    return F.when(capability == "ref_grounding", ref & ~box).when(capability == "bbox_grounding", ~ref & box).otherwise(ref & box)


def _items(value: Column, scope: c.Scope, name: str, place: str, fields, own, key: str, many: str, repeated: str) -> list[Rule]:
    items = scope.open_items(c.at(value, name), fields)
    names = scope.keep(F.transform(items, lambda x: c.text_at(x, key)))

    def one(x: Column, i: Column) -> list[Rule]:
        at = F.concat(F.lit(f"{place}.{name}["), i.cast("string"), F.lit("]"))
        field = lambda f: F.concat(at, F.lit(f".{f}"))
        return [*_object(x, fields, at), *_identifier(c.at(x, key), field(key)), (repeated, field(key), F.array_contains(F.slice(names, F.lit(1), i), c.text_at(x, key))), *own(x, field)]

    return [("EXPECTED_ARRAY", f"{place}.{name}", items.isNull()), (many, f"{place}.{name}", F.size(items) > MOST_ITEMS), *c.nested(c.first_of_items(items, one))]


def input_rules(case: Column, given: Column, tools: Column, scope: c.Scope, place: str) -> list[Rule]:
    mode, capability = c.text_at(case, "observation_mode"), c.text_at(case, "capability")
    seen = scope.open(c.at(given, "observation"), ("uia_controls", "screenshot_regions", "ocr_text", "grounding_cue"))
    cue, ocr = scope.open(c.at(seen, "grounding_cue"), ("ref", "bbox")), c.at(seen, "ocr_text")
    controls, regions = c.length_at(seen, "uia_controls") > 0, c.length_at(seen, "screenshot_regions") > 0
    fits = F.when(mode == "uia_only", controls & ~regions).when(mode == "screenshot_only", ~controls & regions).otherwise(controls & regions)
    at = f"{place}.model_input"
    view = f"{at}.observation"
    tool = lambda x, i: _identifier(x, F.concat(F.lit(f"{at}.available_tools["), i.cast("string"), F.lit("]")))
    control = lambda x, field: [*_text(c.at(x, "role"), field("role")), *_text(c.at(x, "name"), field("name")), *_enum(c.at(x, "state"), ("enabled", "disabled", "stale"), field("state")), *_unless_null(c.at(x, "bbox"), _box(c.at(x, "bbox"), field("bbox")))]
    region = lambda x, field: [*_text(c.at(x, "label"), field("label")), *_box(c.at(x, "bbox"), field("bbox")), ("EXPECTED_BOOLEAN", field("occluded"), ~c.is_flag(c.at(x, "occluded")))]
    return [
        *_object(given, ("instruction", "available_tools", "observation"), at), *_text(c.at(given, "instruction"), f"{at}.instruction"), ("EXPECTED_ARRAY", f"{at}.available_tools", tools.isNull()),
        ("INVALID_TOOL_COUNT", f"{at}.available_tools", ~F.size(tools).between(1, MOST_TOOLS)), *c.nested(c.first_of_items(c.items_at(given, "available_tools"), tool)), ("DUPLICATE_TOOL", f"{at}.available_tools", c.repeats(tools)),
        *_object(seen, ("uia_controls", "screenshot_regions", "ocr_text", "grounding_cue"), view),
        *_items(seen, scope, "uia_controls", view, ("ref", "role", "name", "state", "bbox"), control, "ref", "TOO_MANY_CONTROLS", "DUPLICATE_REF"),
        *_items(seen, scope, "screenshot_regions", view, ("region_id", "label", "bbox", "occluded"), region, "region_id", "TOO_MANY_REGIONS", "DUPLICATE_REGION"),
        ("OBSERVATION_MODE_MISMATCH", view, ~fits), ("INVALID_STRING", f"{view}.ocr_text", (~c.is_string(ocr)) | (F.length(c.text_at(seen, "ocr_text")) > MOST_TEXT)),
        ("OCR_CONDITION_MISMATCH", f"{view}.ocr_text", (c.text_at(case, "ocr_condition") == "missing") != (c.text_at(seen, "ocr_text") == "")),
        *_object(cue, ("ref", "bbox"), f"{view}.grounding_cue"), *_unless_null(c.at(cue, "ref"), _identifier(c.at(cue, "ref"), f"{view}.grounding_cue.ref")), *_unless_null(c.at(cue, "bbox"), _box(c.at(cue, "bbox"), f"{view}.grounding_cue.bbox")),
        ("CAPABILITY_CUE_MISMATCH", f"{view}.grounding_cue", ~_shape(capability, ~c.is_null(c.at(cue, "ref")), ~c.is_null(c.at(cue, "bbox")))),
    ]


def gold_rules(case: Column, tools: Column, scope: c.Scope, place: str) -> list[Rule]:
    gold, at = scope.open(c.at(case, "gold"), GOLD_FIELDS), f"{place}.gold"
    get = lambda f: c.at(gold, f)
    act = c.text_at(gold, "disposition") == "act"
    catalog = scope.open_items(c.at(gold, "target_catalog"), ("target_id", "ref", "bbox"))
    written = lambda f: F.transform(catalog, lambda x: c.json_of(c.at(x, f)))
    columns = [scope.keep(written(f)) for f in ("target_id", "ref", "bbox")]
    target = scope.keep(F.get(F.filter(catalog, lambda x: c.text_at(x, "target_id") == c.text_at(gold, "target_id")), F.lit(0)))

    def entry(x: Column, i: Column) -> list[Rule]:
        where = F.concat(F.lit(f"{at}.target_catalog["), i.cast("string"), F.lit("]"))
        field = lambda f: F.concat(where, F.lit(f".{f}"))
        again = F.lit(False)
        for known in columns:
            again |= F.array_contains(F.slice(known, F.lit(1), i), F.get(known, i))
        return [*_object(x, ("target_id", "ref", "bbox"), where), *_identifier(c.at(x, "target_id"), field("target_id")), *_identifier(c.at(x, "ref"), field("ref")), *_box(c.at(x, "bbox"), field("bbox")), ("DUPLICATE_CATALOG_TARGET", where, again)]

    perturbation = c.text_at(case, "perturbation")
    ends_well = F.lit(False)
    for name, (disposition, reason) in TERMINAL.items():
        ends_well |= (perturbation == name) & (c.text_at(gold, "disposition") == disposition) & (c.text_at(gold, "reason") == reason)
    return [
        *_object(gold, GOLD_FIELDS, at), *_enum(get("disposition"), DISPOSITIONS, f"{at}.disposition"), ("EXPECTED_ARRAY", f"{at}.target_catalog", catalog.isNull()), ("INVALID_CATALOG_COUNT", f"{at}.target_catalog", ~F.size(catalog).between(1, MOST_ITEMS)),
        *c.nested(c.first_of_items(catalog, entry)),
        *_where(act, [
            *_identifier(get("tool"), f"{at}.tool"), ("GOLD_TOOL_UNAVAILABLE", f"{at}.tool", ~F.array_contains(tools, c.text_at(gold, "tool"))), *_arguments(get("arguments"), f"{at}.arguments"),
            *_unless_null(get("ref"), _identifier(get("ref"), f"{at}.ref")), *_unless_null(get("bbox"), _box(get("bbox"), f"{at}.bbox")), *_identifier(get("target_id"), f"{at}.target_id"), *_null(gold, ("reason",), at),
            ("UNKNOWN_TARGET", f"{at}.target_id", target.isNull()), ("GOLD_CAPABILITY_MISMATCH", at, ~_shape(c.text_at(case, "capability"), ~c.is_null(get("ref")), ~c.is_null(get("bbox")))),
            ("GOLD_REF_MISMATCH", f"{at}.ref", ~c.is_null(get("ref")) & (c.json_of(get("ref")) != c.json_of(c.at(target, "ref")))), ("GOLD_BBOX_MISMATCH", f"{at}.bbox", ~c.is_null(get("bbox")) & (c.json_of(get("bbox")) != c.json_of(c.at(target, "bbox")))),
            ("PERTURBATION_OUTCOME_MISMATCH", at, perturbation.isin(*TERMINAL)),
        ]),
        *_where(~act, [*_null(gold, ("tool", "arguments", "ref", "bbox", "target_id"), at), *_identifier(get("reason"), f"{at}.reason"), ("PERTURBATION_OUTCOME_MISMATCH", at, ~ends_well)]),
    ]


def case_rules(case: Column, scope: c.Scope, place: str = "$") -> list[Rule]:
    """C16 for one case."""
    case = scope.open(case, CASE_FIELDS)
    get = lambda f: c.at(case, f)
    given = scope.open(get("model_input"), ("instruction", "available_tools", "observation"))
    tools = scope.keep(c.strings(c.at(given, "available_tools")))
    return [
        *_object(case, CASE_FIELDS, place), *_identifier(get("case_id"), f"{place}.case_id"), *_identifier(get("family_id"), f"{place}.family_id"),
        *(rule for f, allowed in (("capability", CAPABILITIES), ("observation_mode", MODES), ("ocr_condition", OCR), ("perturbation", PERTURBATIONS)) for rule in _enum(get(f), allowed, f"{place}.{f}")),
        *input_rules(case, given, tools, scope, place), *gold_rules(case, tools, scope, place),
    ]


def prediction_rules(record: Column, scope: c.Scope, place: str = "$", expected: Column | None = None) -> list[Rule]:
    """C17: an action has grounding and no reason, an end has a reason and nothing else.

    ``expected``: the id of the case that the record's place in its file belongs to; without it, any will do.
    """
    record = scope.open(record, PREDICTION_FIELDS)
    get = lambda f: c.at(record, f)
    act = c.text_at(record, "disposition") == "act"
    return [
        *_object(record, PREDICTION_FIELDS, place), *_identifier(get("case_id"), f"{place}.case_id"), *([] if expected is None else [("PREDICTION_ORDER_MISMATCH", f"{place}.case_id", c.text_at(record, "case_id") != expected)]), *_enum(get("disposition"), DISPOSITIONS, f"{place}.disposition"),
        *_where(act, [
            *_identifier(get("tool"), f"{place}.tool"), *_arguments(get("arguments"), f"{place}.arguments"), *_unless_null(get("ref"), _identifier(get("ref"), f"{place}.ref")), *_unless_null(get("bbox"), _box(get("bbox"), f"{place}.bbox")),
            ("MISSING_GROUNDING", place, c.is_null(get("ref")) & c.is_null(get("bbox"))), *_null(record, ("reason",), place),
        ]),
        *_where(~act, [*_null(record, ("tool", "arguments", "ref", "bbox"), place), *_identifier(get("reason"), f"{place}.reason")]),
    ]


def compiled_predictions(outputs: DataFrame, case_id: str, raw: str, tool: str = "click", arguments: str = '{"button":"left"}', reason: str = "model_output_invalid") -> DataFrame:
    """Each raw output of a model as a prediction: its first JSON object, whatever stands around it, if that is a sound record of its case.

    Else, and for a null output, the fixed fallback record, so every case has one row: case_id, disposition, tool, arguments (JSON), ref, bbox,
    reason, and compiled (false for a fallback).  An action has the given tool and arguments, and a reference or a box.
    """
    read = c.with_document(outputs.select(F.col(case_id).alias("__case"), lexical.first_object(F.col(raw)).alias("__object")), "__object", "__doc")
    parts = read.select("__case", c.opened(F.col("__doc"), PREDICTION_FIELDS).alias("__r"))
    record = F.col("__r")
    get = lambda f: c.at(record, f)
    shape = F.coalesce(record["keys"] == c.literal(PREDICTION_FIELDS), F.lit(False)) & c.text_at(record, "case_id").eqNullSafe(F.col("__case"))
    box = F.coalesce((F.size(c.items_at(record, "bbox")) == 4) & F.forall(c.items_at(record, "bbox"), lambda x: c.is_integer(x, 0, MOST_PLACE)), F.lit(False))
    grounded = (c.is_null(get("ref")) | c.matches(get("ref"), IDENTIFIER)) & (c.is_null(get("bbox")) | box) & ~(c.is_null(get("ref")) & c.is_null(get("bbox")))
    acts = c.is_exactly(get("tool"), tool) & F.coalesce(c.json_of(get("arguments")) == arguments, F.lit(False)) & c.is_null(get("reason")) & grounded
    ends = c.is_null(get("tool")) & c.is_null(get("arguments")) & c.is_null(get("ref")) & c.is_null(get("bbox")) & c.matches(get("reason"), IDENTIFIER)
    sound = F.coalesce(shape & F.when(c.is_exactly(get("disposition"), "act"), acts).when(c.is_member(get("disposition"), DISPOSITIONS), ends), F.lit(False))
    said = lambda f: F.when(F.col("__sound"), c.text_at(record, f))
    given = c.json_of(c.at(record, "arguments"))
    return parts.withColumn("__sound", sound).select(
        F.col("__case").alias(case_id), F.coalesce(said("disposition"), F.lit("fallback")).alias("disposition"), said("tool").alias("tool"), F.when(F.col("__sound") & (given != "null"), given).alias("arguments"), said("ref").alias("ref"),
        F.when(F.col("__sound"), F.transform(c.items_at(record, "bbox"), lambda x: x["said"].cast("int"))).alias("bbox"), F.when(F.col("__sound"), c.text_at(record, "reason")).otherwise(reason).alias("reason"), F.col("__sound").alias("compiled"),
    )


#: Fixed values of the contract: the fields of a file of predictions and of its producer.
PREDICTION_FILE_FIELDS, PRODUCER_FIELDS, PRODUCERS = ("suite_id", "producer", "records"), ("kind", "model_id", "model_revision"), ("synthetic_probe", "model")
MOST_PREDICTION_BYTES = 1 << 20


def producer_rules(producer: Column, place: str) -> list[Rule]:
    """C17: a probe names no model, a model its id and revision."""
    probe = c.text_at(producer, "kind") == "synthetic_probe"
    named = lambda f: ("INVALID_STRING", f"{place}.{f}", ~c.is_text(c.at(producer, f)) | (F.length(c.text_at(producer, f)) > MOST_TEXT))
    return [
        *_object(producer, PRODUCER_FIELDS, place), *_enum(c.at(producer, "kind"), PRODUCERS, f"{place}.kind"),
        *_where(probe, _null(producer, ("model_id", "model_revision"), place)), *_where(~probe, [named("model_id"), named("model_revision")]),
    ]


def prediction_file_violations(predictions: DataFrame, key: str, raw: str, suite_id: str, case_ids: str, version_field: str, version: int = 1) -> DataFrame:
    """Code and location of the first rule that each file of predictions breaks; null where it is sound.

    ``suite_id`` and ``case_ids`` (in order) are the columns of the suite that the file is held against.  A file is at most
    ``MOST_PREDICTION_BYTES`` long; its records are judged as rows of their own, and the first of them by place counts.
    """
    root = "$predictions"

    def head(doc: Column, scope: c.Scope) -> list[Rule]:
        doc = scope.open(doc, (version_field, *PREDICTION_FILE_FIELDS))
        producer = scope.open(c.at(doc, "producer"), PRODUCER_FIELDS)
        records = scope.keep(c.items_at(doc, "records"))
        return [
            *_object(doc, (version_field, *PREDICTION_FILE_FIELDS), root), ("UNSUPPORTED_VERSION", f"{root}.{version_field}", ~c.is_exactly(c.at(doc, version_field), version)),
            *_identifier(c.at(doc, "suite_id"), f"{root}.suite_id"), ("SUITE_BINDING_MISMATCH", f"{root}.suite_id", ~c.text_at(doc, "suite_id").eqNullSafe(F.col(suite_id))),
            *producer_rules(producer, f"{root}.producer"), ("EXPECTED_ARRAY", f"{root}.records", ~c.is_list(c.at(doc, "records"))), ("PREDICTION_COUNT_MISMATCH", f"{root}.records", F.size(records) != F.size(case_ids)),
        ]

    heads = c.judged(predictions, [key], raw, root, head, (suite_id, case_ids), MOST_PREDICTION_BYTES)
    cut = predictions.where(F.octet_length(raw) <= MOST_PREDICTION_BYTES).select(F.col(key).alias("__file"), F.col(case_ids).alias("__ids"), F.posexplode(c.items_at(c.opened(c.document(raw)), "records")).alias("__place", "__item"))
    rows = cut.select("__file", "__place", c.json_of(F.col("__item")).alias("__record"), F.get("__ids", F.col("__place")).alias("__expected"))
    judged = c.judged(rows, ["__file", "__place"], "__record", "$", lambda doc, scope: prediction_rules(doc, scope, "$", F.col("__expected")), ("__expected",))
    first = judged.where("code is not null").groupBy("__file").agg(F.min(F.struct("__place", "code", "location")).alias("__first"))
    location = F.concat(F.lit(f"{root}.records["), F.col("__first.__place").cast("string"), F.lit("]"), F.substr("__first.location", F.lit(2)))
    both = heads.join(first, heads[key] == first["__file"], "left")
    return both.select(key, F.coalesce("code", "__first.code").alias("code"), F.when(F.col("code").isNotNull(), F.col("location")).otherwise(location).alias("location"))


def document_violations(df: DataFrame, key: list[str], raw: str, rules, most_bytes: int = 2 << 20) -> DataFrame:
    """Code and location of the first rule that each document breaks: its size and text first."""
    return c.judged(df, key, raw, "$", rules, most_bytes=most_bytes)


def suite_violations(cases: DataFrame, suite: str, ordinal: str, case: str) -> DataFrame:
    """F2, E20, H-1: per suite, ids out of order, names that occur twice, and values that no case covers: suite, code, n.

    ``case``: variant.  Ids are ``ground-001`` and so on by the order column.
    """
    text = lambda f: c.text_at(F.col("__case"), f)
    parts = cases.select(suite, ordinal, c.opened(F.col(case)).alias("__case")).withColumn("__input", c.opened(c.at(F.col("__case"), "model_input")["v"]))
    rows = parts.select(suite, (text("case_id") != F.format_string("ground-%03d", F.col(ordinal))).alias("wrong"), *(text(f).alias(f) for f in ("family_id", "observation_mode", "capability", "ocr_condition", "perturbation")), c.text_at(F.col("__input"), "instruction").alias("instruction"))
    lacks = lambda f, all_of: F.size(F.array_except(c.literal(all_of), F.collect_set(f))).cast("long")
    again = lambda f: F.count(f) - F.count_distinct(f)
    found = rows.groupBy(suite).agg(
        F.count_if("wrong").alias("CASE_ORDER_MISMATCH"), again("family_id").alias("FAMILY_LEAKAGE"), again("instruction").alias("INSTRUCTION_LEAKAGE"), lacks("observation_mode", MODES).alias("INCOMPLETE_OBSERVATION_COVERAGE"),
        lacks("capability", CAPABILITIES).alias("INCOMPLETE_CAPABILITY_COVERAGE"), lacks("ocr_condition", OCR).alias("INCOMPLETE_OCR_COVERAGE"), lacks("perturbation", PERTURBATIONS).alias("INCOMPLETE_PERTURBATION_COVERAGE"),
    )
    codes = [x for x in found.columns if x != suite]
    return found.select(suite, F.inline(F.array(*(F.struct(F.lit(x).alias("code"), F.col(x).alias("n")) for x in codes)))).where("n > 0")


def _sides(box: Column) -> Column:
    return F.struct(*(F.get(box, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


def resolved_ref(ref: Column, catalog: Column) -> Column:
    """The target of the first catalog entry with the reference."""
    return F.get(F.filter(catalog, lambda t: t["ref"] == ref), F.lit(0))["target_id"]


def resolved_box(box: Column, catalog: Column, least: tuple[int, int]) -> Column:
    """The target with the greatest overlap, if it reaches ``least`` and no other has as much; overlaps are compared as fractions."""
    return _best_target(_sides(box), catalog, least)


def _best_target(sides: Column, catalog: Column, least: tuple[int, int]) -> Column:
    """:func:`resolved_box` of the sides.  Every entry evaluates them, so they are better columns than expressions.

    Only overlaps that reach ``least`` are compared with each other; of an invalid box all are 0.
    """
    over = F.transform(catalog, lambda t: F.struct(t["target_id"].alias("target_id"), iou(sides, _sides(t["bbox"])).alias("f")))
    enough = F.filter(over, lambda a: a["f"]["shared"] * least[1] >= a["f"]["union"] * least[0])
    none = F.struct(F.lit(None).cast("string").alias("target_id"), F.lit(-1).cast("long").alias("shared"), F.lit(1).cast("long").alias("union"), F.lit(0).alias("ties"))

    def better(top: Column, x: Column) -> Column:
        shared, union = x["f"]["shared"], x["f"]["union"]
        ours, best = shared * top["union"], top["shared"] * union
        return F.when(ours > best, F.struct(x["target_id"].alias("target_id"), shared.alias("shared"), union.alias("union"), F.lit(1).alias("ties"))).when(ours == best, F.struct(top["target_id"].alias("target_id"), top["shared"].alias("shared"), top["union"].alias("union"), (top["ties"] + 1).alias("ties"))).otherwise(top)

    return F.when(valid_box(sides) | F.lit(least[0] <= 0), F.aggregate(enough, none, better, lambda top: F.when(top["ties"] == 1, top["target_id"])))


@F.pandas_udf(StructType([StructField("numerator", StringType()), StructField("denominator", StringType())]))
def exact_mean(parts: pd.Series) -> pd.DataFrame:
    """E15 in one row: the mean of a short list of fractions (n, d) as a reduced fraction; null for none.  :func:`exact_means` takes groups of any size."""
    out = []
    for fractions in parts:
        total = sum((Fraction(int(f["n"]), int(f["d"])) for f in fractions), Fraction(0)) / len(fractions) if len(fractions) else None
        out.append((None, None) if total is None else (str(total.numerator), str(total.denominator)))
    return pd.DataFrame(out, columns=["numerator", "denominator"])


#: Fractions that meet in one row while they are added; bits that the 64-bit sums of :func:`_added` may take.
FAN_IN, SAFE_BITS = 64, 62
#: A fraction of longs n and d, or of two's-complement bytes, as integers may have any length.
FRACTION = StructType([StructField("n", LongType()), StructField("d", LongType()), StructField("numerator", BinaryType()), StructField("denominator", BinaryType())])


def _octets(x: int) -> bytes:
    return x.to_bytes(x.bit_length() // 8 + 1, "big", signed=True)


def _whole(f: dict) -> Fraction:
    """A fraction as Python's: of longs, of digits over a long, or of bytes."""
    if f["d"] is not None:
        return Fraction(int(f["digits"]) if f["n"] is None else f["n"], f["d"])
    return Fraction(*(int.from_bytes(f[x], "big", signed=True) for x in ("numerator", "denominator")))


def _longs(fractions: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n and d of each (0 and 1 where they aren't longs), and where they are."""
    n, d = fractions.field("n"), fractions.field("d")
    short = pc.and_(pc.and_(n.is_valid(), d.is_valid()), fractions.is_valid()).to_numpy(zero_copy_only=False)
    return np.where(short, n.fill_null(0).to_numpy(), 0), np.where(short, d.fill_null(1).to_numpy(), 1), short


@F.arrow_udf(FRACTION)
def _added(parts: pa.Array) -> pa.Array:
    """The sums of short lists of fractions, reduced; null for an empty list.  Lists whose common denominator is surely short are added together as arrays."""
    counts, items = parts.value_lengths().fill_null(0).to_numpy(), parts.flatten()
    rows, at = np.flatnonzero(counts), np.concatenate([[0], np.cumsum(counts)])[:-1]
    sums, bottoms, fits = np.zeros(len(parts), np.int64), np.ones(len(parts), np.int64), np.zeros(len(parts), bool)
    if len(rows):
        n, d, short = _longs(items)
        first = at[rows]
        with np.errstate(over="ignore"):
            bits = np.add.reduceat(np.log2(d), first) + np.log2(1 + np.add.reduceat(np.abs(n.astype(float)), first))
        fits[rows] = np.logical_and.reduceat(short, first) & (bits < SAFE_BITS)
        n, d = (np.where(np.repeat(fits, counts), x, y) for x, y in ((n, 0), (d, 1)))
        bottom = np.lcm.reduceat(d, first)
        top = np.add.reduceat(n * (np.repeat(bottom, counts[rows]) // d), first)
        common = np.gcd(top, bottom)
        sums[rows], bottoms[rows] = top // common, bottom // common
    numerators, denominators = [None] * len(parts), [None] * len(parts)
    for k in rows[~fits[rows]]:
        total = sum(map(_whole, items.slice(at[k], counts[k]).to_pylist()), Fraction(0))
        numerators[k], denominators[k] = _octets(total.numerator), _octets(total.denominator)
    columns = [pa.array(sums, pa.int64(), mask=~fits), pa.array(bottoms, pa.int64(), mask=~fits), pa.array(numerators, pa.binary()), pa.array(denominators, pa.binary())]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type) for f, c in zip(FRACTION, columns, strict=True)], mask=pa.array(counts == 0))


MEAN = StructType([StructField("numerator", StringType()), StructField("denominator", StringType()), StructField("value", DoubleType())])


@F.arrow_udf(MEAN)
def _mean(sums: pa.Array, counts: pa.Array) -> pa.Array:
    """Each sum over its count, reduced, and the nearest double; arrays where both parts are exact as doubles."""
    digits = lambda x: str(x) if x.bit_length() < 10_000 else f"0x{x:x}"
    n, d, short = _longs(sums)
    of = counts.fill_null(0).to_numpy()
    fits = short & (np.abs(n.astype(float)) < 2.0**53) & (d.astype(float) * of < 2.0**53) & (of > 0)
    n, d = np.where(fits, n, 0), np.where(fits, d * np.where(fits, of, 1), 1)
    common = np.gcd(n, d)
    n, d = n // common, d // common
    numerators, denominators, values = pa.array(n).cast(pa.string()), pa.array(d).cast(pa.string()), n / d
    long = np.flatnonzero(~fits & (of > 0) & sums.is_valid().to_numpy(zero_copy_only=False))
    if len(long):
        numerators, denominators = numerators.to_pylist(), denominators.to_pylist()
        for k in long:
            mean = _whole(sums[k].as_py()) / int(of[k])
            numerators[k], denominators[k], values[k] = digits(mean.numerator), digits(mean.denominator), mean.numerator / mean.denominator
    columns = [pa.array(numerators, pa.string()), pa.array(denominators, pa.string()), pa.array(values, pa.float64())]
    return pa.StructArray.from_arrays(columns, names=MEAN.names, mask=pc.invert(pc.and_(sums.is_valid(), pa.array(of > 0))))


def exact_means(rows: DataFrame, group: str, part: str, counts: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """Per group the number of fractions and their mean as a reduced fraction and as the nearest double.

    ``part`` is a struct of longs n and d (d over 0) or null, which isn't counted.  Numerators of one denominator
    are summed as decimals first, with partial sums, so a group of any number of rows leaves a row for each
    denominator; these are added about ``FAN_IN`` at a time in a tree, so no row or task holds a group's list.
    ``most``: the most denominators that a group can have, if that is known; else they are counted first, which
    takes the rows twice.  It only sets the depth of the tree.  ``counts``: conditions by name, counted in the same
    pass; with them a group of nulls alone has a row too (n is 0, no mean).
    A numerator or denominator of over 3,000 digits is written in hexadecimal (0x...).
    """
    counts = counts or {}
    kept = rows if counts else rows.where(F.col(part).isNotNull())
    sums = kept.groupBy(F.col(group).alias("__group"), F.col(f"{part}.d").alias("__d")).agg(F.sum(F.col(f"{part}.n").cast("decimal(38,0)")).alias("__n"), F.count(part).alias("__count"), *(F.count_if(x).alias(name) for name, x in counts.items()))
    if most is None:
        most = sums.where("__d is not null").groupBy("__group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    levels = 1
    while FAN_IN**levels < (most or 1):
        levels += 1
    n, short = F.col("__n"), F.col("__n").between(-(1 << SAFE_BITS), 1 << SAFE_BITS)
    fraction = F.struct(F.when(short, n.cast("long")).alias("n"), F.col("__d").alias("d"), F.when(~short, n.cast("string")).alias("digits"))
    found = sums.select("__group", F.pmod(F.xxhash64("__d"), F.lit(FAN_IN ** (levels - 1))).alias("__place"), "__count", *counts, F.when(F.col("__d").isNotNull(), fraction).alias("__sum"))
    for level in range(levels, 0, -1):
        found = found.groupBy("__group", *(["__place"] if level > 1 else [])).agg(F.collect_list("__sum").alias("__parts"), *(F.sum(x).alias(x) for x in ("__count", *counts)))
        found = found.select("__group", *([F.floor(F.col("__place") / FAN_IN).alias("__place")] if level > 1 else []), "__count", *counts, _added("__parts").alias("__sum"))
    return found.select(F.col("__group").alias(group), F.col("__count").alias("n"), *counts, _mean("__sum", "__count").alias("__m")).select(group, "n", *counts, "__m.numerator", "__m.denominator", "__m.value")


METRICS = ("grounding_accuracy", "action_accuracy", "tool_accuracy", "argument_exact_match", "stale_ref_rejection", "coordinate_ref_disagreement_rejection", "prediction_coordinate_ref_disagreement_rate")


def scored_cases(cases: DataFrame, predictions: DataFrame, suite: str, case_id: str, least: tuple[int, int] = (1, 2)) -> DataFrame:
    """Every case with its prediction, judged: one flag and one denominator for each metric, and the overlap as a fraction.

    ``cases``: suite, case_id, capability, perturbation, gold (:data:`GOLD`); ``predictions``: suite, case_id, prediction.
    A case without a prediction misses everything; a prediction without a case is left out.
    """
    return scored_pairs(cases.join(predictions, [suite, case_id], "left"), suite, case_id, least)


def scored_pairs(pairs: DataFrame, suite: str, case_id: str, least: tuple[int, int] = (1, 2)) -> DataFrame:
    """D5 for rows that hold a case (as in :func:`scored_cases`) and its ``prediction``, null if it has none.

    What is used more than once is a column of its own: a lambda evaluates what it refers to for each entry, and
    repeated expressions make generated methods too long to be compiled.
    """
    gold, given = F.col("gold"), F.col("prediction")
    names = ("x1", "y1", "x2", "y2")
    flat = lambda box, of: [F.get(box, F.lit(k)).cast("long").alias(f"__{of}_{x}") for k, x in enumerate(names)]
    sides = lambda of: F.struct(*(F.col(f"__{of}_{x}").alias(x) for x in names))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    entries = lambda m: F.sort_array(F.map_entries(m))
    fields = pairs.select(
        suite, case_id, "capability", "perturbation", (gold["disposition"] == "act").alias("__act"), gold["bbox"].isNotNull().alias("__boxed"), gold["target_id"].alias("__wanted"), gold["target_catalog"].alias("__catalog"), gold["reason"].alias("__end"),
        given["disposition"].alias("__said"), F.coalesce(given["reason"], F.lit("")).alias("__reason"), given["ref"].alias("__given"), (given["ref"].isNotNull() & given["bbox"].isNotNull()).alias("__both"),
        same(given["disposition"], gold["disposition"]).alias("__same_end"), same(given["tool"], gold["tool"]).alias("__same_tool"), same(entries(given["arguments"]), entries(gold["arguments"])).alias("__same_arguments"), *flat(given["bbox"], "given"), *flat(gold["bbox"], "gold"),
    )
    overlap = iou(sides("given"), sides("gold"))
    found = fields.withColumns({"__ref": resolved_ref(F.col("__given"), F.col("__catalog")), "__target": _best_target(sides("given"), F.col("__catalog"), least), "__shared": overlap["shared"], "__union": overlap["union"]})
    act, ref, box, reason = F.col("__act"), F.col("__ref"), F.col("__target"), F.col("__reason")
    said = lambda x: same(F.col("__said"), F.lit(x))
    hits = found.withColumns({"__ref_hit": same(ref, F.col("__wanted")), "__box_hit": same(box, F.col("__wanted"))})
    by_ref, by_box = F.col("__ref_hit"), F.col("__box_hit")
    grounded = act & F.when(F.col("capability") == "ref_grounding", by_ref).when(F.col("capability") == "bbox_grounding", by_box).otherwise(by_ref & by_box)
    split = F.coalesce(ref != box, F.lit(True))
    stale, disagree = F.col("perturbation") == "stale_ref", F.col("perturbation") == "coordinate_ref_disagreement"
    part = F.when(act & F.col("__boxed"), F.struct(F.coalesce("__shared", F.lit(0)).cast("long").alias("n"), F.coalesce(F.when(F.col("__union") > 0, F.col("__union")), F.lit(1)).cast("long").alias("d")))
    flags = {
        "grounding_accuracy": (grounded, act), "action_accuracy": (F.when(act, said("act") & grounded).otherwise(F.col("__same_end") & (reason == F.col("__end"))), F.lit(True)),
        "tool_accuracy": (said("act") & F.col("__same_tool"), act), "argument_exact_match": (said("act") & F.col("__same_arguments"), act),
        "stale_ref_rejection": (said("reject") & (reason == "stale_ref"), stale), "coordinate_ref_disagreement_rejection": (said("reject") & (reason == "coordinate_ref_disagreement"), disagree),
        "prediction_coordinate_ref_disagreement_rate": (split, F.coalesce("__both", F.lit(False))),
    }
    return hits.select(suite, case_id, *(F.struct((hit & of).alias("hit"), of.alias("of")).alias(name) for name, (hit, of) in flags.items()), part.alias("overlap"), ref.alias("ref_target"), box.alias("box_target"))


def grounding_report(scored: DataFrame, suite: str, most_cases: int | None = None) -> DataFrame:
    """Per suite and metric correct, total, value (null where total is 0: not applicable), and mean_iou as an exact fraction.

    ``most_cases``: the most cases of a suite, if that is known (see ``most`` of :func:`exact_means`).
    """
    cells = {f"{name}_{x}": F.col(f"{name}.{x}") for name in METRICS for x in ("hit", "of")}
    sums = exact_means(scored, suite, "overlap", cells, most_cases)
    rows = [F.struct(F.lit(name).alias("metric"), F.col(f"{name}_hit").alias("correct"), F.col(f"{name}_of").alias("total"), F.lit(None).cast("string").alias("numerator"), F.lit(None).cast("string").alias("denominator"), ratio(F.col(f"{name}_hit"), F.col(f"{name}_of"), None).alias("value")) for name in METRICS]
    mean = F.struct(F.lit("mean_iou").alias("metric"), F.lit(None).cast("long").alias("correct"), F.col("n").alias("total"), "numerator", "denominator", "value")
    return sums.select(suite, F.inline(F.array(*rows, mean)))
