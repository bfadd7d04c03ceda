"""JSON as it is written: tokens, exact numbers, located keys, and nested differences against plain recursion."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lexical
from ledgerloom.operators import contracts, documents, exports, walk
from ledgerloom.plans.contracts import DIGEST, RUN

SCALARS = [0, 1, -1, 1.0, 2.5, True, False, None, "", "a", "x,]}", 'q"\\', "é😀", 10**45, -(10**50), 2**53, 1e300, "true", "1"]


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(["a", "b", "c d", "ü", 'k"', "Secret"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.6:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice(SCALARS)


def changed(a, b, path="$"):
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted(set(a) | set(b)) for p in ([f"{path}.{k}"] if k not in a or k not in b else changed(a[k], b[k], f"{path}.{k}"))]
    if isinstance(a, list) and isinstance(b, list):
        return [path] if len(a) != len(b) else [p for k, (x, y) in enumerate(zip(a, b, strict=True)) for p in changed(x, y, f"{path}[{k}]")]
    return [] if a == b else [path]


def mutated(rng, v):
    if rng.random() < 0.15:
        return value(rng, 2)
    if isinstance(v, dict):
        out = {k: mutated(rng, x) for k, x in v.items() if rng.random() > 0.1}
        return dict(sorted(out.items(), key=lambda _: rng.random()))
    if isinstance(v, list):
        return [mutated(rng, x) for x in v if rng.random() > 0.05]
    return float(v) if isinstance(v, int) and abs(v) < 2**50 and rng.random() < 0.5 else v


def paths_of(v, path="$"):
    """Leaves in document order, keys first."""
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from paths_of(x, f"{path}.{k}")
    elif isinstance(v, list) and v:
        for k, x in enumerate(v):
            yield from paths_of(x, f"{path}[{k}]")
    else:
        yield path, v




@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    firsts = [value(rng, 4) for _ in range(150)]
    return [(k, a, mutated(rng, a)) for k, a in enumerate(firsts)]


def test_leaves_equal_recursion(spark, pairs):
    df = spark.createDataFrame([(k, json.dumps(a, ensure_ascii=k % 2 == 0, indent=k % 3 or None)) for k, a, _ in pairs], "k long, j string")
    found = {(r.k, r.path): r.value for r in walk.leaves(df, "k", "j").collect()}
    expected = {(k, p): v for k, a, _ in pairs for p, v in paths_of(a)}
    assert found.keys() == expected.keys()
    for at, v in expected.items():
        if isinstance(v, int) and not isinstance(v, bool):
            assert found[at] == str(v)  # integers of any length as they are
        else:
            assert json.loads(found[at]) == v and type(json.loads(found[at])) is type(v)


def test_changed_paths_equal_recursion(spark, pairs):
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b, indent=1)) for k, a, b in pairs] + [(900, "{", "{"), (901, "{", "{}"), (902, None, "1"), (903, None, None)], "k long, l string, r string")
    found = {}
    for r in walk.changed_paths(df, "k", "l", "r").collect():
        found.setdefault(r.k, []).append(r.path)
    expected = {k: sorted(changed(a, b)) for k, a, b in pairs if changed(a, b)} | {901: ["$"], 902: ["$"]}
    assert {k: sorted(p) for k, p in found.items()} == expected
    assert len(expected) > 60


def test_hits_are_in_document_order(spark, pairs):
    def secrets(v, path=""):
        if isinstance(v, dict):
            for k, x in v.items():
                if k.lower() == "secret":
                    yield f"{path}.{k}"
                yield from secrets(x, f"{path}.{k}")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from secrets(x, f"{path}[{k}]")

    df = spark.createDataFrame([(k, json.dumps(a)) for k, a, _ in pairs], "k long, j string")
    hits = lexical.hits(F.col("j"), lambda t: lexical.is_key(t) & (F.lower(lexical.string_value(t)) == "secret"))
    found = {r.k: [h.path for h in r.h] for r in df.select("k", hits.alias("h"), lexical.depth(F.col("j")).alias("d")).collect()}
    assert found == {k: list(secrets(a)) for k, a, _ in pairs}
    keys = {r.k: r.keys for r in df.select("k", documents.all_keys(F.col("j")).alias("keys")).collect()}
    names = lambda v: set(v) | {n for x in v.values() for n in names(x)} if isinstance(v, dict) else {n for x in v for n in names(x)} if isinstance(v, list) else set()
    assert keys == {k: sorted(names(a)) for k, a, _ in pairs}


def test_numbers_keep_their_order(spark):
    ints = [0, 5, 10**37, 10**37 + 1, 10**38, 10**38 - 1, 10**45, 10**45 + 1, -(10**45), -5, -(10**60)]
    raw = json.dumps({"n": ints, "s": "9" * 50, "f": 1.5})[:-1] + ', "inf": [1e999, -1E+400, 1e5], "bad": "1e999"}'
    df = spark.createDataFrame([(raw,), ("[" + "9" * 40 + " 1]",), ("[01e999]",)], "j string")
    rows = df.select(F.to_json(contracts.document("j")).alias("j"), lexical.hits(F.col("j"), lexical.is_nonfinite).alias("h")).collect()
    read = json.loads(rows[0].j)
    assert [sorted(ints).index(x) for x in ints] == [sorted(read["n"]).index(x) for x in read["n"]] and all(isinstance(x, int) for x in read["n"])
    assert read["n"][:3] == [0, 5, read["n"][2]] and read["s"] == "9" * 50 and read["bad"] == "1e999" and all(math.isfinite(x) for x in read["inf"])
    assert [h.path for h in rows[0].h] == [".inf[0]", ".inf[1]"]
    assert rows[1].j is None and rows[2].j is None


def test_run_exports_are_located_and_exact(spark):
    changes = {
        ("2.5", "1e999"): ("NONFINITE_NUMBER", "run_export.events[4].arguments.where.x[1]"), ('"retry_count": 1', '"retry_count": ' + "7" * 46): (None, None),
        ('"where"', '"wh\\u0065re": {"Raw_Task": []}, "more"'): ("FORBIDDEN_RICH_FIELD", "run_export.events[4].arguments.where.Raw_Task"),
        ('"max_model_turns": 5, "model_turns_used": 1', f'"max_model_turns": 1{"0" * 50}, "model_turns_used": 1{"0" * 48}1'): (None, None),
        ('"max_model_turns": 5, "model_turns_used": 1', f'"max_model_turns": 1{"0" * 50}, "model_turns_used": 1{"0" * 50}1'): ("INVALID_VALUE", "run_export.checkpoint.budgets.model_turns_used"),
        ('"phase"', '"Memory": 1, "phase"'): ("UNKNOWN_FIELD", "run_export.checkpoint"),
    }
    sound = RUN.replace("@id", "1")
    assert all(a in sound for a, _ in changes)
    df = spark.createDataFrame([(k, sound.replace(a, b)) for k, (a, b) in enumerate(changes)], "k long, j string")
    found = [(r.code, r.location) for r in exports.run_violations(df, "k", "j", F.lit(DIGEST)).orderBy("k").collect()]
    assert found == list(changes.values())


def test_first_objects_and_fallbacks(spark):
    from ledgerloom.operators import grounding

    sound = '{"case_id": "c1", "disposition": "act", "tool": "click", "arguments": {"button": "left"}, "ref": "r", "bbox": null, "reason": null}'
    ended = '{"case_id": "c1", "disposition": "reject", "tool": null, "arguments": null, "ref": null, "bbox": null, "reason": "gone"}'
    texts = {
        sound: True, f"Sure }} [ \" {sound} and }} {{": True, ended: True, f"{ended}{ended}": True, sound[:-1]: False, "": False, None: False, "no object": False, sound.replace('"r"', '"R"'): False, sound.replace('"r"', "null"): False,
        sound.replace('"bbox": null', '"bbox": [0, 1, 2, 4096]'): True, sound.replace('"bbox": null', '"bbox": [0, 1, 2, 4097]'): False, sound.replace('"bbox": null', '"bbox": [0, 1, 2, 3.0]'): False, sound.replace('"bbox": null', '"bbox": [0, 1, 2, true]'): False,
        sound.replace("c1", "c2"): False, sound.replace('"reason": null', '"reason": null, "reason": null'): False, sound.replace('"left"', '"left", "n": NaN'): False, ended.replace('"gone"', '"a }{ b"'): False, "{} " + sound: False, sound.replace('"tool": "click", ', ""): False,
    }
    df = spark.createDataFrame([("c1", t) for t in texts], "case_id string, raw string").withColumn("k", F.monotonically_increasing_id())
    found = grounding.compiled_predictions(df.select("case_id", "raw").coalesce(1), "case_id", "raw").collect()
    assert [r.compiled for r in found] == list(texts.values())
    assert all((r.disposition, r.reason) == ("fallback", "model_output_invalid") for r in found if not r.compiled)
    objects = ['{"a": "}"} x', 'x{"a": {"b": ["]}"]}} y}', "{", "[1]", 'say "{" {"a": 1}']
    cut = spark.createDataFrame([(t,) for t in objects], "t string").coalesce(1).select(lexical.first_object(F.col("t"))).collect()
    assert [r[0] for r in cut] == ['{"a": "}"}', '{"a": {"b": ["]}"]}}', None, None, '{" {"a": 1}']  # the last one is no JSON


def test_scalars_are_tagged_by_two_replacements(spark):
    raw = r'{"k": "a\" 1", "n" : [1, -2.5e3, true, null, "5", ""], "": {}}'
    said = spark.range(1).select(lexical.tagged(F.lit(raw)).alias("t"), lexical.brackets(F.lit(raw)).alias("b")).first()
    assert said.t == r'{"sk": "sa\" 1", "sn" : ["1", "-2.5e3", "true", "null", "s5", "s"], "s": {}}' and said.b == "{[]{}}"


def test_levels_are_those_of_strict_documents(spark):
    deep = "[" * 40
    texts = [('{"a": [1]}', None), (deep, "{}")]
    assert walk.deepest(spark.createDataFrame(texts, "l string, r string"), F.col("l"), F.col("r")) <= walk.LEVELS
    assert walk.deepest(spark.createDataFrame([*texts, (deep + "]" * 40, "{}")], "l string, r string"), F.col("l"), F.col("r")) == 40
