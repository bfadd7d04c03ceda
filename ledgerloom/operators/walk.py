"""Nested documents taken apart level by level.

Each level is one ``inline`` of a VARIANT's fields or items, so a document of depth d is d narrow steps and
nothing is shuffled or collected; how many steps there are is the depth of the deepest document,
worked out in one pass before.  Scalars are read as they are written (:func:`.lexical.tagged`), so no
number changes on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..sources.scratch import written_once
from .contracts import document, parse_code, with_document

#: Levels that one plan takes apart; the rows of deeper documents are written in between, so that no plan grows with its data.
LEVELS = 16
_NODE = "array<struct<path: string, name: string, v: variant>>"
_PAIR = "array<struct<path: string, l: variant, r: variant>>"


def _tree(raw: Column) -> Column:
    return F.try_parse_json(lexical.tagged(raw))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _key(name: Column) -> Column:
    return F.substr(name, F.lit(2))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _written(v: Column) -> Column:
    """A leaf as JSON: an empty list or object, a string, a literal or number; equal numbers alike, integers of any length kept."""
    said = F.try_variant_get(v, "$", "string")
    own = F.when(F.startswith(said, F.lit("s")), F.substr(said, F.lit(2))).otherwise(said)
    number = F.when(own.rlike("[.eE]"), own.try_cast("double").cast("string")).when(own == "-0", "0").otherwise(own)
    plain = F.when(F.startswith(own, F.lit("t")) | F.startswith(own, F.lit("f")) | (own == "null"), own).otherwise(number)
    quoted = F.regexp_extract(F.to_json(F.struct(own.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(_fields(v).isNotNull(), "{}").when(_items(v).isNotNull(), "[]").when(F.startswith(said, F.lit("s")), quoted).otherwise(plain)


def deepest(df: DataFrame, *raws: Column) -> int:
    """Levels that hold every strict document of the columns: the depth of the deepest, or up to ``LEVELS``.

    A text's depth is that of its brackets, so each shape is looked at once; only texts of more than ``LEVELS`` are parsed, as those that are no JSON
    mustn't add levels.
    """
    texts = df.select(F.explode(F.array(*raws)).alias("raw")).where("raw is not null").withColumn("shape", lexical.brackets(F.col("raw")))
    depths = texts.select("shape").distinct().select(lexical.depth(F.col("shape")).alias("d")).agg(F.max("d"), F.max(F.when(F.col("d") <= LEVELS, F.col("d")))).first()
    if (depths[0] or 0) <= LEVELS:
        return depths[1] or 0
    beyond = texts.where(F.length("shape") > 2 * LEVELS).select("raw", lexical.depth(F.col("shape")).alias("d")).where(F.col("d") > LEVELS)
    return max(depths[1] or 0, beyond.agg(F.max(F.when(document("raw").isNotNull(), F.col("d")))).first()[0] or 0)


def _descended(rows: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int) -> DataFrame:
    for level in range(levels):
        if level and level % LEVELS == 0:
            rows = written_once(rows, "walk")
        rows = step(rows)
    return rows


def leaves(df: DataFrame, key: str, raw: str) -> DataFrame:
    """One row for each leaf of a JSON document of any depth: path, name of the last key, value as JSON.

    A document that is null or no strict JSON has one row, with its code as the name and null as path and value.
    """

    def children(rows: DataFrame) -> DataFrame:
        # what a node holds is taken out once, as columns; lambdas that name it would do so again for every child
        rows = rows.withColumns({"__fields": _fields(F.col("v")), "__items": _items(F.col("v"))})
        path, name, fields, items = F.col("path"), F.col("name"), F.col("__fields"), F.col("__items")
        of_object = F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(path, F.lit("."), _key(e["key"])).alias("path"), _key(e["key"]).alias("name"), e["value"].alias("v")))
        of_list = F.transform(items, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), name.alias("name"), x.alias("v")))
        itself = F.array(F.struct(path.alias("path"), name.alias("name"), F.col("v").alias("v")))
        return rows.select("__key", "__code", F.inline(F.when(F.size(fields) > 0, of_object.cast(_NODE)).when(F.size(items) > 0, of_list.cast(_NODE)).otherwise(itself.cast(_NODE))))

    parsed = with_document(df.select(F.col(key).alias("__key"), F.col(raw).alias("__raw")), "__raw", "__parsed")
    code = parse_code("__raw", F.col("__parsed"))
    rows = parsed.select("__key", code.alias("__code"), F.lit("$").alias("path"), F.lit("").alias("name"), F.when(F.col("__parsed").isNotNull(), _tree(F.col("__raw"))).alias("v"))
    rows = _descended(rows, children, deepest(df, F.col(raw)))
    refused = F.col("__code").isNotNull()
    return rows.select(F.col("__key").alias(key), F.when(~refused, F.col("path")).alias("path"), F.coalesce("__code", "name").alias("name"), F.when(~refused, _written(F.col("v"))).alias("value"))


def _equal(a: Column, b: Column) -> Column:
    """Of two leaves, as Python's ``==`` has it: numbers and booleans by value, however they are written.

    An integer of 2**53 or more equals itself alone.
    """
    number = lambda said: F.when(said == "true", 1.0).when(said == "false", 0.0).when(said.rlike("^-?[0-9I]"), said.try_cast("double"))
    return (_written(a) == _written(b)) | F.coalesce((number(_written(a)) == number(_written(b))) & (F.abs(number(_written(a))) < 2.0**53), F.lit(False))


def changed_paths(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Path of every place at which two documents differ; both are walked together.

    A key that one side lacks is its path and nothing below it, lists of different lengths are the list's
    path alone, and values of different kinds are theirs; numbers are equal by value.  A side that is null
    or no strict JSON differs at ``$``, unless both have the same text.
    """

    def children(rows: DataFrame) -> DataFrame:
        # as in :func:`leaves`: a lambda that names a node's map would make it again for every key
        rows = rows.withColumns({f"__{x}{kind}": of(F.col(x)) for x in ("l", "r") for kind, of in (("fields", _fields), ("items", _items))})
        path, a, b, fa, fb, ia, ib = (F.col(x) for x in ("path", "l", "r", "__lfields", "__rfields", "__litems", "__ritems"))
        one = lambda p, x, y: F.struct(p.alias("path"), x.alias("l"), y.alias("r"))
        names = F.array_union(F.map_keys(fa), F.map_keys(fb))
        of_object = F.transform(names, lambda k: one(F.concat(path, F.lit("."), _key(k)), F.try_element_at(fa, k), F.try_element_at(fb, k)))
        of_list = F.transform(F.arrays_zip(ia.alias("x"), ib.alias("y")), lambda z, i: one(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), z["x"], z["y"]))
        itself = F.array(one(path, a, b))
        return rows.select("__key", F.inline(F.when((F.size(fa) > 0) & (F.size(fb) > 0), of_object.cast(_PAIR)).when((F.size(ia) > 0) & (F.size(ia) == F.size(ib)), of_list.cast(_PAIR)).otherwise(itself.cast(_PAIR))))

    # an object's missing key is SQL null; a document that is no JSON is a string that no leaf is
    differ = pairs.where(~F.col(left).eqNullSafe(F.col(right))).select(F.col(key).alias("__key"), F.lit("$").alias("path"), F.col(left).alias("__l"), F.col(right).alias("__r"))
    read = with_document(with_document(differ, "__l", "__ldocument"), "__r", "__rdocument")
    root = lambda x: F.when(F.col(f"__{x}document").isNotNull(), _tree(F.col(f"__{x}"))).alias(x)
    rows = _descended(read.select("__key", "path", root("l"), root("r")), children, deepest(differ, F.col("__l"), F.col("__r")))
    a, b = F.col("l"), F.col("r")
    kinds = lambda v: F.when(_fields(v).isNotNull(), 1).when(_items(v).isNotNull(), 2).otherwise(0)
    container = (kinds(a) > 0) | (kinds(b) > 0)
    both_empty = (kinds(a) == kinds(b)) & (F.coalesce(F.size(_fields(a)), F.size(_items(a))) == F.coalesce(F.size(_fields(b)), F.size(_items(b))))
    # objects of which one is empty part at the other's keys
    one_sided = (kinds(a) == 1) & (kinds(b) == 1) & ~both_empty
    same = F.when(a.isNull() | b.isNull(), False).when(container, F.coalesce(both_empty, F.lit(False))).otherwise(_equal(a, b))
    names = F.when(one_sided, F.transform(F.array_union(F.map_keys(_fields(a)), F.map_keys(_fields(b))), lambda k: F.concat(F.col("path"), F.lit("."), _key(k)))).otherwise(F.array("path"))
    return rows.where(~same).select(F.col("__key").alias(key), F.explode(names).alias("path"))


def changed_leaves(before: DataFrame, after: DataFrame, key: str, raw: str, allowed: list[str]) -> DataFrame:
    """Leaves that differ between two versions of a document, and whether the path is one that may; ``!CODE`` is the path of one that isn't JSON."""
    a, b = (leaves(df, key, raw).withColumn("path", F.coalesce("path", F.concat(F.lit("!"), "name"))) for df in (before, after))
    both = a.select(key, "path", F.col("value").alias("before")).join(b.select(key, "path", F.col("value").alias("after")), [key, "path"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("allowed", F.col("path").isin(allowed))
