"""Contracts over nested JSON records as ordered rules on VARIANT columns.

A document is parsed once (:func:`document`).  What rules look at is *opened* once too: an opened
value is a struct of kind, what a scalar says, the variant of an object or list and, for an object, its
keys and its fields, each with kind, ``said`` and variant; :class:`Scope` makes the opened parts columns
of their own, so a rule is a look-up and a comparison and nothing is taken apart twice.  No value is
written as JSON again (the engine sets up a writer for each string): :func:`json_of` does so where a
rule needs it.  No Python runs for a document that parses.  Rules keep the order in which a validator that stops at the first offence would look, so
:func:`.rules.first_broken` gives its code and location; lists are judged item by item inside their
own row, without explode or shuffle.  Null documents are malformed ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.lexical import bound
from .rules import Rule, first_broken, strict_json_code


def document(raw: str | Column) -> Column:
    """A3: the parsed document, null if it isn't strict JSON.

    Numbers that the engine's parser would change are replaced first, so integers of any length stay integers
    in their order, and no number becomes Infinity (C3, C8).
    The engine's parser refuses repeated keys and NaN, but stops after the first value.  So the text is parsed once, as the
    first item of a list that ends with the text's own digest: what follows the value can close the list too early or add items
    to it, but no text holds its own digest as the second of them.
    """
    text = F.col(raw) if isinstance(raw, str) else raw
    return F.when(text.isNotNull(), bound(F.struct(_with_digest(text, lexical.with_bounded_numbers(text)).alias("items"), F.sha2(text, 256).alias("digest")), lambda x: F.when(_is_alone(x["items"], x["digest"]), F.get(x["items"], F.lit(0)))))


def _with_digest(raw: Column, text: Column) -> Column:
    """What the parser reads of a list of ``text`` (``raw`` itself or made from it) and the digest of ``raw``."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(raw, 256), F.lit('"]'))), "$", "array<variant>")


def _is_alone(items: Column, digest: Column) -> Column:
    return (F.size(items) == 2) & F.coalesce(F.try_variant_get(F.get(items, F.lit(1)), "$", "string") == digest, F.lit(False))


def is_strict(raw: Column) -> Column:
    """A3: whether the text is strict JSON; no lambda is in it, so it may stand in an argument of a Python function."""
    return F.coalesce(_is_alone(_with_digest(raw, raw), F.sha2(raw, 256)), F.lit(False))


def parse_code(raw: str, parsed: Column) -> Column:
    """A3: null for strict JSON, else its code; Python sees only what the parser refused."""
    refused = F.when(parsed.isNull(), F.col(raw)).otherwise("0")  # of the others it sees one digit
    return F.when(parsed.isNull(), F.coalesce(strict_json_code(refused), F.lit("MALFORMED_JSON")))


def with_document(df: DataFrame, raw: str, name: str) -> DataFrame:
    """:func:`document` as a column beside the others: each step is a column of its own, so generated code runs it and no text is parsed twice."""
    text = F.col(raw)
    digest, items = f"{name}_digest", f"{name}_items"
    read = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), lexical.with_bounded_numbers(text), F.lit(',"'), F.col(digest), F.lit('"]'))), "$", "array<variant>")
    return df.withColumn(digest, F.sha2(text, 256)).withColumn(items, read).withColumn(name, F.when(_is_alone(F.col(items), F.col(digest)), F.get(items, F.lit(0)))).drop(digest, items)


#: Kinds: the first letters of the parser's types (schema_of_variant); those of numbers are BIGINT, DECIMAL and DOUBLE.
OBJECT, LIST, TEXT, FLAG, NULL, INTEGER, DECIMAL, DOUBLE = "OBJ", "ARR", "STR", "BOO", "VOI", "BIG", "DEC", "DOU"


def _kind(v: Column) -> Column:
    return F.substring(F.schema_of_variant(v), 1, 3)


def with_opened_fields(df: DataFrame, source: str, names: Iterable[str], name: str) -> DataFrame:
    """A variant column as an opened value of which only the named fields are opened, and without the JSON text of the whole.

    A writer of JSON is costly to set up, so what needs no escape is written without one, and what a field is comes from its type.  Each step is a
    column of its own, as in :func:`with_document`; a lambda in each keeps them out of whole-stage code, whose one method would be too long for the
    JVM to compile.
    """
    names = list(names)
    place = {f: f"{name}_{k}" for k, f in enumerate(names)}
    df = df.withColumns({f"{name}_is": bound(F.col(source), lambda v: v.isNotNull())} | {at_: F.try_variant_get(F.col(source), f"$.{f}", "variant") for f, at_ in place.items()})
    df = df.withColumns({f"{name}_type": bound(F.col(source), F.schema_of_variant)} | {f"{at_}t": F.schema_of_variant(at_) for at_ in place.values()} | {f"{at_}s": F.try_variant_get(F.col(at_), "$", "string") for at_ in place.values()})

    def leaf(at_: str) -> Column:
        v, type_, said = F.col(at_), F.col(f"{at_}t"), F.col(f"{at_}s")
        quoted = F.when(~said.rlike(r'[\x00-\x1F"\\]'), F.concat(F.lit('"'), said, F.lit('"'))).otherwise(F.to_json(v))
        as_said = type_.isin("BOOLEAN", "BIGINT") | F.startswith(type_, F.lit("OBJECT<")) | F.startswith(type_, F.lit("ARRAY<"))
        kind_ = F.substring(type_, 1, 3)
        return F.when(v.isNotNull(), F.struct(kind_.alias("kind"), F.when(~kind_.isin(OBJECT, LIST), said).alias("said"), F.when(type_ == "STRING", quoted).when(as_said, said).otherwise(F.to_json(v)).alias("json"), v.alias("v")))

    whole, fields = F.col(source), F.create_map(*(x for f, at_ in place.items() for x in (F.lit(f), leaf(at_))))
    value = F.when(F.col(f"{name}_is"), F.struct(bound(F.substring(f"{name}_type", 1, 3), lambda k: k).alias("kind"), whole.alias("v"), fields.alias("fields")))
    return df.withColumn(name, value).drop(f"{name}_is", f"{name}_type", *(f"{at_}{x}" for at_ in place.values() for x in ("", "t", "s")))


def _leaf(x: Column) -> Column:
    """kind, what it says (scalars) and v (objects and lists) of one value."""

    def parts(k: Column) -> Column:
        deep = k.isin(OBJECT, LIST)
        return F.struct(k.alias("kind"), F.when(~deep, F.try_variant_get(x, "$", "string")).alias("said"), F.when(deep, x).alias("v"))

    return bound(_kind(x), parts)


def _items(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), _leaf)


def opened(v: Column, names: Iterable[str] | None = None) -> Column:
    """A variant as kind, said, v, keys and fields; with ``names``, these alone are opened, each where it can be read without a search."""
    of = lambda fields: fields if names is None else F.struct(*(F.try_element_at(fields, F.lit(f)).alias(f) for f in names))

    def whole(given: Column) -> Column:
        fields = bound(F.transform_values(given, lambda k, x: _leaf(x)), of)
        value = lambda x: F.struct(F.coalesce(x["kind"], F.lit(OBJECT)).alias("kind"), x["said"].alias("said"), F.when(x.isNull(), v).otherwise(x["v"]).alias("v"), F.map_keys(given).alias("keys"), fields.alias("fields"))
        return bound(F.when(given.isNull(), _leaf(v)), value)

    return F.when(v.isNotNull(), bound(F.try_variant_get(v, "$", "map<string,variant>"), whole))


class Scope:
    """Columns that hold opened parts of a document, in the order in which they are to be made; ``raw`` is its text."""

    def __init__(self, raw: Column):
        self.raw = raw
        self.steps: list[tuple[str, Column]] = []

    def keep(self, value: Column) -> Column:
        name = f"__part{len(self.steps)}"
        self.steps.append((name, value))
        return F.col(name)

    def leaf(self, v: Column) -> Column:
        """A whole document, before it is opened; what a scalar says isn't looked at."""
        return self.keep(F.struct(_kind(v).alias("kind"), F.lit(None).cast("string").alias("said"), v.alias("v")))

    def open(self, value: Column, names: Iterable[str]) -> Column:
        """A field that may be an object, with the fields that rules look at."""
        return self.keep(opened(value["v"], names))

    def open_items(self, value: Column, names: Iterable[str]) -> Column:
        """The items of a list, each opened as in :meth:`open`."""
        return self.keep(F.transform(F.try_variant_get(value["v"], "$", "array<variant>"), lambda x: opened(x, names)))

    def nonfinite(self) -> Column:
        """Paths of the numbers that no double holds, in document order."""
        return self.keep(F.when(F.col("__parsed").isNotNull() & lexical.may_be_nonfinite(self.raw), lexical.hits(self.raw, lexical.is_nonfinite)))

    def forbidden(self, whole: Column, names: Iterable[str], fold_case: bool = True) -> Column:
        """Paths of the forbidden keys at any depth, in document order; only a document that has one is walked."""
        said = lambda t: F.lower(lexical.string_value(t)) if fold_case else lexical.string_value(t)
        return self.keep(F.when(lexical.may_have_key(self.raw, names, fold_case) & has_key(whole, names, fold_case), lexical.hits(self.raw, lambda t: lexical.is_key(t) & said(t).isin(*sorted(names)))))

    def applied(self, df: DataFrame) -> DataFrame:
        for name, value in self.steps:
            df = df.withColumn(name, value)
        return df


def judged(df: DataFrame, keys: list[str], raw: str, root: str, rules: Callable[[Column, Scope], list[Rule]], more: tuple[str, ...] = (), most_bytes: int | None = None, also: Callable[[], list[Column]] | None = None) -> DataFrame:
    """``keys``, what ``also`` makes of the parts that ``rules`` opened, and code and location of the first rule that it breaks; size and text come first."""
    scope = Scope(F.col(raw))
    doc = scope.leaf(F.col("__parsed"))
    found = first_broken(rules(doc, scope))
    parsed = with_document(df.select(*keys, *(x for x in (raw, *more) if x not in keys)), raw, "__parsed")
    code = parse_code(raw, F.col("__parsed"))
    if most_bytes is not None:
        code = F.when(F.octet_length(raw) > most_bytes, "INPUT_TOO_LARGE").otherwise(code)
    parts = scope.applied(parsed.withColumn("__code", code))
    both = F.when(F.col("__code").isNotNull(), F.struct(F.col("__code").alias("code"), F.lit(root).alias("location"))).otherwise(found)
    # a filter on the result stays above the generator, so the rules aren't written out once more in its condition
    return parts.select(*keys, *(also() if also else []), F.inline_outer(F.array(both)))


def at(value: Column, field: str) -> Column:
    """A field of an opened object: kind, said and v; SQL null where it is missing."""
    return value["fields"][field]


def json_of(value: Column) -> Column:
    """The value as JSON text; what needs no escape is written without a writer of JSON."""
    said = value["said"]
    escaped = F.to_json(F.struct(said.alias("s")))  # {"s":...}
    quoted = F.when(~said.rlike(r'[\x00-\x1F"\\]'), F.concat(F.lit('"'), said, F.lit('"'))).otherwise(F.substr(escaped, F.lit(6), F.length(escaped) - 6))
    return F.when(value["v"].isNotNull(), F.to_json(value["v"])).when(value["kind"] == TEXT, quoted).when(value["kind"] == NULL, "null").otherwise(said)


def text(value: Column) -> Column:
    """The string that a value is; null if it is none."""
    return F.when(value["kind"] == TEXT, value["said"])


def text_at(value: Column, field: str) -> Column:
    return text(at(value, field))


def number_at(value: Column, field: str) -> Column:
    """An integer of any length, as a decimal of 38 digits."""
    found = at(value, field)
    return F.when((found["kind"] == INTEGER) | ((found["kind"] == DECIMAL) & found["said"].rlike("^-?[0-9]+$")), found["said"].try_cast("decimal(38,0)"))


def items(value: Column) -> Column:
    """The items of a list, each with kind, said and v; null if it is none."""
    return _items(value["v"])


def length_at(value: Column, field: str) -> Column:
    """How many items a list has; null if it is none."""
    return F.size(F.try_variant_get(at(value, field)["v"], "$", "array<variant>"))


def items_at(value: Column, field: str) -> Column:
    return items(at(value, field))


def values(value: Column) -> Column:
    """The values of an object's fields, each with kind, said and v."""
    return F.transform(F.map_values(F.try_variant_get(value["v"], "$", "map<string,variant>")), _leaf)


def kind(value: Column) -> Column:
    return F.coalesce(value["kind"], F.lit("missing"))


def is_object(value: Column) -> Column:
    return kind(value) == OBJECT


def is_list(value: Column) -> Column:
    return kind(value) == LIST


def is_null(value: Column) -> Column:
    return kind(value).isin(NULL, "missing")


def is_flag(value: Column) -> Column:
    return kind(value) == FLAG


def is_true(value: Column) -> Column:
    return is_flag(value) & (value["said"] == "true")


def is_false(value: Column) -> Column:
    return is_flag(value) & (value["said"] == "false")


def is_string(value: Column) -> Column:
    return kind(value) == TEXT


def is_text(value: Column) -> Column:
    """A string that isn't empty."""
    return (kind(value) == TEXT) & (value["said"] != "")


def is_integer(value: Column, least: int | None = None, most: int | None = None) -> Column:
    """An integer and no boolean; integers beyond 64 bits are unbounded ones."""
    whole, n = kind(value) == INTEGER, value["said"].try_cast("bigint")
    if least == 0 and most is None:
        whole &= ~F.startswith(value["said"], F.lit("-"))
    elif least is not None:
        whole &= n >= least
    if most is not None:
        return whole & (n <= most)
    return whole | ((kind(value) == DECIMAL) & value["said"].rlike("^[0-9]{19,}$" if least is not None else "^-?[0-9]{19,}$"))


def is_any_number(value: Column) -> Column:
    return kind(value).isin(INTEGER, DECIMAL, DOUBLE)


def double(value: Column) -> Column:
    """A number as a double; null if it is none."""
    return F.when(is_any_number(value), value["said"].try_cast("double"))


def is_number(value: Column, least: float, most: float) -> Column:
    return F.coalesce(double(value).between(least, most), F.lit(False))


def is_exactly(value: Column, expected: int | str) -> Column:
    """The very integer or string: 1.0 isn't 1, and "1" isn't either."""
    return (kind(value) == (INTEGER if isinstance(expected, int) else TEXT)) & (value["said"] == str(expected))


def is_member(value: Column, allowed: Iterable[str]) -> Column:
    return F.coalesce(text(value).isin(*sorted(allowed)), F.lit(False))


def matches(value: Column, pattern: str) -> Column:
    """C4: a string that the pattern takes from end to end."""
    return F.coalesce(text(value).rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def keys(value: Column) -> Column:
    """The keys of an opened object, sorted; none for another value."""
    return F.coalesce(value["keys"], F.array().cast("array<string>"))


def keys_of(field: Column) -> Column:
    """:func:`keys` of a field that isn't opened itself."""
    return F.coalesce(F.map_keys(F.try_variant_get(field["v"], "$", "map<string,variant>")), F.array().cast("array<string>"))


def literal(names: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")


def closed(value: Column, required: Column, allowed: Column, location: str | Column, missing: str = "MISSING_FIELD", unknown: str = "UNKNOWN_FIELD") -> list[Rule]:
    """Every required key, and none that isn't allowed.  Both lists are sorted, as keys are: an object that has just the required ones needs no search."""
    other = ~F.coalesce(value["keys"] == required, F.lit(False))
    return [(missing, location, other & (F.size(F.array_except(required, keys(value))) > 0)), (unknown, location, other & (F.size(F.array_except(keys(value), allowed)) > 0))]


def exact(value: Column, fields: Iterable[str], location: str | Column) -> list[Rule]:
    fields = list(fields)
    return closed(value, literal(fields), literal(fields), location)


def strings(value: Column) -> Column:
    """The items of a list of strings (C6); null if it is no list."""
    return F.transform(F.try_variant_get(value["v"], "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def all_texts(value: Column) -> Column:
    return F.coalesce(F.forall(strings(value), lambda s: F.coalesce(s != "", F.lit(False))), F.lit(False))


def repeats(array: Column) -> Column:
    """An item occurs twice."""
    return F.coalesce(F.size(F.array_distinct(array)) < F.size(array), F.lit(False))


def has_key(value: Column, names: Iterable[str], fold_case: bool = True) -> Column:
    """Any of the keys at any depth.  In written JSON a quote inside a string is escaped, so only a key has an open one before the colon."""
    fold = "(?i)" if fold_case else ""
    return F.coalesce(F.to_json(value["v"]).rlike(rf'{fold}(?<!\\)"(?:{"|".join(sorted(names))})":'), F.lit(False))


def located(found: Column, prefix: str | Column, code: str, root: str) -> tuple[str, Column, Column]:
    """A rule that breaks at the first path that :meth:`Scope.nonfinite` or :meth:`Scope.forbidden` found below the prefix."""
    path = lexical.first_below(found, prefix)
    return (code, F.concat(F.lit(root), path), path.isNotNull())


def first_of_items(array: Column, rules: Callable[[Column, Column], list[Rule]]) -> Column:
    """The first broken rule of the first item that breaks one: struct of code and location, or null."""
    found = F.transform(array, lambda x, i: first_broken(rules(x, i)))
    return F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0))


def nested(found: Column) -> list[tuple[Column, Column, Column]]:
    """What :func:`first_of_items` found as a rule of the outer list."""
    return [(found["code"], found["location"], found.isNotNull())]
