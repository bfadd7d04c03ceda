"""JSON as it is written: tokens, exact numbers, paths in document order, depth.

The engine's parser turns ``1e999`` into Infinity and integers of 39 digits into doubles, and a
VARIANT sorts an object's keys.  What depends on the text itself is therefore read from its tokens,
with built-in expressions alone.  Everything but
:func:`with_bounded_numbers` expects texts that are known to be strict JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string (with its colon, if it is a key), a bracket or comma, a number or literal.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[{}\[\],]|[^\s{}\[\],:"]++'
#: Integers of so many digits are replaced before they are parsed.
LONG_DIGITS = 38
#: An object or list of at most so many levels, all strings in it closed.
_LEVELS = 6
_SHALLOW = ""
for _ in range(_LEVELS):
    _SHALLOW = rf'[{{\[](?:[^{{}}\[\]"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"{"|" if _SHALLOW else ""}{_SHALLOW})*+[}}\]]'
#: What stands behind a number of a document; behind the digits of a digest in a string stands a quote.
_NUMBER_ENDS = r"(?:[\s,\]}]|\z)"
MOST_DOUBLE = 1.7976931348623157e308
_STATE = "struct<stack: array<struct<key: string, at: int>>, hits: array<struct<path: string, token: string>>>"


def tokens(raw: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(TOKEN), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def is_key(token: Column) -> Column:
    return F.endswith(token, F.lit(":"))


def string_value(token: Column) -> Column:
    """What a string token or the string of a key token says."""
    plain = F.regexp_extract(token, r'(?s)^"(.*)"\s*:?$', 1)
    return F.when(token.contains("\\"), F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), plain, F.lit('"'))), "$", "string")).otherwise(plain)


def is_nonfinite(token: Column) -> Column:
    """A number with a fraction or exponent that no double holds (integers have no limit)."""
    return token.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$") & token.rlike("[.eE]") & (F.abs(token.try_cast("double")) == float("inf"))


def may_be_nonfinite(raw: Column) -> Column:
    """A cheap test that no nonfinite number passes by: an exponent of three digits, or very many digits, where a number can end."""
    return raw.rlike(rf"[0-9.](?:[0-9]{{199}}[0-9.eE+-]*+|[eE]\+?0*[0-9]{{3}}[0-9]*+){_NUMBER_ENDS}")


def may_have_key(raw: Column, names: Iterable[str], fold_case: bool = True) -> Column:
    """A cheap test that no document with one of the keys (of letters, digits and ``_``) passes by: the key as it is, or an escape that could be a letter of it."""
    return raw.rlike(rf'{"(?i)" if fold_case else ""}"(?:{"|".join(sorted(names))})"\s*+:|\\u')


def hits(raw: Column, is_hit: Callable[[Column], Column]) -> Column:
    """path and token of every token that is a hit, in document order; paths like ``.a[0].b``, of a key its own."""
    entry = lambda key, at: F.struct(key.cast("string").alias("key"), at.cast("int").alias("at"))
    nothing = F.lit(None)

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        top, below = F.try_element_at(stack, F.lit(-1)), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        after = (
            F.when(token == "{", F.concat(stack, F.array(entry(nothing, nothing)))).when(token == "[", F.concat(stack, F.array(entry(nothing, F.lit(0))))).when(token.isin("}", "]"), below)
            .when((token == ",") & top["at"].isNotNull(), F.concat(below, F.array(entry(nothing, top["at"] + 1)))).when(is_key(token), F.concat(below, F.array(entry(string_value(token), nothing)))).otherwise(stack)
        )
        label = lambda x: F.when(x["at"].isNotNull(), F.concat(F.lit("["), x["at"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.coalesce(x["key"], F.lit(""))))
        found = lambda now: F.struct(F.array_join(F.transform(now, label), "").alias("path"), token.alias("token"))
        return bound(after, lambda now: F.struct(now.alias("stack"), F.when(is_hit(token), F.concat(state["hits"], F.array(found(now)))).otherwise(state["hits"]).alias("hits")).cast(_STATE))

    start = F.struct(F.array().cast("array<struct<key: string, at: int>>").alias("stack"), F.array().cast("array<struct<path: string, token: string>>").alias("hits")).cast(_STATE)
    return F.aggregate(tokens(raw), start, step, lambda state: state["hits"])


def first_below(found: Column, prefix: str | Column) -> Column:
    """Of what :func:`hits` found, the path of the first one below the prefix; null if there is none."""
    return F.get(F.filter(found, lambda h: F.startswith(h["path"], F.lit(prefix))), F.lit(0))["path"]


def brackets(raw: Column) -> Column:
    """The brackets alone: what of a text decides how deep it is."""
    return F.regexp_replace(raw, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^{}\[\]"]++'), F.lit(""))


def depth(raw: Column) -> Column:
    """How deep arrays and objects are nested: 0 for a scalar."""
    way = F.transform(tokens(brackets(raw)), lambda t: F.when(t.isin("{", "["), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(way, start, lambda s, w: F.struct((s["now"] + w).alias("now"), F.greatest(s["most"], s["now"] + w).alias("most")), lambda s: s["most"])


def with_bounded_numbers(raw: Column) -> Column:
    """The document with numbers that the engine's parser would change replaced by ones that it keeps.

    Integers of ``LONG_DIGITS`` or more digits become ones of exactly so many, above every shorter
    integer and in the same order and equality among themselves, so each comparison of two integers of
    the document comes out as for the originals.  Numbers that no double holds become the greatest
    double, so they stay numbers and no integers.  All else stays as it is, so a text that isn't JSON stays none.
    """
    is_long = lambda t: t.rlike(rf"^-?[1-9][0-9]{{{LONG_DIGITS - 1},}}$")
    value = lambda t: bound(F.ltrim(t, F.lit("-")), lambda d: F.struct(F.length(d).alias("n"), d.alias("d")))
    sign = lambda t: F.when(F.startswith(t, F.lit("-")), "-").otherwise("")
    least = "1" + "0" * (LONG_DIGITS - 13)  # and twelve digits of the place among the document's own

    def rewritten(found: Column) -> Column:
        def with_places(known: Column) -> Column:
            new = lambda t: F.when(is_long(t), F.concat(sign(t), F.lit(least), F.lpad(F.array_position(known, value(t)).cast("string"), 12, "0"))).when(is_nonfinite(t), F.concat(sign(t), F.lit(str(MOST_DOUBLE)))).otherwise(t)
            return F.array_join(F.transform(found, new), "")

        return bound(F.array_sort(F.array_distinct(F.transform(F.filter(found, is_long), value))), with_places)

    return F.when(_may_have_unbounded_numbers(raw), bound(F.regexp_extract_all(raw, F.lit(TOKEN + r"|\s++|."), F.lit(0)), rewritten)).otherwise(raw)


def _may_have_unbounded_numbers(raw: Column) -> Column:
    """A cheap test, in one pass, that no document passes by that :func:`with_bounded_numbers` would change."""
    return raw.rlike(rf"[0-9.](?:[0-9]{{{LONG_DIGITS - 1}}}[0-9.eE+-]*+|[eE]\+?0*[0-9]{{2}}[0-9]*+){_NUMBER_ENDS}")


def first_object(text: Column) -> Column:
    """From the first ``{`` to the bracket that closes it, whatever stands around; null if there is none.

    Only brackets outside strings count, so what comes out is the whole first object wherever that is JSON.  One pass of
    a pattern finds it in texts of few levels and closed strings; the others are taken apart token by token.
    """
    way = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + way(token)
        open_still = F.struct(depth.alias("depth"), (state["n"] + 1).alias("n"), (depth == 0).alias("done"))
        return F.when(state["done"], state).otherwise(open_still)

    def cut(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        end = F.aggregate(found, start, step, lambda s: F.when(s["done"], s["n"]))
        return bound(end, lambda n: F.when(n.isNotNull(), F.array_join(F.slice(found, F.lit(1), n), "")))

    at = F.instr(text, "{")
    shallow = F.regexp_extract(text, rf"(?s)\A[^{{]*+({_SHALLOW})", 1)
    return F.when(at > 0, bound(shallow, lambda found: F.when(found != "", found).otherwise(_deep(text, at, cut))))


def _deep(text: Column, at: Column, cut: Callable[[Column], Column]) -> Column:
    return bound(F.regexp_extract_all(F.substr(text, at), F.lit(TOKEN + r"|\s++|."), F.lit(0)), cut)


def tagged(raw: Column) -> Column:
    """The document with every scalar as a string: behind an ``s`` what was a string, keys too; as written the number or literal, of which none begins so."""
    body = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    return F.regexp_replace(F.regexp_replace(raw, F.lit(f"(?s){body}"), F.lit('"s$1"')), F.lit(rf'(?s){body}|([^\s{{}}\[\],:"]++)'), F.lit('"$1$2"'))
