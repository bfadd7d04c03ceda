"""Canonical JSON and digests.

Built-in ``to_json`` writes strings, integers, booleans and nulls as canonical JSON does, so
structs of those need no Python.  Values with floats go through ``canonical_json``, an
Arrow-batched function, because the engine writes floats differently.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_struct(**fields: Column) -> Column:
    """I1 without floats: keys sorted by code point, nulls written, no blanks."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """I1 for any JSON text: sorted keys, compact, not ASCII-escaped; null if it isn't strict JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        except ValueError:
            return None

    return raw.map(one)


def digest(canonical: Column, newline: bool = False) -> Column:
    """``sha256:<hex>``; some identities hash a trailing newline too, which changes every digest."""
    text = F.concat(canonical, F.lit("\n")) if newline else canonical
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def domain_digest(domain: str, canonical: Column) -> Column:
    """The domain, a NUL, the canonical text and a newline under one hash."""
    return F.sha2(F.concat(F.lit(domain), F.char(F.lit(0)), canonical, F.lit("\n")), 256)


def git_blob_sha1(content: Column) -> Column:
    """I4: the object id that Git gives a blob."""
    raw = F.to_binary(content, F.lit("utf-8"))
    return F.sha1(F.concat(F.to_binary(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0))), F.lit("utf-8")), raw))


def token_digest(ids: Column) -> Column:
    """Comma-joined ids under SHA-256."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)


def private_digest(domain: str, text: Column) -> Column:
    """Stripped and lower-cased text behind a domain."""
    return F.sha2(F.concat(F.lit(domain), F.char(F.lit(0)), F.lower(F.trim(text))), 256)
