"""Token counts by the whole-token shortcut (operator 5).

Offline, every vocabulary string is tried alone: those that the merge rules leave as
one token form the *whole-token table*.  A text is then cut into pre-tokens; a
pre-token in the table counts as one without any merging, and only the rest goes
through the merge rules (each distinct one once, in a bounded memo).

Counts equal those of the ``tokenizers`` library: special strings inside texts are
its default special tokens, nothing is added, truncated or padded.  Null and empty
texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows and extra
columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import raw_bytes

#: Fixed value: the pre-token pattern of byte-level vocabularies, as published with them.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Uncertain(Exception):
    """A character that Unicode versions class differently: the library itself decides."""


class _Costs(dict):
    """Tokens by pre-token: the proven whole tokens at first, later also what has been merged."""

    def __init__(self, tokenizer, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model, self.alphabet = whole, tokenizer.model, byte_alphabet()

    def __missing__(self, token: str) -> int:
        if not token.isascii() and any(unicodedata.category(c) == "Cn" for c in token):
            raise _Uncertain
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        alphabet = self.alphabet
        n = self[sys.intern(token)] = len(self.model.tokenize("".join([alphabet[b] for b in token.encode()])))
        return n


def whole_tokens(tokenizer) -> list[str]:
    """The vocabulary strings that the merge rules leave whole, as ordinary text."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    out = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in back for c in piece) and len(tokenizer.model.tokenize(piece)) == 1:
            try:
                out.append(bytes(back[c] for c in piece).decode())
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token is such a string
    return out


class TokenCounter:
    """``whole``: what :func:`whole_tokens` gave for this vocabulary, if that is known already."""

    def __init__(self, path: str, whole: list[str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.shortcut = config.get("normalizer") is None and config["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(config["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and not any(t[k] for t in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.find = regex.compile(PRE_TOKEN).findall
        added = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.whole = (whole_tokens(self.tokenizer) if whole is None else whole) if self.shortcut else []
        self.costs = _Costs(self.tokenizer, self.whole) if self.shortcut else None

    def plain(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.shortcut:
            return self.plain(text)
        special, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            special = len(parts) - 1
        try:
            return special + sum(sum(map(self.costs.__getitem__, self.find(part))) for part in parts)
        except _Uncertain:
            return self.plain(text)


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    """The driver's own, which proves the table."""
    return TokenCounter(path)


_workers: dict[str, TokenCounter] = {}


def counter_of(path: str, whole: list[str]) -> TokenCounter:
    """A worker's, made once from the table that it is sent."""
    if path not in _workers:
        _workers.clear()
        _workers[path] = TokenCounter(path, whole)
    return _workers[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then n_bytes, n_tokens and over_limit of each row; one pass, no shuffle.

    ``path`` names a vocabulary file that every executor can open (it is part of the installation).
    Which vocabulary strings encode alone is proven once, on the driver, and sent (some 50,000 strings).
    """
    sent = df.sparkSession.sparkContext.broadcast(counter(path).whole)
    chosen = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([chosen.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path, sent.value).count
        for batch in batches:
            texts = batch.column(len(keep))
            _, offsets = raw_bytes(texts)
            n = [count(t) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(offsets[1:] - offsets[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return chosen.mapInArrow(run, schema)
