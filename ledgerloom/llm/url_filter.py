"""URL filter on a sorted digest array (operator 7).

A rule list is stored as one file: the sorted 64-bit xxhash keys of its ``host + path``
strings, then the strings themselves with their verdicts.  Tasks memory-map the keys and
probe all candidates of a batch with one vectorised binary search per shape; a key that is
found counts only if the stored full string is equal, so collisions never decide.

A rule fits its host and all subdomains, if the url's path starts with the rule's path.
Candidates of a url are therefore its host suffixes joined with prefixes of its path, and
the file's header names the (labels, path length) shapes that occur, longest first, so a
url costs one probe per shape and not one per rule.  The longest rule wins; of rules of
equal length, the one with the longer host.

Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; path: from there to ``?``, ``#`` or the end.  A null url, or one without
``://``, has an empty host and path and fits no rule.  A url that fits none gets the
method's verdict: it isn't in the array, so it is allowed.  Urls of any length are read whole;
repeated rows are judged alike; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

MAGIC = b"URLDIG01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Native expressions for host and path."""
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    after = F.when(known, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)).otherwise("")
    after = F.substring_index(after, "?", 1)
    host = F.substring_index(after, "/", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.substring(after, F.length(host) + 1, F.length(after))


def write_digest_array(rules: list[tuple[str, str, str]], path: str) -> int:
    """Writes (verdict, host, path) rules to a path or file URI; returns the bytes written.  Later rules replace equal earlier ones."""
    strings = {h + p: (v, h, p) for v, h, p in rules}
    rows = sorted((xxhash.xxh64_intdigest(s), s, v, h) for s, (v, h, p) in strings.items())
    shapes = sorted({(len(h.split(".")), len(p), len(h)) for v, h, p in strings.values()}, key=lambda x: (-(x[1] + x[2]), -x[2]))
    texts = [s.encode() for _, s, _, _ in rows]
    ends = np.cumsum([0, *map(len, texts)]).astype("<u8")
    hosts = np.array([len(h) for *_, h in rows], "<u4")
    blocks = np.array([v == "block" for _, _, v, _ in rows], "u1")
    header = MAGIC + struct.pack("<QI", len(rows), len(shapes)) + np.array(shapes, "<u4").tobytes()
    header += b"\0" * (-len(header) % 8)
    data = header + np.array([k for k, *_ in rows], "<u8").tobytes() + ends.tobytes() + hosts.tobytes() + blocks.tobytes() + b"".join(texts)
    files, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    files.create_dir(os.path.dirname(place), recursive=True)
    with files.open_output_stream(place) as f:
        f.write(data)
    return len(data)


class DigestArray:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.read(20)
            if head[:8] != MAGIC:
                raise ValueError(f"{path} is no digest array")
            n, shapes = struct.unpack("<QI", head[8:])
            self.shapes = np.frombuffer(f.read(12 * shapes), "<u4").reshape(shapes, 3).tolist()
        at = 20 + 12 * shapes
        at += -at % 8

        def piece(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(count,)) if count else np.zeros(0, kind)
            at += out.nbytes
            return out

        self.keys, self.ends, self.hosts, self.blocks = piece("<u8", n), piece("<u8", n + 1), piece("<u4", n), piece("u1", n)
        self.texts = piece("u1", int(self.ends[-1]) if n else 0)

    def probe(self, candidates: list[str], host_sizes: list[int]) -> np.ndarray:
        """The row of each candidate rule, or -1."""
        out = np.full(len(candidates), -1)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys, "left")
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)):
            row, wanted = int(at[k]), candidates[k].encode()
            while row < len(self.keys) and self.keys[row] == keys[k]:  # equal keys stand together
                if self.texts[int(self.ends[row]) : int(self.ends[row + 1])].tobytes() == wanted and self.hosts[row] == host_sizes[k]:
                    out[k] = row
                    break
                row += 1
        return out


@lru_cache(4)
def digest_array(path: str) -> DigestArray:
    return DigestArray(path)


def stored_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Where the rules now are, as a file of the shared folder."""
    path = f"{new_path(spark, 'rules')}.digests"
    write_digest_array(rules, path)
    return path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | str, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule (null if none fits) and verdict of every row; one pass, no shuffle.

    ``rules``: (verdict, host, path) tuples, or the address of a file that :func:`write_digest_array` wrote.
    """
    spark = pages.sparkSession
    place = rules if isinstance(rules, str) else stored_rules(spark, rules)
    name = os.path.basename(place)
    if place not in spark.sparkContext.listFiles:  # a session takes each file once
        spark.sparkContext.addFile(place)

    @F.pandas_udf("rule string, verdict string")
    def rule_of(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        table = digest_array(SparkFiles.get(name))
        hosts, paths = host.tolist(), path.tolist()
        open_rows = range(len(hosts))
        rule: list[str | None] = [None] * len(hosts)
        verdict = ["allow"] * len(hosts)
        for _, path_size, host_size in table.shapes:
            rows, candidates = [], []
            for k in open_rows:
                h, p = hosts[k], paths[k]
                if len(p) >= path_size and len(h) >= host_size and (len(h) == host_size or h[-host_size - 1] == ".") and h:
                    rows.append(k)
                    candidates.append(h[len(h) - host_size :] + p[:path_size])
            for k, text, row in zip(rows, candidates, table.probe(candidates, [host_size] * len(rows)), strict=True):
                if row >= 0:
                    rule[k], verdict[k] = text, "block" if table.blocks[row] else "allow"
            open_rows = [k for k in open_rows if rule[k] is None]
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    host, path = host_and_path(F.col(url))
    kept = [f"__keep{i}" for i in range(len(keep))]
    split = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), host.alias("host"), path.alias("path"))
    found = split.withColumn("found", rule_of("host", "path"))
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "host", "path", "found.rule", "found.verdict")
