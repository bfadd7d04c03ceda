r"""Toxicity by noisy-channel deobfuscation (operator 6).

1. A character trigram model is counted over all texts of the corpus (boundaries, a-z,
   Latin-1 letters, others): one partial table a task, summed by trigram, so the gathered
   table has at most 64**3 rows whatever the corpus is.
2. :class:`Restorer` finds the stretches of a text that may be disguised: letters mixed with
   or followed by leetspeak characters, letters repeated three times or more, and single
   letters set apart by any white space or marks.  Each stretch becomes a character lattice (substitute, drop or keep,
   each with a channel cost) and Viterbi picks the reading that is likeliest under the model.
   The rest of the text, being the only reading of itself, stays as it is.
3. The restored text is scored by a logistic model over word features (words and their first
   4 and 5 letters, so that families of words share weight), fitted on a bounded sample of
   labelled rows: at most ``SAMPLE`` of each class, those with the smallest hash of doc_id.

Null and empty texts have no words and get the model's base score; without labelled rows of
both classes every score is 0.0.  A null doc_id isn't held out.  Repeated rows get equal scores.
Whole texts of any length are read.  An empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far
from .words import raw_bytes, slices

SAMPLE = 4000
THRESHOLD = 0.3
SYMBOLS = 64
#: Which letters a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
#: A masking star may stand for any of these.
ANY = "abcdefghijklmnopqrstuvwxyz"
SUBSTITUTE, STAR, SHORTEN, JOIN, APART, KEEP = 1.0, 3.0, 0.5, 0.0, 1.5, 2.5

_LEET = re.escape("".join(LEET) + "*")
_EDGES = "%&#$*!|.,;:?+"
_MARKS = r".\-_*·/"
_APART = rf"\s{_MARKS},~+"
#: Leetspeak at the end of a word; the others are punctuation there.
_TAIL = "0-9@$€£"
#: Each pattern reads a text in linear time: what it repeats never overlaps.
DISGUISES = [
    # single letters set apart by white space or marks
    re.compile(rf"(?<!\S)[^\W_](?:[{_APART}]++[^\W_]){{2,}}(?![^\W_])"),
    # pieces of up to three letters set apart by marks
    re.compile(rf"(?<!\S)[^\W\d_]{{1,3}}(?:[{_MARKS}][^\W\d_]{{1,3}}){{2,}}(?![^\W_])"),
    # letters mixed with, or followed by, characters that stand for letters
    re.compile(rf"(?<![\w{_LEET}])[\w{_LEET}]*(?:[^\W\d_][{_LEET}]+[^\W\d_]|[0-9@$|+€£][^\W\d_]|[^\W\d_][{_TAIL}]++(?![\w{_LEET}]))[\w{_LEET}]*"),
]
REPEATED, WORD = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE), re.compile(r"[^\W\d_]+")
SPACED = re.compile(rf"[^\W_]{{1,3}}(?:[{_APART}]++[^\W_]{{1,3}}){{2,}}")
IS_APART = re.compile(rf"[{_APART}]")


# -- the character model ----------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    out = np.full(0x250, 61, dtype=np.int32)
    for code in range(0x250):
        c = chr(code)
        if not c.isalpha():
            out[code] = 0
        elif "a" <= c <= "z":
            out[code] = 1 + code - 97
        elif 0xDF <= code <= 0xFF:
            out[code] = 27 + code - 0xDF
    return out


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbol of each character of the lower-cased text; 0 is a boundary, 61 a rare letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 0x250, _SYMBOL[np.minimum(codes, 0x24F)], 61)


def trigram_counts(texts: list[str]) -> np.ndarray:
    s = np.concatenate([[0], symbols(" ".join(texts)), [0]])
    s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]  # boundaries in a row are one
    if len(s) < 3:
        return np.zeros(SYMBOLS**3, dtype=np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log probabilities [a, b, c] of c after a, b, from all texts; float32 of 64**3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 500):
                total += trigram_counts([t for t in texts.slice(at, 500).to_pylist() if t])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["trigram", "n"])

    counted = docs.select(text).mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**3)
    n[counted.column("trigram").to_numpy()] = counted.column("n").to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 0.5
    one /= one.sum()
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    three = (n + 5 * two[None]) / (n.sum(2)[:, :, None] + 5)
    return -np.log(three).astype(np.float32)


# -- restoring --------------------------------------------------------------------------


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of the stretch, what it may stand for and the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    spaced = SPACED.fullmatch(stretch) is not None
    at = 0
    while at < len(stretch):
        c = stretch[at].lower()
        run = at
        while run < len(stretch) and stretch[run].lower() == c:
            run += 1
        if spaced and IS_APART.match(c):
            out.append([("", JOIN), (" ", APART)])
            run = at + 1 if run == at + 1 else run
        elif c.isalpha() and run - at >= 3:
            out.append([(c, SHORTEN), (c + c, SHORTEN), (c * (run - at), 0.0)])
        elif c in LEET:
            options = [(x * k, SUBSTITUTE) for x in LEET[c] for k in {1, min(run - at, 2)}]
            out.append([*options, (stretch[at:run], KEEP)])
        elif c == "*":
            out.append([*((x, STAR) for x in ANY), ("*", 0.0)] if run - at == 1 else [("", JOIN), (stretch[at:run], 0.0)])
        else:
            out.extend([[(x, 0.0)] for x in stretch[at:run].lower()])
        at = run
    return out


def viterbi(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading; ties go to the first option."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    cost_of = lambda c: int(_SYMBOL[ord(c)]) if len(c) == 1 and ord(c) < 0x250 else (61 if c.isalpha() else 0)
    for options in places:
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in best.items():
            for piece, channel in options:
                x, y, total = a, b, cost + channel
                for c in piece:
                    s = cost_of(c)
                    total += float(model[x, y, s])
                    x, y = y, s
                if (x, y) not in following or total < following[x, y][0]:
                    following[x, y] = (total, (path, piece))
        best = following
    _, path = min(((cost + float(model[a, b, 0]), path) for (a, b), (cost, path) in best.items()), key=lambda p: p[0])
    pieces = []
    while path:
        path, piece = path
        pieces.append(piece)
    return "".join(reversed(pieces))


ALL_HINTS = 0b1111


def _characters(pattern: str) -> np.ndarray:
    """Whether the pattern takes the character of a code; the last entry is for all codes beyond."""
    taken = np.zeros(0x10001, dtype=bool)
    taken[[ord(c) for c in re.findall(pattern, "".join(map(chr, range(0x10000))))]] = True
    taken[-1] = True
    return taken


_IS_SINGLE, _IS_LETTER, _IS_APART, _IS_MARK, _IS_LEET, _IS_TAIL = (_characters(p) for p in (r"[^\W_]", r"[^\W\d_]", rf"[{_APART}]", rf"[{_MARKS}]", rf"[{_LEET}]", rf"[{_TAIL}]"))
for _table in (_IS_APART, _IS_MARK, _IS_LEET, _IS_TAIL):
    _table[-1] = False
_FOLDED = np.array([ord(f) if len(f := chr(c).casefold()) == 1 else ord(chr(c).lower()[0]) for c in range(0x10001)], dtype=np.uint32)


def hints(texts: pa.Array) -> np.ndarray:
    """For each text, which disguises it may hold (bit k: DISGUISES[k], bit 3: repetition); never too few."""
    data, offsets = raw_bytes(texts)
    code = np.minimum(np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0x10000)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # each text's first character
    n = len(code)
    letter, leet, mark, tail, single, apart = (np.append(t[code], np.zeros(4, bool)) for t in (_IS_LETTER, _IS_LEET, _IS_MARK, _IS_TAIL, _IS_SINGLE, _IS_APART))
    fold = np.append(_FOLDED[code], np.zeros(4, np.uint32))
    ahead = lambda x, k: x[k : k + n]
    runs = np.flatnonzero(~(apart[:n] & np.append(False, apart[: max(n - 1, 0)])[:n]))  # separators in a row are one
    one, gap = np.append(single[runs], np.zeros(4, bool)), np.append(apart[runs], np.zeros(4, bool))
    m = len(runs)
    spaced = np.zeros(n, bool)
    spaced[runs[one[:m] & gap[1 : m + 1] & one[2 : m + 2] & gap[3 : m + 3] & one[4 : m + 4]]] = True
    found = [
        spaced,
        ahead(letter, 0) & ahead(mark, 1) & ahead(letter, 2),
        (ahead(leet, 0) & ahead(letter, 1)) | (ahead(letter, 0) & ahead(tail, 1)),
        ahead(letter, 0) & (ahead(fold, 0) == ahead(fold, 1)) & (ahead(fold, 1) == ahead(fold, 2)),
    ]
    bits = np.zeros(len(offsets) - 1, dtype=np.int64)
    for k, at in enumerate(found):
        total = np.concatenate([[0], np.cumsum(at)])
        bits |= (total[first[1:]] > total[first[:-1]]).astype(np.int64) << k
    return bits


class Restorer:
    MEMO = 50_000

    def __init__(self, model: np.ndarray):
        self.model, self.memo = model, {}

    def reading(self, text: str) -> str:
        if text not in self.memo:
            if len(self.memo) > self.MEMO:
                self.memo.clear()
            core = text.strip(_EDGES)
            head = text.index(core) if core else 0
            if head and text[head - 1] in "$@":
                core, head = text[head - 1] + core, head - 1
            while core and text[head + len(core) : head + len(core) + 1] == "$":
                core += "$"
            self.memo[text] = text[:head] + viterbi(lattice(core), self.model) + text[head + len(core) :] if core else text
        return self.memo[text]

    def repeated(self, text: str) -> str:
        """Words that hold a letter three times in a row, restored."""
        out, at = [], 0
        for found in REPEATED.finditer(text):
            start, end = found.span()
            if start < at:
                continue
            while start > at and text[start - 1].isalpha():
                start -= 1
            end = WORD.match(text, start).end()
            out += [text[at:start], self.reading(text[start:end])]
            at = end
        return "".join([*out, text[at:]])

    def restore(self, text: str, hints: int = ALL_HINTS) -> str:
        for k, disguise in enumerate(DISGUISES):
            if hints >> k & 1:
                before, text = text, disguise.sub(lambda m: self.reading(m[0]), text)
                if text != before:  # what was restored may hold others
                    hints = ALL_HINTS
        return self.repeated(text) if hints >> 3 & 1 else text

    def restore_all(self, texts: pa.Array) -> list[str]:
        """Whole texts restored; null is empty."""
        return [self.restore(t or "", h) if h else t or "" for t, h in zip(texts.to_pylist(), hints(texts).tolist(), strict=True)]


# -- scoring ----------------------------------------------------------------------------


def features(text: str) -> tuple[set[str], set[str], set[str]]:
    words = set(WORD.findall(text.lower()))
    return words, {w[:4] for w in words if len(w) > 4}, {w[:5] for w in words if len(w) > 5}


class Scorer:
    """Logistic model over word features: bias and a weight by (kind, feature)."""

    def __init__(self, bias: float, weights: tuple[dict[str, float], ...]):
        self.bias, self.weights = bias, weights
        self.known = tuple(map(frozenset, weights))

    def score(self, text: str) -> float:
        total = self.bias
        for found, known, weights in zip(features(text), self.known, self.weights, strict=True):
            total += math.fsum(weights[x] for x in found & known)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def fit(names: list[tuple[int, str]], found: list[tuple[tuple[int, ...], int, int]], share: float, rounds: int = 400) -> Scorer:
    """``found``: numbers of a text's features in ``names``, its label, and how many texts are like that.

    ``share``: of label 1 among all labelled rows, as the sample is taken by class.  Weights are
    not negative, so what else a long text says neither hides a toxic word nor adds up to one.
    """
    found = sorted(found)
    y = np.array([label for _, label, _ in found], dtype=float)
    if not len(y) or y.min() == y.max():
        return Scorer(-40.0, ({}, {}, {}))
    times = np.array([n for *_, n in found], dtype=float)
    rows, columns = np.repeat(np.arange(len(found)), [len(of) for of, *_ in found]), np.array([k for of, *_ in found for k in of], dtype=np.int64)
    n1, n0 = times @ y, times @ (1 - y)
    pull = times * np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), 0.0
    squares, b_square = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(rows, w[columns], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * pull
        slope = np.bincount(columns, error[rows], len(names)) + 1e-4 * w
        squares += slope**2
        b_square += error.sum() ** 2
        w = np.maximum(0, w - 0.3 * slope / np.sqrt(squares))
        b -= 0.3 * error.sum() / math.sqrt(b_square)
    # the fit weighs both classes alike; half the way back to the base rate keeps rare words detectable
    b += 0.5 * math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    kinds: tuple[dict[str, float], ...] = ({}, {}, {})
    for (kind, x), weight in zip(names, w.tolist(), strict=True):
        if weight > 1e-4:
            kinds[kind][x] = weight
    return Scorer(b, kinds)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sure_features(rows: DataFrame, n1: int, n0: int, sure: float = 2.0) -> DataFrame:
    """feature: of those whose texts' log odds ratio stays above 0.5 at ``sure`` standard errors below the estimate."""
    counted = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg((F.sum("toxic") + 0.5).alias("a"), (F.sum(1 - F.col("toxic")) + 0.5).alias("b"))
    c, d = F.lit(n1 + 1.0) - F.col("a"), F.lit(n0 + 1.0) - F.col("b")
    odds = F.log(F.col("a") * d / (F.col("b") * c)) - sure * F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / c + 1 / d)
    return counted.where((F.col("a") > 3) & (odds > 0.5)).select("feature")


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> Scorer:
    """Fits on at most ``sample`` labelled ids of each class that aren't held out; equal restored texts of one class count once.

    Features are counted by Spark; only the names of the sure ones, and how many texts have which
    of them, come to the driver, never a text.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                restored = restorer.restore_all(part.column(0))
                found = [[f"{kind}{x}" for kind, of in enumerate(features(t)) for x in of] for t in restored]
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in restored]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["digest", "toxic", "features"])

    before = stored_so_far()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(run, "digest string, toxic int, features array<string>")
    rows = stored(rows.dropDuplicates(["digest", "toxic"]).drop("digest"), "labelled-features", "zstd")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return fit([], [], 0.0)
    names = sorted((int(x[0]), x[1:]) for x in sure_features(rows, n[1], n[0]).toArrow().column("feature").to_pylist())
    numbers = docs.sparkSession.sparkContext.broadcast({f"{kind}{x}": k for k, (kind, x) in enumerate(names)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            own = [sorted(known[x] for x in of if x in known) for of in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    alike = rows.select("toxic", "features").mapInArrow(number, "toxic int, own array<int>").groupBy("own", "toxic").agg(F.count("*").alias("n")).toArrow()
    discard(docs.sparkSession, before, keep=[])
    return fit(names, [(tuple(r["own"]), r["toxic"], r["n"]) for r in alike.to_pylist()], counts[1] / sum(counts.values()))


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, held_out, score and predicted of every row; scoring is one pass without a shuffle."""
    model = character_model(docs, text)
    scorer = train(docs, labels, model)
    sent = docs.sparkSession.sparkContext.broadcast((model, scorer))
    chosen = docs.select(*keep) if text in keep else docs.select(*keep, text)
    place = chosen.columns.index(text)
    names = [*keep, "score"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in chosen.select(*keep).dtypes), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = sent.value
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, text):
                scores = [scorer.score(restored) for restored in restorer.restore_all(part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], names=names)

    scored = chosen.mapInArrow(run, schema)
    return scored.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
