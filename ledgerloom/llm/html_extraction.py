r"""Main text of web pages by a site style tree (operator 4).

Pages of one host are merged: every element path of the site (tags with their first class)
collects over all its pages how often each *presentation* (the child elements at that path on
a page) and each *content* (the text standing directly in it) occurs.  The importance of
either is its Shannon entropy over the host's pages, as a share of the logarithm of the pages
or of ``STYLES``, whichever is less, so that it doesn't fall as a host grows.  A path is as
important as the more important of the two.

Small hosts are no case of their own: ``importance = ((n - 1) * measured + K * prior) / (n - 1 + K)``
for n pages, where the prior is the importance of the same path on the other hosts (shrunk
towards ``PRIOR`` in the same way).  Copies of a page under one host count as one page.

From each page two things are removed: branches in which neither the element nor any below it
is important, and single texts that stand exactly once at their path on nearly all pages that
have it (a notice among paragraphs that vary), smoothed by the other hosts' share of that text.

What is no text of an article by definition goes without a vote: elements that HTML reserves
for menus, sidebars, footers, forms and scripts, and elements whose class, id or role consists
of names of such parts, adverts, notices or reader comments (``search-term`` doesn't, ``ad-box``
does).  No entropy could tell a comment or an advert that differs on every page from an article.
Names that only hint at a template part (``related``, ``share``) lower the prior, and count text
outside links alone as content; inside ``article`` and ``main`` they mean nothing, and there the
tree needs stronger evidence.

Merging is aggregates with partial sums (no task sees a host's pages together).  What is to be
removed comes as 64-bit digests of (host, path) or (host, path, text); they are broadcast up to
``BROADCAST_DIGESTS`` of them, beyond that each page's own digests are joined with them.

A named part that is inline and stands in a sentence of its block (``a <span class="comment">comment</span>
on``) is text like any other, unless it is named an advert.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by ``\n``; whole texts of any length and elements of any depth are read.  Null
and empty pages, and pages without main text, give an empty string; an empty table gives no rows.
A null url is a host of its own.  Repeated rows get equal results.  Extra columns are left alone,
whatever their names.
"""

from __future__ import annotations

import html as html_references
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far
from .url_filter import host_and_path

#: Digests are broadcast up to this many (about 100 bytes each in a Python worker); beyond, they are joined.
BROADCAST_DIGESTS = 250_000
#: Digests of pages that occur more than once are broadcast up to this many; beyond, the join is shuffled.
BROADCAST_COPIES = 1_000_000
#: Entropies are shares of the logarithm of at most so many equally frequent forms.
STYLES = 8
#: How many pages the prior is worth.
K = 1.0

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea|title)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that are no text up to their end tag; one that closes itself or has no end tag is its start tag alone.
UNREAD = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("noscript", "template", "iframe", "svg", "select", "object")}
NEXT_TEXT = re.compile(r"\s*[^<\s]")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'>/=]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))""")
#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
TEMPLATE = frozenset("head nav aside footer form button dialog menu fieldset".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = frozenset("li dt dd tr td th option".split())
#: Names (in class, id or role) of what an article doesn't hold; names that only hint at it; and what may stand beside either.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo complementary masthead comment comments discussion disqus reply replies newsletter subscribe signup login".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
HINTS = frozenset("header banner promo promotion share sharing social related recommended search widget pagination pager toolbar skip".split())
BESIDE = frozenset("area bar block bottom box container group item items left link links list main panel right section site slot the top unit wrap wrapper".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")

NEUTRAL, HINTED, KEPT, REMOVED = 0, 1, 2, 3
#: Importance before any page is seen, and the least that stays.
PRIOR = {NEUTRAL: 1.0, HINTED: 0.0, KEPT: 1.0}
LEAST_IMPORTANCE = {NEUTRAL: 0.3, HINTED: 0.3, KEPT: 0.1}
PRESENTATION, CONTENT, SINGLE = 0, 1, 2


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def path_digest(path: str) -> int:
    """Digest of a path like ``/body/div.top``."""
    at = 0
    for label in path.split("/")[1:]:
        at = digest(f"{at}/{label}")
    return at


@lru_cache(10_000)
def _named(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role names a part that is no article, and whether it hints at one."""
    mark = hint = False
    for token in value.lower().split():
        words = [w for w in WORDS.findall(token) if not w.isdigit() and w not in BESIDE]
        if words and all(w in MARKS or w in HINTS for w in words):
            mark |= any(w in MARKS for w in words)
            hint = True
    return mark, hint


def _state(tag: str, attributes: str, parent: int) -> tuple[int, str]:
    """What the element is by itself, and its label in the style tree."""
    label, role, mark, hint = tag, "", False, False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        name, value = name.lower(), a or b or c
        if name == "class" and label == tag:
            label = f"{tag}.{value.split()[0] if value.split() else ''}"
        if name in ("class", "id", "role"):
            role = value.lower().strip() if name == "role" else role
            found = _named(value)
            mark, hint = mark or found[0], hint or found[1]
    if parent == REMOVED or tag in TEMPLATE or (tag == "header" and parent != KEPT) or (mark and tag not in MAIN and tag not in ("html", "body")):
        return REMOVED, label
    if parent == KEPT or tag in MAIN or role in ("main", "article"):
        return KEPT, label
    return (HINTED if hint and tag not in ("html", "body") else parent), label


def _is_advert(attributes: str) -> bool:
    return any(w in ADVERTS for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role") for w in WORDS.findall((a or b or c).lower()))


class Element:
    """A block element: its place in the style tree, the labels of its children, and its own texts."""

    __slots__ = ("children", "last", "outer", "path", "state", "tag", "texts", "within")

    def __init__(self, tag: str, path: int, state: int):
        self.tag, self.path, self.state = tag, path, state
        self.children: list[str] = []
        self.texts: list[tuple[str, bool]] = []  # and whether it stands outside links
        self.outer: list[tuple[str, bool]] = []  # the surrounding block's text, while a named inline part is open
        self.within = self.last = 0  # its place in page order, and the end of its branch


def parse(page: str) -> tuple[list[Element], list[tuple[str, int]]]:
    """The page's elements in page order, each before its branch, and its blocks (text, element)."""
    root = Element("", 0, NEUTRAL)
    elements, blocks = [root], []
    stack: list[tuple[str, Element | None]] = [("", root)]  # inline elements have no Element of their own
    open_blocks = [root]
    held: list[tuple[str, bool]] = []
    opened: Counter = Counter()

    def flush() -> None:
        if held:
            text = " ".join(html_references.unescape("".join(t for t, _ in held)).split())
            free = any(outside and not t.isspace() for t, outside in held)
            held.clear()
            if text:
                top = open_blocks[-1]
                top.texts.append((text, free))
                blocks.append((text, top.within))

    def pop() -> None:
        tag, element = stack.pop()
        opened[tag] -= 1
        if element is not None:
            flush_into(element)

    def flush_into(element: Element) -> None:
        flush()
        open_blocks.pop()
        element.last = len(elements)
        held.extend(element.outer)

    at = 0
    endless: set[str] = set()

    def end_of(tag: str, pattern: re.Pattern) -> int | None:
        """Where the next end tag ends; a tag that has none from here on isn't looked for again."""
        found = None if tag in endless else pattern.search(page, at)
        if found is None:
            endless.add(tag)
        return None if found is None else found.end()

    def in_a_sentence(tag: str) -> bool:
        """Whether text of its own block stands before the inline part that begins here, or right behind it."""
        if any(not t.isspace() for t, _ in held):
            return True
        end = end_of(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE))
        return end is not None and NEXT_TEXT.match(page, end) is not None

    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append((page[at : m.start()], not opened["a"]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in UNREAD and not m["close"]:
            closed = m["attributes"].endswith("/")
            at = at if closed else end_of(tag, UNREAD[tag]) or at
            continue
        if m["close"]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            held.append((" ", True))
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and opened["p"]:
                while stack[-1][0] != "p":
                    pop()
                pop()
            elif tag in CLOSES_SAME and stack[-1][0] == tag:
                pop()
            elif tag == "body" and opened["head"]:
                while opened["head"]:
                    pop()
        if tag in VOID:
            continue
        top, around = open_blocks[-1], []
        state, label = _state(tag, m["attributes"], top.state)
        if tag in INLINE and state != top.state and not _is_advert(m["attributes"]) and in_a_sentence(tag):
            state = top.state  # a word of a sentence, whatever it is named
        opened[tag] += 1
        if tag in INLINE:
            if state == top.state:
                stack.append((tag, None))
                continue
            around = held[:]  # a named inline part is a block of its own inside the other
            held.clear()
        top.children.append(label)
        element = Element(tag, digest(f"{top.path}/{label}"), state)
        element.outer, element.within = around, len(elements)
        elements.append(element)
        stack.append((tag, element))
        open_blocks.append(element)
    if at < len(page):
        held.append((page[at:], not opened["a"]))
    while len(stack) > 1:
        pop()
    flush()
    root.last = len(elements)
    return elements, blocks


def host_key(host: str | None, state: int, path: int, text: str | None = None) -> int:
    """What stands for a path of a host, or for one text of it, among the things to be removed."""
    key = xxhash.xxh64_intdigest(f"{'' if host is None else '+' + host}\0{state}\0{path}" + ("" if text is None else f"\0{digest(text)}"))
    return key - (1 << 64) if key >= 1 << 63 else key


def page_keys(host: str | None, page: str) -> set[int]:
    elements, _ = parse(page)
    keys = {host_key(host, e.state, e.path) for e in elements if e.state != REMOVED}
    return keys | {host_key(host, e.state, e.path, t) for e in elements if e.state != REMOVED for t, _ in e.texts}


def main_text(page: str, host: str | None = None, removed=frozenset()) -> str:
    """``removed``: holds keys of unimportant paths and of texts (:func:`host_key`)."""
    elements, blocks = parse(page)
    if not removed:
        return "\n".join(text for text, k in blocks if elements[k].state != REMOVED)
    important = np.array([e.state != REMOVED and host_key(host, e.state, e.path) not in removed for e in elements])
    up_to = np.concatenate([[0], np.cumsum(important)])

    def stays(text: str, k: int) -> bool:
        e = elements[k]
        return e.state != REMOVED and bool(up_to[e.last] > up_to[k]) and host_key(host, e.state, e.path, text) not in removed

    return "\n".join(text for text, k in blocks if stays(text, k))


def _counted(pages: DataFrame) -> DataFrame:
    """host, path, state, kind, value, n: on how many different pages the path has the value."""
    page = F.xxhash64("html")
    copies = stored(pages.groupBy("host", page.alias("page")).agg(F.count("*").alias("copies")).where("copies > 1"), "page-copies")
    small = copies.count() <= BROADCAST_COPIES
    right = (F.broadcast(copies) if small else copies).withColumnRenamed("host", "__other")
    weighed = pages.withColumn("__page", page).join(right, F.col("host").eqNullSafe(F.col("__other")) & (F.col("__page") == F.col("page")), "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for host, page, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                children, texts, single = {}, {}, {}
                for e in parse(page or "")[0]:
                    if e.state != REMOVED:
                        at = (e.path, e.state)
                        children.setdefault(at, []).extend([*e.children, ""])
                        texts.setdefault(at, []).extend(t for t, free in e.texts if free or e.state != HINTED)
                        single.setdefault(at, Counter()).update(t for t, _ in e.texts)
                weight = 1 / copies
                for at, labels in children.items():
                    values = [(PRESENTATION, digest(" ".join(labels)) if any(labels) else 0), (CONTENT, digest("\n".join(texts[at])) if texts[at] else 0)]
                    values += [(SINGLE, digest(text)) for text, n in single[at].items() if n == 1]
                    for value in values:
                        key = (host, *at, *value)
                        seen[key] = seen.get(key, 0.0) + weight
            columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["host", "path", "state", "kind", "value", "n"])

    rows = weighed.mapInArrow(run, "host string, path long, state int, kind int, value long, n double")
    return rows.groupBy("host", "path", "state", "kind", "value").agg(F.round(F.sum("n"), 3).alias("n"))


def _by_state(values: dict[int, float]) -> Column:
    out = F.lit(values[KEPT])
    for state in (NEUTRAL, HINTED):
        out = F.when(F.col("state") == state, values[state]).otherwise(out)
    return out


def _tree(counted: DataFrame) -> DataFrame:
    """host, path, state, pages, presentation, content, measured, prior, importance."""
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    share = F.when(total > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy / F.log2(F.least(total, F.lit(float(STYLES)))))))
    each = counted.where(F.col("kind") != SINGLE).groupBy("host", "path", "state", "kind").agg(total.alias("pages"), F.coalesce(share, F.lit(1.0)).alias("share"))
    own = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("share"))), F.lit(0.0))
    paths = each.groupBy("host", "path", "state").agg(F.max("pages").alias("pages"), own(PRESENTATION).alias("presentation"), own(CONTENT).alias("content"))
    # a link list of varying length is no article, so a hinted part is judged by its text alone
    paths = paths.withColumn("measured", F.when(F.col("state") == HINTED, F.col("content")).otherwise(F.greatest("presentation", "content")))
    seen = F.greatest(F.col("pages") - 1, F.lit(0.0))
    everywhere = paths.groupBy(F.col("path").alias("__path"), F.col("state").alias("__state")).agg(F.sum(seen).alias("__seen"), F.sum(seen * F.col("measured")).alias("__found"))
    joined = paths.join(everywhere, (F.col("path") == F.col("__path")) & (F.col("state") == F.col("__state")))
    elsewhere, found = F.col("__seen") - seen, F.col("__found") - seen * F.col("measured")
    prior = F.greatest(F.lit(0.0), (found + K * _by_state(PRIOR)) / (elsewhere + K))
    return joined.withColumn("prior", prior).withColumn("importance", (seen * F.col("measured") + K * F.col("prior")) / (seen + K)).drop("__path", "__state", "__seen", "__found")


def style_tree(pages: DataFrame) -> DataFrame:
    """One row for each (host, path, state); ``path`` as :func:`path_digest` gives it."""
    return _tree(_counted(pages))


def _shared_texts(counted: DataFrame, tree: DataFrame, least: Column) -> DataFrame:
    """host, path, state, value of texts that stand once on nearly all pages that have the path."""
    singles = counted.where(F.col("kind") == SINGLE).select("host", "path", "state", "value", "n")
    over = singles.groupBy("path", "state", "value").agg(F.sum("n").alias("__n"), F.count("*").alias("__hosts")).where("__n > 1")
    pages = tree.groupBy("path", "state").agg(F.sum("pages").alias("__pages"))
    over = over.join(pages, ["path", "state"])
    # the largest share is a lone page's: (1 + K * q) / (1 + K), so no text under half of that can pass
    candidates = singles.join(over, ["path", "state", "value"])
    known = candidates.join(tree.select(F.col("host").alias("__other"), F.col("path").alias("__path"), F.col("state").alias("__state"), "pages"), F.col("host").eqNullSafe(F.col("__other")) & (F.col("path") == F.col("__path")) & (F.col("state") == F.col("__state")))
    q = (F.col("__n") - F.col("n")) / (F.col("__pages") - F.col("pages") + K)
    return known.where((F.col("n") + K * F.greatest(q, F.lit(0.0))) / (F.col("pages") + K) >= 1 - least).select("host", "path", "state", "value")


def removals(pages: DataFrame, least_importance: dict[int, float] = LEAST_IMPORTANCE) -> DataFrame:
    """key: distinct :func:`host_key` digests of what is to be removed from the pages (host, html)."""
    counted = stored(_counted(pages), "path-values", "zstd")
    tree = stored(_tree(counted), "style-tree", "zstd")
    least = _by_state(least_importance)
    low = tree.where(F.col("importance") < least).select("host", "path", "state", F.lit(None).cast("long").alias("value"))
    found = low.unionByName(_shared_texts(counted, tree, least))
    name = F.concat(F.when(F.col("host").isNull(), "").otherwise(F.concat(F.lit("+"), "host")), F.lit("\0"), F.col("state").cast("string"), F.lit("\0"), F.col("path").cast("string"), F.coalesce(F.concat(F.lit("\0"), F.col("value").cast("string")), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh64_intdigest(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return found.select(name).mapInArrow(run, "key long").distinct()


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), least_importance: dict[int, float] = LEAST_IMPORTANCE, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    host = host_and_path(F.col("url"))[0]
    named = pages.select(*(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)), host.alias("host"), "html")
    before = stored_so_far()
    gone = stored(removals(named.select("host", "html"), least_importance), "removed-keys")
    discard(pages.sparkSession, before, keep=[gone])
    n = len(keep)
    kept = named.columns[:n]
    if gone.count() <= broadcast_digests:
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(gone.toArrow().column("key").to_pylist()))
        joined = named.select(*kept, "host", "html", F.lit(None).cast("array<long>").alias("keys"))
    else:
        sent = pages.sparkSession.sparkContext.broadcast(None)
        joined = _with_own_keys(named, gone).select(*kept, "host", "html", "keys")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in joined.select(*kept).dtypes), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, htmls, keys = (batch.column(n + k).to_pylist() for k in range(3))
            texts = [main_text(page, host, sent.value if sent.value is not None else frozenset(own or ())) if page else "" for host, page, own in zip(hosts, htmls, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*kept, "text"])

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(a).alias(c) for a, c in zip(kept, keep, strict=True)), "text", F.length("text").cast("long").alias("n_chars"))


def _with_own_keys(named: DataFrame, gone: DataFrame) -> DataFrame:
    """The pages with those of their own keys that are to be removed; no host's whole list is ever in one place."""
    named = named.withColumn("__page", F.xxhash64("host", "html")).withColumn("__page2", F.xxhash64("html", F.lit("second"), "host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, hosts, htmls = (c.to_pylist() for c in batch.columns)
            rows = [(x, y, key) for x, y, host, page in zip(a, b, hosts, htmls, strict=True) for key in (page_keys(host, page) if page else ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["__page", "__page2", "key"])

    own = named.select("__page", "__page2", "host", "html").dropDuplicates(["__page", "__page2"]).mapInArrow(run, "__page long, __page2 long, key long")
    own = own.join(gone, "key", "left_semi").groupBy("__page", "__page2").agg(F.collect_list("key").alias("keys"))
    return named.join(own, ["__page", "__page2"], "left")
