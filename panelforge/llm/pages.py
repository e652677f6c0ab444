"""Main text of web pages, without the templates of their sites.

Every page is read as a tree of its block elements. Element subtrees are hashed and counted per
host; a subtree that recurs on many pages of a host whose other text differs is template and is
deleted. Copies of an article recur with the same text around them and stay. Elements that say
themselves what they are (nav, footer, class="ad", role="search", ...) go by that, since a host
with few pages has no counts to show it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import Scratch, as_text, materialize

#: Attributes up to the end of a tag: a quote counts only where a value begins, or where no other follows it.
_ATTRS = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+|=)*+"""
_TAG = re.compile(rf"<!--(?:.*?)(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*+)({_ATTRS})>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z", re.S)
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that start a block of text of their own.
_BLOCK = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address details summary hr nav header footer aside form fieldset dialog menu template center search hgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GONE = frozenset("head nav footer aside form fieldset dialog menu template script style textarea title noscript iframe noembed noframes button select option svg canvas object audio video search map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Whole classes and ids that name parts other than the article.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside rail ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply share sharing social related recommended pagination pager widget widgets toolbar skip copyright legal disclaimer".split()
)
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: First parts of names that say what an element lacks or what lies beside it.
_DENIES = frozenset("has no not with without hide hidden show js is wp".split())
#: Names that a section of an article may have as its subject.
_SUBJECTS = frozenset("legal related social notice notices disclaimer copyright alert banner cookie cookies consent gdpr signup login toolbar widget widgets".split())
_CLOSES_P = _BLOCK - {"template"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


_SURE, _NAMED, _LOOSE = 3, 2, 1


def _named(value: str, names: frozenset[str]) -> str | None:
    """The name that a class or id is, or ends with after a hyphen or underline."""
    for token in value.split():
        parts = re.split("[-_]+", token)
        if len(parts) > 1 and parts[0] in _DENIES:
            continue
        for found in (token, parts[-1]):
            if found in names:
                return found
    return None


def _says_other(tag: str, attrs: str) -> int:
    """Whether an element says that it holds no article text: surely, by a name, or by a name that a section of an article may have, too."""
    if tag in _GONE:
        return _NAMED if tag in ("form", "fieldset") else _SURE
    if not attrs or tag in ("html", "body", "main"):
        return 0
    names = _COMMENTS if tag == "article" else _NAMES
    said = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if found := _named(value, names):
                said = max(said, _LOOSE if tag == "section" and found in _SUBJECTS else _NAMED)
        elif tag == "article":
            continue
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return _SURE
        elif name == "role" and value in _ROLES:
            said = _NAMED
    return said


class _Element:
    __slots__ = ("article", "articles", "free", "gone", "head", "inside", "parent", "parts", "said", "tag")

    def __init__(self, tag: str, said: int, parent: _Element | None):
        self.tag, self.said, self.parent, self.parts = tag, said, parent, []
        self.gone = self.article = self.head = self.inside = False
        self.articles = self.free = 0


def _settle(nodes: list[_Element]) -> None:
    """Which elements are gone; nodes in the order of the page, the root first.

    A name never deletes an element that holds main or a headline, nor one with an article
    unless the page has articles outside of named elements: comments and related items may be
    articles, too.
    """
    for p in reversed(nodes[1:]):
        if p.said == _SURE:
            continue
        e, own = p.parent, p.tag in ("article", "main") and not p.said
        e.articles += p.articles + own
        e.free += (p.free + own) * (p.said not in (_NAMED, _LOOSE))
        # a headline within an article counts with the article
        e.head |= p.tag in ("main", "h1") or p.head and p.tag != "article"
    free = nodes[0].free
    for p in nodes[1:]:
        e = p.parent
        # the header of an article holds its headline; that of a page doesn't
        said = (0 if e.inside else _SURE) if p.tag == "header" else p.said
        if said == _LOOSE:
            said = 0 if e.inside else _NAMED
        p.gone = e.gone or said == _SURE or said == _NAMED and not (p.head or p.tag == "h1" or p.articles and not free)
        p.article = p.tag in ("article", "main") and not p.gone
        p.inside = e.inside or p.article


def read_tree(html: str) -> list[_Element]:
    """The block elements in the order of the page, the root first; inline elements leave only their text.

    Depth has no limit: nothing here recurses. An element that is never closed ends with the page.
    """
    root = _Element("", 0, None)
    nodes, stack = [root], [root]
    depth: dict[str, int] = {}
    at, raw_until = 0, 0
    for m in _TAG.finditer(html):
        if m.start() < raw_until:
            continue
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        opened, closed = m[1], m[3]
        if opened:
            tag = opened.lower()
            if tag in _RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
                raw_until = at = end.end() if end else len(html)
                continue
            if tag in _VOID and tag not in _BLOCK:
                if tag == "br":
                    stack[-1].parts.append(" ")
                continue
            if tag not in _BLOCK and tag not in _GONE and not _says_other(tag, m[2]):
                continue
            if tag in _CLOSES_P and stack[-1].tag == "p":
                depth[stack.pop().tag] -= 1
            if tag in _SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _FENCE[tag]:
                        break
                    if stack[k].tag in _SAME[tag]:
                        for gone in stack[k:]:
                            depth[gone.tag] -= 1
                        del stack[k:]
                        break
            e = _Element(tag, 0 if tag == "header" else _says_other(tag, m[2]), stack[-1])
            nodes.append(e)
            stack[-1].parts.append(e)
            if tag not in _VOID and not m[2].rstrip().endswith("/") or tag in _BLOCK and tag not in _VOID:
                stack.append(e)
                depth[tag] = depth.get(tag, 0) + 1
        elif closed:
            tag = closed.lower()
            if not depth.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    for gone in stack[k:]:
                        depth[gone.tag] -= 1
                    del stack[k:]
                    break
    if at < len(html):
        stack[-1].parts.append(html[at:])
    _settle(nodes)
    return nodes


def clean(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return _SPACE.sub(" ", unescape(text)).strip()


def _subtree_hashes(nodes: list[_Element]) -> dict[int, int]:
    """A signed 64-bit hash of each element's tags and text, by id(): from the leaves up, each text once."""
    out: dict[int, int] = {}
    for e in reversed(nodes):
        h = xxhash.xxh64(e.tag)
        for p in e.parts:
            h.update(clean(p).encode("utf-8", "surrogatepass") + b"\0" if isinstance(p, str) else out[id(p)].to_bytes(8, "little", signed=True))
        out[id(e)] = h.intdigest() - (1 << 63)
    return out


@dataclass
class Page:
    """A page's blocks of text outside the parts that say they aren't the article.

    `body` tells whether a block is text of an article other than a heading. `subtrees` are
    (hash, first block, block after the last, prose) of the elements that are counted: all but those of
    whole pages and articles, and of headings within articles. The last number tells whether it
    is prose of an article.
    """

    texts: list[str]
    body: list[bool]
    subtrees: list[tuple[int, int, int, bool]]

    def contexts(self) -> list[int]:
        """Of each subtree a hash of the longest block outside of it: 0 where it is all text of the page."""
        order = sorted(range(len(self.texts)), key=lambda k: (-len(self.texts[k]), self.texts[k]))
        named: dict[int, int] = {}
        out = []
        for _, a, z, _ in self.subtrees:
            rest = next((k for k in order if not a <= k < z), None)
            if rest is not None and rest not in named:
                named[rest] = xxhash.xxh64_intdigest(self.texts[rest].encode("utf-8", "surrogatepass")) - (1 << 63)
            out.append(0 if rest is None else named[rest])
        return out


def read_page(html: str | None) -> Page:
    """Parse one whole page; null or empty html has no blocks.

    Where main holds text other than headings, only main counts; else, where the page's first
    headline of the highest level stands in an article, or there is none, only articles with
    text do. A page whose main is
    empty or holds a headline alone, or whose articles are mere teasers, is taken whole.
    """
    page = Page([], [], [])
    if not html:
        return page
    nodes = read_tree(html)
    hashes = _subtree_hashes(nodes)
    texts: list[tuple[str, bool, bool]] = []
    subtrees: list[tuple[int, int, int, bool]] = []
    in_main: list[bool] = []
    best: tuple[str, bool] | None = None  # the headline's tag, and whether it is an article's

    def close(run: list[str], e: _Element, heading: bool) -> None:
        text = clean("".join(run))
        if text:
            texts.append((text, e.inside, e.inside and not heading))
            in_main.append(mains > 0)
        run.clear()

    mains = 0
    stack: list[tuple] = [(nodes[0], iter(nodes[0].parts), [], False, 0)]
    while stack:
        e, parts, run, heading, first = stack[-1]
        for p in parts:
            if isinstance(p, str):
                run.append(p)
            elif not p.gone:
                close(run, e, heading)
                mains += p.tag == "main"
                if p.tag in _HEADINGS and (best is None or p.tag < best[0]):
                    best = (p.tag, p.inside)
                stack.append((p, iter(p.parts), [], heading or p.tag in _HEADINGS, len(texts)))
                break
            elif p.tag in _BLOCK:
                close(run, e, heading)
        else:
            close(run, e, heading)
            stack.pop()
            mains -= e.tag == "main"
            if e.tag not in ("", "html", "body") and not e.article and not (e.inside and (heading or e.head)) and len(texts) > first:
                subtrees.append((hashes[id(e)], first, len(texts), e.inside))
    by_main = any(m and b for m, (_, _, b) in zip(in_main, texts, strict=True))
    articles = any(b for _, _, b in texts) and (best is None or best[1])
    counts = [m if by_main else inside or not articles for m, (_, inside, _) in zip(in_main, texts, strict=True)]
    # numbers of the blocks that count
    number = np.concatenate(([0], np.cumsum(counts))).astype(int).tolist()
    page.texts = [t for (t, _, _), c in zip(texts, counts, strict=True) if c]
    page.body = [b for (_, _, b), c in zip(texts, counts, strict=True) if c]
    page.subtrees = [(h, number[a], number[z], inside) for h, a, z, inside in subtrees if number[z] > number[a]]
    return page


def blocks(html: str | None) -> list[tuple[str, list[int], bool]]:
    """Each block of a page: its text, the hashes of the counted subtrees around it, and whether it is text of an article other than a heading."""
    page = read_page(html)
    return [(t, [h for h, a, z, _ in page.subtrees if a <= k < z], b) for k, (t, b) in enumerate(zip(page.texts, page.body, strict=True))]


def extract_main_text(pages: DataFrame, min_pages: int = 10, salts: int = 32, log_bits: int = 26) -> DataFrame:
    """(page_id, url, text, n_chars, host) of every page from its whole html.

    A subtree is template where it stands on `min_pages` or more pages of its host that differ
    in their longest other block, however large the host is. Prose of an article must be the
    host's own for that: what another host has, too, is text that is passed on, and stays.
    Headings of articles are never counted. So copied articles and copied pages stay. Where
    templates would leave an article nothing but headings, its text stays whole. Which parts of
    a page count is told at `read_page`.

    Null or empty html gives an empty text; a null or odd url counts to the host ''. Elements
    may be nested to any depth and never closed; a stray quote is part of the attribute it
    stands in. Repeated rows are extracted each; other columns are not read. Every page is
    parsed once and its blocks are written to the shared folder. Each task tells at most
    `min_pages` different contexts of a subtree before the shuffle. Subtrees that may be
    templates, by a bitmap of fixed size, meet those of their host by a join that is salted by
    page, since one host may have a third of all pages; `salts` and `log_bits` change cost,
    never results.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows, kind = as_text(pages.select("page_id", "url", "html", host.alias("host")), "page_id")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                found = list(map(read_page, part["html"]))
                told = [tuple(map(list, zip(*p.subtrees, strict=True))) or ([], [], [], []) for p in found]
                out = {"page_id": part["page_id"], "url": part["url"], "host": part["host"], "blocks": [p.texts for p in found], "body": [p.body for p in found]}
                yield pd.DataFrame(out | {c: [t[k] for t in told] for k, c in enumerate(("subtrees", "first", "after", "prose"))} | {"contexts": [p.contexts() for p in found]})

    schema = "page_id string, url string, host string, blocks array<string>, body array<boolean>, subtrees array<bigint>, first array<int>, after array<int>, prose array<boolean>, contexts array<bigint>"
    parsed = Scratch(spark).keep(rows.mapInPandas(parse, schema).withColumn("uid", F.monotonically_increasing_id()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], set[int]] = {}
        size = 0
        for b in batches:
            for h, subtrees, contexts in zip(b["host"], b["subtrees"], b["contexts"], strict=True):
                for x, around in zip(subtrees.tolist(), contexts.tolist(), strict=True):
                    held = seen.setdefault((h, x), set())
                    if len(held) < min_pages and around not in held:
                        held.add(around)
                        size += 1
            if size > 200_000:
                yield _table(seen)
                seen, size = {}, 0
        if seen:
            yield _table(seen)

    contexts = parsed.select("host", "subtrees", "contexts").mapInPandas(count, "host string, subtree bigint, context bigint").distinct()
    templates = materialize(contexts.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "subtree"))
    bits = spark.sparkContext.broadcast(name_bits(templates.select(F.col("subtree").alias("sid")), log_bits))

    def hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which hosts have what may be a template, once for each batch."""
        for b in batches:
            every = np.concatenate([*b["subtrees"], np.zeros(0, np.int64)]).astype(np.int64)
            hit = has_names(bits.value, every, log_bits)
            at = np.repeat(np.arange(len(b)), b["subtrees"].map(len))[hit]
            yield pd.DataFrame({"host": b["host"].to_numpy()[at], "subtree": every[hit]}).drop_duplicates()

    spread = parsed.select("host", "subtrees").mapInPandas(hosts, "host string, subtree bigint").distinct().groupBy("subtree").agg(F.count("*").alias("hosts"))
    templates = materialize(templates.join(spread, "subtree").select("host", "subtree", (F.col("hosts") == 1).alias("own")))

    def maybe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = np.concatenate([*b["subtrees"], np.zeros(0, np.int64)]).astype(np.int64)
            hit = has_names(bits.value, every, log_bits)
            at = np.repeat(np.arange(len(b)), b["subtrees"].map(len))[hit]
            yield pd.DataFrame({"uid": b["uid"].to_numpy()[at], "host": b["host"].to_numpy()[at], "subtree": every[hit], "first": np.concatenate([*b["first"], np.zeros(0, np.int32)])[hit].astype(np.int32), "after": np.concatenate([*b["after"], np.zeros(0, np.int32)])[hit].astype(np.int32), "prose": np.concatenate([*b["prose"], np.zeros(0, bool)])[hit].astype(bool)})

    held = parsed.select("uid", "host", "subtrees", "first", "after", "prose").mapInPandas(maybe, "uid bigint, host string, subtree bigint, first int, after int, prose boolean").withColumn("salt", F.abs(F.hash("uid")) % salts)
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = held.join(salted, ["host", "salt", "subtree"]).filter("own or not prose").groupBy("uid").agg(F.collect_set(F.struct("first", "after")).alias("gone"))
    every = F.zip_with(F.zip_with("blocks", "body", lambda t, b: F.struct(t.alias("t"), b.alias("b"))), F.sequence(F.lit(0), F.size("blocks")), lambda x, i: F.struct(x["t"].alias("t"), x["b"].alias("b"), i.alias("i")))
    every = F.slice(every, 1, F.size("blocks"))
    rows = parsed.select("uid", "page_id", "url", "host", "blocks", "body", "subtrees")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            subtrees = b.column(b.schema.get_field_index("subtrees"))
            hit = has_names(bits.value, subtrees.flatten().to_numpy(zero_copy_only=False).astype(np.int64), log_bits)
            at = np.repeat(np.arange(b.num_rows), subtrees.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.bincount(at[hit], minlength=b.num_rows) > 0)], names=[*b.schema.names, "open"])

    # only pages that may hold a template cross a shuffle
    flagged = rows.mapInArrow(flag, StructType([*rows.schema.fields, StructField("open", BooleanType())])).drop("subtrees")
    plain = flagged.filter("not open").select("page_id", "url", "host", F.array_join("blocks", "\n").alias("text"))
    told = flagged.filter("open").drop("open").join(gone, "uid", "left").withColumn("every", every)
    told = told.withColumn("kept", F.filter("every", lambda x: ~F.exists(F.coalesce("gone", F.array().cast("array<struct<first:int,after:int>>")), lambda g: (g["first"] <= x["i"]) & (x["i"] < g["after"]))))
    bare = F.exists("every", lambda x: x["b"]) & ~F.exists("kept", lambda x: x["b"])
    text = F.when(F.col("gone").isNull() | bare, F.array_join("blocks", "\n")).otherwise(F.array_join(F.transform("kept", lambda x: x["t"]), "\n"))
    cleared = told.select("page_id", "url", "host", text.alias("text"))
    return plain.unionByName(cleared).select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"), "host")


def _table(seen: dict[tuple[str, int], set[int]]) -> pd.DataFrame:
    rows = [(h, x, c) for (h, x), held in seen.items() for c in held]
    return pd.DataFrame(rows, columns=["host", "subtree", "context"])


def name_bits(names: DataFrame, log_bits: int) -> np.ndarray:
    """A bitmap of 64-bit names (sid), of fixed size, by their own highest bits."""
    word = F.shiftrightunsigned("sid", 70 - log_bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sid, {64 - log_bits}) & 63 as int))")
    rows = names.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << log_bits - 6, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def has_names(bits: np.ndarray, names: np.ndarray, log_bits: int) -> np.ndarray:
    """Which of some signed 64-bit names the bitmap may hold."""
    at = names.view(np.uint64) >> np.uint64(64 - log_bits)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
