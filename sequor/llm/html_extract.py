"""HTML extraction with site template removal.

A page is parsed once into text blocks and element subtrees; each subtree has a
hash of its names and text and the range of blocks that it holds.  Spark counts,
for each host and each of its path sections, the pages that hold a subtree, and
subtrees that recur there are templates: their blocks go.  Every url and every
main text has one vote, so what is copied or fetched again stays.  What does not
recur is left to the element names: parts that declare themselves furniture (by
tag, role, class or id) go, and where a page marks its article or main part,
only blocks in there stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequor.llm.url_filters import host
from sequor.operators.storage import materialize

#: A subtree is a template from this many pages on, and the lesser of this share and the root of the pages of a host or
#: path section; in marked articles, where prose is at stake, more pages and the second share are asked for.
MIN_PAGES = 5
MIN_SHARE = 0.3
INSIDE_PAGES = 10
INSIDE_SHARE = 0.5
#: Templates (8 bytes each) up to which their list may be broadcast; beyond, pages meet them by a shuffle.
BROADCAST_TEMPLATES = 4_000_000
#: Voting pages (8 bytes each) up to which their numbers may be broadcast.
BROADCAST_PAGES = 2_000_000

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside button dialog menu head audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that name a shape or a number of things beside such a name, and names of furniture that an article itself may hold.
SHAPES = frozenset(
    "area bar block body bottom bottombar box btn buttons center column container content feed form group header inner item items large left link links list "
    "lower main message module panel post posts primary right secondary section slot small sticky stories strip thread title top topbar unit upper wrap wrapper zone".split()
)
INSIDE = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist disqus reply respond share sharing newsletter signup sponsor sponsored".split())
#: Parts of class names that say something about an element, not what it is, and names of content.
FLAGS = frozenset("has no non not with without is hide hides show shows can allow friendly enabled disabled free ready on off open closed".split())
CONTENT = frozenset("article articlebody body content entry main page post story text wrapper".split())
CLOSES_P = BLOCK - {"html", "head", "body"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
_NAME_PARTS = re.compile(r"[A-Za-z0-9]+")


def _named(value: str, in_main: bool) -> bool:
    """Whether a class or id attribute names furniture: all of a name's words do, or tell its shape, and no name is of content.

    In an article or main part only comments, adverts and what asks readers for
    something count, as whole names.
    """
    found, names = False, INSIDE if in_main else NAMES
    for name in value.split():
        parts = _NAME_PARTS.findall(name)
        if len(parts) == 1 and parts[0] in CONTENT:
            return False
        words = [p for p in parts if not p.isdigit()]
        if words and FLAGS.isdisjoint(words) and all(w in names or w in SHAPES for w in words) and any(w in names for w in words):
            found = True
    return found


def _furniture(name: str, attributes: str, in_main: bool) -> int:
    """2 for furniture by element, role or being hidden; 1 by name or as a form, which an article inside outweighs; 0 for none."""
    if name in FURNITURE or name == "header" and not in_main:
        return 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 2 if name == "article" and "comment" in attributes.lower() else 1 if name == "form" else 0
    weak = name == "form"
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        if bare or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key == "role" and value in ROLES:
            return 2
        weak = weak or key in ("class", "id") and _named(value, in_main)
    return int(weak)


class _Element:
    __slots__ = ("name", "parts", "drop", "main", "holds_main", "first", "text")

    def __init__(self, name: str, drop: int, main: int, first: int) -> None:
        self.name, self.drop, self.main, self.first = name, drop, main, first
        self.parts: list[str] = []
        self.holds_main = False
        self.text = False


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """Blocks of a page's main text, and ``(hash, first, end, inside)`` of its element subtrees that hold text.

    ``first`` and ``end`` bound the blocks of a subtree (none for furniture), and
    ``inside`` tells whether it lies in a marked article or main part.  Memory
    and work are linear in the page, whatever its nesting.
    """
    root = _Element("", 0, 0, 0)
    stack, subtrees, blocks, buffer = [root], [], [], []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((text, stack[-1].main))

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            digest = xxhash.xxh3_64_intdigest(e.name + "\0" + "\1".join(e.parts))
            up = stack[-1]
            up.parts.append(f"{digest:x}")
            up.text |= e.text
            if e.holds_main or e.main > up.main:
                up.holds_main = True
            if e.text and not e.holds_main and e.name in BLOCK and e.name not in ("html", "body", "article", "main"):
                subtrees.append((digest - (1 << 63), e.first, len(blocks), e.main > 0))

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                top = stack[-1]
                top.parts.append(text)
                if not top.text and not text.isspace():
                    top.text = True
                if not top.drop:
                    buffer.append(text)
            elif text.startswith("<![CDATA["):
                buffer.append(html.escape(text[9:].removesuffix("]]>"))) if not stack[-1].drop else None
            continue
        name, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "br":
                buffer.append(" ")
                continue
            depth = len(stack) - 1
            while depth > 0 and stack[depth].name != name:
                if name not in BLOCK and stack[depth].name in BLOCK:
                    depth = 0
                    break
                depth -= 1
            if name in BLOCK:
                flush()
            if depth > 0:
                close(depth)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr", "img"):
                buffer.append(" " if name == "br" else "")
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
                pos = shut.end() if shut else end
            continue
        if name in BLOCK:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth].name
                if open_ == "p" and name in CLOSES_P or open_ == "li" == name or open_ in ("dd", "dt") and name in ("dd", "dt") or open_ in ("td", "th") and name in ("td", "th", "tr") or open_ == "tr" == name:
                    close(depth)
                    break
                if open_ in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                    break
        up = stack[-1]
        drop = max(up.drop, _furniture(name, attributes, up.main > 0))
        rank = 2 if name == "article" or "articleBody" in attributes else 1 if name == "main" or "role=\"main\"" in attributes else 0
        if rank and drop == 1:
            drop = 0  # an article outweighs the form or the named part around it
        stack.append(_Element(name, drop, up.main if drop else max(up.main, rank), len(blocks)))
    flush()
    close(1)
    best = max((main for _, main in blocks), default=0)
    at = [0]
    for _, main in blocks:
        at.append(at[-1] + (main == best))
    return [t for t, main in blocks if main == best], [(h, at[i], at[j], inside) for h, i, j, inside in subtrees]


_SUBTREES = pa.list_(pa.struct([("in_host", pa.int64()), ("in_section", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("inside", pa.bool_())]))
_PARSED = "url string, row long, host_key long, section_key long, blocks array<string>, subtrees array<struct<in_host:bigint,in_section:bigint,first:int,end:int,inside:boolean>>, digest long"


def _mixed(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of subtrees within a host or section."""
    with np.errstate(over="ignore"):
        x = (hashes ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [parse(x) if x else ([], []) for x in batch.column(5).to_pylist()]
        counts = [len(s) for _, s in parsed]
        flat = [x for _, s in parsed for x in s]
        # what recurs outside of articles is no template inside
        hashes = np.array([x[0] ^ x[3] for x in flat], np.int64).view(np.uint64)
        keys = [_mixed(np.repeat(batch.column(c).to_numpy().view(np.uint64), counts), hashes) for c in (3, 4)]
        fields = [pa.array(k, pa.int64()) for k in keys] + [pa.array([x[i] for x in flat], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.bool_()))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        subtrees = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=[f.name for f in _SUBTREES.value_type]))
        digest = [xxhash.xxh3_64_intdigest("\n".join(b)) - (1 << 63) for b, _ in parsed]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array([b for b, _ in parsed], pa.list_(pa.string())), subtrees, pa.array(digest, pa.int64())],
            names=["page_id", "url", "row", "host_key", "section_key", "blocks", "subtrees", "digest"],
        )


def section() -> Column:
    """First directory of a url's path, empty where it has none."""
    return F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def templates(parsed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``in_section`` keys of the subtrees that recur on their host or in their section."""
    url = F.xxhash64(F.coalesce("url", F.lit("")))
    captures = parsed.groupBy("host_key", url.alias("page")).agg(F.min(F.struct("digest", "row", "section_key")).alias("m"))
    voters = materialize(captures.groupBy("host_key", "m.digest").agg(F.min(F.struct("m.row", "m.section_key")).alias("m")).select("host_key", "m.*"), "voters")
    rows = voters.select("row")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_PAGES else rows
    held = parsed.select("row", "host_key", "section_key", "subtrees").join(rows, "row")
    each = held.select("host_key", "section_key", F.explode(F.array_distinct(F.transform("subtrees", lambda s: F.struct(s["in_host"], s["in_section"], s["inside"])))).alias("s"))
    each = each.select("host_key", "section_key", "s.*")
    # most subtrees are on one page: they travel as one number and no further
    often = materialize(each.groupBy("in_host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("in_host"), "often")
    often = F.broadcast(often) if often.count() <= BROADCAST_TEMPLATES else often
    counts = each.join(often, "in_host").groupBy("host_key", "section_key", "in_host", "in_section", "inside").agg(F.count("*").alias("n"))
    counts = materialize(counts, "subtrees")

    def recurring(by: str, key: str) -> DataFrame:
        of = voters.groupBy(by).agg(F.count("*").alias("of"))
        sums = counts.groupBy(by, key, "inside").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
        least = F.when(F.col("inside"), F.greatest(F.col("of") * INSIDE_SHARE, F.lit(float(INSIDE_PAGES)))).otherwise(F.least(F.col("of") * min_share, F.sqrt("of")))
        return sums.join(of, by).where(F.col("n") >= least).select(key, "inside")

    on_host = counts.join(recurring("host_key", "in_host"), ["in_host", "inside"], "left_semi").select("in_section")
    return on_host.union(recurring("section_key", "in_section").select("in_section")).distinct()


def _clean(common: np.ndarray | None):
    """Texts without the blocks of templates, which are ``common`` or a column of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subtrees, offsets = batch.column(3).flatten(), np.asarray(batch.column(3).offsets)
            offsets = offsets - offsets[0]
            keys, first, end = (np.asarray(subtrees.field(f)) for f in ("in_section", "first", "end"))
            own = None if common is not None else batch.column(4).to_pylist()
            hit = np.isin(keys, common) if common is not None else None
            texts, counts = [], []
            for i, blocks in enumerate(batch.column(2).to_pylist()):
                part = slice(offsets[i], offsets[i + 1])
                is_hit = hit[part] if hit is not None else np.isin(keys[part], np.array(own[i] or [], np.int64))
                counts.append(len(np.unique(keys[part][is_hit])))
                if counts[-1]:
                    gone = np.zeros(len(blocks) + 1, np.int64)
                    np.add.at(gone, first[part][is_hit], 1)
                    np.add.at(gone, end[part][is_hit], -1)
                    left = [b for b, g in zip(blocks, np.cumsum(gone[:-1]).tolist()) if not g]
                    blocks = left or blocks
                texts.append("\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_templates"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars, n_templates)`` for every row of ``pages(page_id, url, html)``.

    ``text`` joins the main blocks by newlines, character references decoded and
    white space folded; empty for null or empty html.  ``n_templates`` counts the
    page's recurring subtrees.  A page keeps its text if templates would leave it
    none.  Rows without a host are one host.  Repeated rows and ids keep their
    rows; other columns are not read; an empty table gives no rows.  Very long
    and very deep pages are parsed whole, in linear time.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), F.monotonically_increasing_id().alias("row"), "html")
    rows = rows.select("page_id", "url", "row", F.xxhash64(host(F.col("url"))).alias("host_key"), F.xxhash64(host(F.col("url")), section()).alias("section_key"), "html")
    dtype = rows.schema["page_id"].dataType.simpleString()
    parsed = materialize(rows.mapInArrow(_parse, f"page_id {dtype}, {_PARSED}"), "parsed")
    common = materialize(templates(parsed, min_pages, min_share), "templates")
    out, wanted = f"page_id {dtype}, url string, text string, n_templates long", ["page_id", "url", "blocks", "subtrees"]
    if common.count() <= BROADCAST_TEMPLATES:
        keys = np.sort(np.array([r.in_section for r in common.toLocalIterator()], np.int64))
        cleaned = parsed.select(*wanted).mapInArrow(_clean(keys), out)
    else:
        each = parsed.select("row", F.explode("subtrees.in_section").alias("in_section"))
        hits = each.join(common, "in_section").groupBy("row").agg(F.collect_set("in_section").alias("hits"))
        cleaned = parsed.join(hits, "row", "left").select(*wanted, "hits").mapInArrow(_clean(None), out)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))
