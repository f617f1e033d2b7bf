"""HTML extraction (6) by nearest-URL page differencing.

A page is read into lines, the texts of its blocks, each with the region it lies in.  Pages of a host are ordered by URL
path, and each is paired with the neighbour whose path has the longer front part in common.  The lines of the two pages are
aligned by their longest common subsequence, and what they share outside an article is chrome and deleted.  What menus,
headers, footers, sidebars, notices, adverts, forms and comments say differs from page to page as well, so lines in such
regions are left out by their markup, and the lines of an article stay even where a neighbour repeats them.

Only hashes of lines move to be ordered and compared: the order is a range partitioning of all pages by host and path, so
that a host with a third of all pages is spread like any other, and neighbours across the borders of partitions are
handed over by one row for each partition.  The texts of lines that may stay move once, to meet the positions to delete.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_key

# Element names of the HTML standard by what they mean here.
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template|svg|math"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form button select dialog menu head object canvas audio video".split())
ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role attributes that mark chrome, and comments of readers.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side-bar menu navigation navbar nav breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments discussion disqus respond reply replies complementary contentinfo search pagination pager toolbar widget skip-link".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])[^>]*/>|<({RAW})(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[/!?A-Za-z][^>]*+\Z|[^<]++|<", re.S | re.I)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS_OF_MARK = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")
#: First parts that tell of something else than the element itself, and elements that end where the next of them begins.
ABOUT_OTHERS = frozenset(("has", "no", "with", "without", "is"))
SELF_ENDING = frozenset("li dt dd tr td th option".split())
_CONTENT, _FREE, _CHROME = 2, 1, 0
#: Marks of readers' comments, which hold whatever their size, and elements that are never a page's text.
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
NEVER_TEXT = frozenset("nav header footer aside".split())
#: Characters outside links from which a marked part of an article is text.
LONG_PART = 200


def _is_chrome(name: str, attributes: str) -> str:
    """What makes an element chrome: its name, a mark of comments, another mark, or nothing (an empty text)."""
    if name in CHROME:
        return "name"
    if not attributes or name in ("html", "body"):
        return ""
    why = ""
    for m in MARKS.finditer(attributes):
        for word in WORDS_OF_MARK.findall((m[1] or m[2] or m[3] or "").lower()):
            parts = re.split("[-_]+", word)
            first, last = parts[0], parts[-1]
            if word in CHROME_WORDS or (first not in ABOUT_OTHERS and (first in CHROME_WORDS or last in CHROME_WORDS)):
                if COMMENT_WORDS & {word, first, last}:
                    return "comments"
                why = "mark"
    return "hidden" if HIDDEN.search(attributes) else why


class _Part:
    """An element taken for chrome: what is in it."""

    def __init__(self, no: int, name: str, why: str, in_article: bool):
        self.no, self.name, self.why, self.in_article = no, name, why, in_article
        self.plain = 0  # characters outside links
        self.article = False


def page_lines(source: str | None) -> list[tuple[str, int]]:
    """(text, region) of each block of a page: 2 in an article, 1 elsewhere, 0 in chrome.

    White space, also between blocks' inline parts, becomes one space; character references are decoded.  Chrome is not
    taken at its word where it holds the page's only article, most of the page's text outside links (unless it is a menu,
    header, footer, sidebar or comments), or, by a mark within an article, a long text: such elements count as any other."""
    lines, parts = _read(source, frozenset())
    if not parts:
        return lines
    whole = sum(len(t) for t, _ in lines)
    lone = not any(region == _CONTENT for _, region in lines)
    text = {p.no for p in parts if p.why not in ("comments", "hidden") and (
        (lone and p.article) or (p.plain * 2 > whole and lone and p.name not in NEVER_TEXT) or (p.in_article and p.why == "mark" and p.plain >= LONG_PART))}
    return _read(source, frozenset(text))[0] if text else lines


def _read(source: str | None, text_parts: frozenset[int]) -> tuple[list[tuple[str, int]], list[_Part]]:
    """Lines with their regions, and the parts taken for chrome; those numbered in ``text_parts`` are not."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the region outside them
    region = _FREE
    chrome: list[_Part] = []
    around: list[tuple[int, _Part]] = []  # open parts taken for chrome, by the height of the stack outside them
    links = no = 0

    def close_block() -> None:
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        if text:
            out.append((text, region))

    for m in TOKEN.finditer(source or ""):
        name = m[3] or m[6]
        if name is None:
            text = m[0]
            if m[1] is None and (text == "<" or text[0] != "<"):
                parts.append(html.unescape(text) if "&" in text else text)
                if around and not links:
                    size = len(text.strip())
                    for _, part in around:
                        part.plain += size
            elif m[1] and m[1].lower() not in ("script", "style"):
                close_block()
            continue
        name, attributes = name.lower(), m[4] if m[3] else m[7]
        if name in INLINE:
            if name == "a":
                links = 0 if m[2] or m[5] else 1
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                close_block()
            continue
        close_block()
        if not (m[2] or m[5]):
            if stack and (stack[-1][0] == "p" or (name in SELF_ENDING and stack[-1][0] == name)):
                region = stack.pop()[1]
            while around and around[-1][0] >= len(stack):
                around.pop()
            inner, no = region, no + 1
            why = _is_chrome(name, attributes)
            if why and no not in text_parts:
                part = _Part(no, name, why, region == _CONTENT)
                chrome.append(part)
                around.append((len(stack), part))
                inner = _CHROME
            elif name in ARTICLE:
                for _, part in around:
                    part.article = True
                inner = _CONTENT if region == _FREE else region
            if inner != region or (around and around[-1][0] == len(stack)) or any(n == name for n, _ in stack):
                stack.append((name, region))
                region = inner
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                region = stack[at][1]
                del stack[at:]
                while around and around[-1][0] >= at:
                    around.pop()
    close_block()
    return out, chrome


def shared_positions(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence of the two lists.

    The k-th occurrence of a line in one list stands for the k-th in the other, so each line has one partner at most and
    the subsequence is a longest increasing one: n log n steps and memory in proportion to the lists."""
    seen: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        seen.setdefault(b[j], []).append(j)
    pairs = [(i, seen[x].pop()) for i, x in enumerate(a) if seen.get(x)]
    tails, chosen, before = [], [], [0] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[n] = chosen[at - 1] if at else -1
        tails[at:at + 1] = [j]
        chosen[at:at + 1] = [n]
    out, n = [], chosen[-1] if chosen else -1
    while n >= 0:
        out.append(pairs[n][0])
        n = before[n]
    return out[::-1]


def candidate_lines(lines: list[tuple[str, int]]) -> list[tuple[int, str, bool]]:
    """(position, text, in an article) of the lines that may stay: those of the article if there is one, else all but chrome."""
    article = any(region == _CONTENT for _, region in lines)
    return [(i, t, article) for i, (t, region) in enumerate(lines) if region == (_CONTENT if article else _FREE)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path without query and fragment; empty where the URL is null or has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(
        F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def line_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """row_id, row_text, host, path and the hashes of the lines of every page, written once in the order of host and path
    with the number of the partition they are in."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in page_lines(x.as_py())] for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["row_id", "row_text", "host", "path", "lines"])

    host, path = url_parts(F.col(url_col))
    source = pages.select(F.col(id_col).alias("row_id"), text_key(F.col(html_col)).alias("row_text"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    kind = source.schema["row_id"].dataType.simpleString()
    rows = staged(source.mapInArrow(each, f"row_id {kind}, row_text bigint, host string, path string, lines array<bigint>").distinct(), "page-lines")
    return staged(rows.repartitionByRange("host", "path", "row_id", "row_text").withColumn("part", F.spark_partition_id()), "ordered-lines")


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds ``mate``, the lines of the neighbour in the order of paths with the longer common front of its path, the one
    before on equal terms; null for a page that is alone on its host.  Adds ``judge``, that neighbour or else the other one,
    whichever first differs from the page in its lines; null if none does, as a copy cannot tell chrome from text."""
    order = ("host", "path", "row_id", "row_text")
    item = F.struct(*order, "lines")
    ends = rows.groupBy("part").agg(F.min(item).alias("first"), F.max(item).alias("last"))
    parts = Window.orderBy("part")  # a row for each partition
    ends = ends.select("part", F.lag("last").over(parts).alias("earlier"), F.lead("first").over(parts).alias("later"))
    w = Window.partitionBy("part").orderBy(*order)
    near = rows.withColumns({"prev": F.lag(item).over(w), "next": F.lead(item).over(w)}).join(ends, "part")
    prev, after = F.coalesce("prev", "earlier"), F.coalesce("next", "later")

    def common(other: Column) -> Column:
        """Equal leading characters of the two paths, -1 on another host."""
        size = F.least(F.length("path"), F.length(other["path"]))
        same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda n: F.left("path", n) == F.left(other["path"], n)))
        return F.when(other["host"] == F.col("host"), F.when(size > 0, same).otherwise(0)).otherwise(-1)

    near = near.select(*order, "lines", prev.alias("prev"), after.alias("next"))
    near = near.withColumns({"a": F.coalesce(common(F.col("prev")), F.lit(-1)), "b": F.coalesce(common(F.col("next")), F.lit(-1))})
    mate = F.when((F.col("a") < 0) & (F.col("b") < 0), None).when(F.col("a") >= F.col("b"), F.col("prev.lines")).otherwise(F.col("next.lines"))
    other = F.when(F.col("a") >= F.col("b"), F.when(F.col("b") >= 0, F.col("next.lines"))).when(F.col("a") >= 0, F.col("prev.lines"))
    judge = F.when(mate != F.col("lines"), mate).when(other != F.col("lines"), other)
    return near.select("row_id", "row_text", "host", "path", "lines", mate.alias("mate"), judge.alias("judge"))


def deletions(near: DataFrame) -> DataFrame:
    """row_id, row_text, host, path, for each line of a page whether its judge shares it, and how many its mate shares."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, counts = [], []
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns[4:7]), strict=True):
                with_mate = shared_positions(a, b) if b is not None else []
                mask = np.zeros(len(a), bool)
                mask[with_mate if b == c else shared_positions(a, c) if c is not None else []] = True
                masks.append(mask)
                counts.append(len(with_mate))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(masks, pa.list_(pa.bool_())), pa.array(counts, pa.int64())],
                                             ["row_id", "row_text", "host", "path", "shared", "n_shared"])

    kind = near.schema["row_id"].dataType.simpleString()
    return near.mapInArrow(each, f"row_id {kind}, row_text bigint, host string, path string, shared array<boolean>, n_shared bigint")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines in common with the paired page) of every row of ``pages``.

    A null html counts as empty and gives an empty text.  Pages whose URL is null or has no host form a host of their own.
    Rows equal in id, host, path and html are one page and not each other's mate, and all are returned; of different pages
    under one id each is judged by itself.  Where both neighbours have the very lines of a page, nothing of it is deleted.  Null ids come first in the order of paths.  Very long pages are read whole, in
    time n log n; other columns play no part; an empty table gives no rows."""
    shared = staged(deletions(neighbours(line_rows(pages, id_col, url_col, html_col))), "shared-lines")
    keys = ["row_id", "row_text", "host", "path"]
    shared = shared.select(F.struct(*keys).alias("page"), "shared", "n_shared")
    host, path = url_parts(F.col(url_col))
    page = F.struct(F.col(id_col).alias("row_id"), text_key(F.col(html_col)).alias("row_text"), host.alias("host"), path.alias("path"))
    lines_of = "array<struct<at: int, text: string, article: boolean>>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("article", pa.bool_())]))
        for batch in batches:
            found = [[{"at": i, "text": t, "article": a} for i, t, a in candidate_lines(page_lines(x.as_py()))] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, kind)], ["page", "url", "lines"])

    source = pages.select(page.alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    candidates = source.mapInArrow(each, f"page {source.schema['page'].dataType.simpleString()}, url string, lines {lines_of}")
    joined = candidates.join(shared.hint("merge"), "page", "left")
    stays = F.filter("lines", lambda x: x["article"] | ~F.coalesce(F.get("shared", x["at"]), F.lit(False)))
    text = F.array_join(F.transform(stays, lambda x: x["text"]), "\n")
    done = joined.select(F.col("page.row_id").alias("page_id"), "url", text.alias("text"), "n_shared")
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")
