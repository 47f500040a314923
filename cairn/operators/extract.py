"""Body text and titles from landed books and pages."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# What is no text of a page.
NOISE = ("style", "script", "table", "sup.reference", ".navbox", ".mw-editsection", ".ws-noexport", ".noprint", ".printfooter")
#: An ampersand, with the rest of the character reference if a semicolon ends it.
_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def plaintext_body(raw: Column) -> Column:
    """What stands between the line with the start marker and the first end marker of the file, stripped."""
    start, end = F.locate(V.BOOK_START, raw), F.locate(V.BOOK_END, raw)
    tail = F.substr(raw, F.greatest(start, F.lit(1)))
    newline = F.locate("\n", tail)  # none after the start marker: from the beginning
    begins = F.when((start > 0) & (newline > 0), start + newline).otherwise(1)
    ends = F.when(end > 0, end).otherwise(F.char_length(raw) + 1)
    return T.strip(F.substr(raw, begins, F.greatest(ends - begins, F.lit(0))))


def plaintext_title(raw: Column) -> Column:
    """The first Title line before the start marker; null if there is none or it is blank."""
    start = F.locate(V.BOOK_START, raw)
    header = F.when(start > 0, F.substr(raw, F.lit(1), start - 1)).otherwise(raw)
    return F.nullif(T.strip(F.regexp_extract(header, r"(?md)^Title:(?U)[\s\x1c-\x1f]*(.+)$", 1)), F.lit(""))


@dataclass(frozen=True)
class _Simple:
    """One compound of a selector, and whether it must be the parent of the one after it, or any ancestor."""

    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    parent: bool = False

    def names(self, tag: str, attrs: dict[str, str]) -> bool:
        own = attrs.get("class", "").split() if self.classes else ()
        return self.tag in ("", "*", tag) and all(attrs.get("id") == i for i in self.ids) and all(c in own for c in self.classes)


@cache
def selector(text: str) -> tuple[tuple[_Simple, ...], ...]:
    """A selector's alternatives: lists (`a, b`) of compounds (`tag`, `.class`, `#id` and their combinations) with descendant
    and child combinators (`a b`, `a > b`). Anything else is an error."""
    out = []
    for part in text.split(","):
        words = re.sub(r"\s*>\s*", " > ", part).split()
        steps: list[_Simple] = []
        for i, w in enumerate(words):
            if w == ">":
                if not steps or i + 1 == len(words) or words[i + 1] == ">":
                    raise ValueError(f"not a selector: {text!r}")
                steps[-1] = replace(steps[-1], parent=True)
                continue
            m = re.match(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)\Z", w)
            if not m:
                raise ValueError(f"not a selector: {text!r}")
            marks = re.findall(r"[.#][\w-]+", m[2])
            steps.append(_Simple((m[1] or "").lower(), tuple(x[1:] for x in marks if x[0] == "#"), tuple(x[1:] for x in marks if x[0] == ".")))
        if not steps:
            raise ValueError(f"not a selector: {text!r}")
        out.append(tuple(steps))
    return tuple(out)


def _matches(steps: tuple[_Simple, ...], path: list[tuple[str, dict[str, str]]]) -> bool:
    """Whether the last of the open elements is what the compounds name."""
    if not steps[-1].names(*path[-1]):
        return False
    if len(steps) == 1:
        return True
    above = (len(path) - 1,) if steps[-2].parent else range(len(path) - 1, 0, -1)
    return any(n > 0 and _matches(steps[:-1], path[:n]) for n in above)


class _Capture:
    """Text nodes below the first element that a selector names, without noise elements."""

    def __init__(self, wanted: str, noise: tuple[str, ...]):
        self.wanted, self.noise = selector(wanted), [s for n in noise for s in selector(n)]
        self.inside, self.skip, self.found, self.done = 0, 0, False, False
        self.parts: list[str] = []

    def opened(self, path: list[tuple[str, dict[str, str]]]) -> None:
        if not self.inside:
            if any(_matches(s, path) for s in self.wanted):
                self.inside, self.found = len(path), True
        elif not self.skip and any(_matches(s, path) for s in self.noise):
            self.skip = len(path)

    def closed(self, depth: int) -> None:
        if self.skip == depth:
            self.skip = 0
        if self.inside == depth:
            self.inside, self.done = 0, True


class _Picker(HTMLParser):
    """One parse of a page for several captures."""

    def __init__(self, captures: list[_Capture]):
        super().__init__(convert_charrefs=True)
        self.captures = captures
        self.path: list[tuple[str, dict[str, str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        self.path.append((tag, {k: v or "" for k, v in attrs}))
        for c in self.captures:
            if not c.done:
                c.opened(self.path)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.path):
            return
        while self.path:
            depth, (last, _) = len(self.path), self.path.pop()
            for c in self.captures:
                c.closed(depth)
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        for c in self.captures:
            if c.inside and not c.skip and not c.done:
                c.parts.append(data)


def _pick(html: str, *wanted: tuple[str, tuple[str, ...]]) -> list[list[str] | None]:
    """For each (selector, noise) the text nodes, None where the page doesn't have the element."""
    captures = [_Capture(s, n) for s, n in wanted]
    p = _Picker(captures)
    p.feed(html or "")
    p.close()
    return [c.parts if c.found else None for c in captures]


def _marked(html: str | None) -> tuple[str, str]:
    """The page with a character that it doesn't have for each ampersand of no closed reference, and that character: the
    parser would read `&amp` as `&amp;`."""
    html = html or ""
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
    return _REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else mark + m[0][1:], html), mark


def page_rows(frames: Iterable[pd.DataFrame], content: str, heading: str, noise: tuple[str, ...], closed_only: bool = False) -> Iterator[pd.DataFrame]:
    """Body lines and heading of batches of pages (k, html)."""
    for f in frames:
        rows = []
        for k, raw in zip(f["k"], f["html"], strict=True):
            try:
                raw, mark = _marked(raw) if closed_only else (raw, "&")
                body, head = _pick(raw, (content, noise), (heading, ()))
            except Exception as e:  # one page must not end the batch
                rows.append((k, None, None, f"{type(e).__name__}: {e}"))
                continue
            lines = [x.strip() for x in "\n".join(body).splitlines()] if body is not None else []
            title = "".join(x.strip() for x in head or []).replace(mark, "&") or None
            rows.append((k, "\n".join(x for x in lines if x).replace(mark, "&") if body is not None else None, title, None if body is not None else "no content element"))
        yield pd.DataFrame(rows, columns=["k", "text", "title", "error"])


def page_text(pages: DataFrame, key: str, html: str, content: str, heading: str, noise: tuple[str, ...] = NOISE, closed_only: bool = False) -> DataFrame:
    """key, text, title, error: body lines and heading of each page. A page without the content element, or one that the
    parser fails on, is an error row. Selectors are those that selector() reads. Character references are read as HTML does,
    with `&amp` at the end of a cut text as `&`, or with `closed_only` if they end in a semicolon."""
    for each in (content, heading, *noise):
        selector(each)  # a wrong one is an error of the query, not of each page
    run = lambda frames: page_rows(frames, content, heading, noise, closed_only)
    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(html).alias("html")).mapInPandas(run, f"k {kind}, text string, title string, error string")
    return out.withColumnRenamed("k", key)


def resolve_link(base: Column, href: Column) -> Column:
    """The link of a page, as a URL: relative to the page's scheme, host or folder, without dot segments."""
    page = F.regexp_extract(base, "^[^?#]*", 0)
    origin = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    at = F.substr(page, F.char_length(origin) + 1)
    own, tail = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_replace(href, "^[^?#]*", "")
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(at, "[^/]*$", ""), own))
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "/")
    none = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a)
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^[^:]*:", 0), href))
        .when(own == "", F.concat(page, tail))
        .otherwise(F.concat(origin, F.array_join(kept, "/"), tail))
    )


def catalog_text_link(url: Column, html: Column) -> Column:
    """The URL itself if it names a text file, else the page's first link that does, resolved; null if there is none."""
    href = F.regexp_extract(html, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*\.txt[^"']*)["']""", 1)
    bare = F.regexp_replace(url, "/+$", "")
    return F.when(bare.endswith(".txt") | bare.endswith(".txt.utf-8"), url).otherwise(resolve_link(url, F.nullif(href, F.lit(""))))


def fetch_outcome(status: Column) -> Column:
    return F.when(status == 304, "unchanged").when(status.between(200, 299), "fetched").otherwise("failed")


def extract(fetched: DataFrame, content: str = "#mw-content-text", heading: str = "#firstHeading", closed_only: bool = False) -> DataFrame:
    """source_id, text, title, error by source type; only HTML rows go through Python. A type without an extractor is an error
    row. `closed_only` is that of page_text()."""
    raw = F.col("raw")
    books = fetched.where("source_type = 'gutenberg_text'").select("source_id", plaintext_body(raw).alias("text"), plaintext_title(raw).alias("title"), F.lit(None).cast("string").alias("error"))
    pages = page_text(fetched.where("source_type in ('wikisource', 'wikipedia')"), "source_id", "raw", content, heading, closed_only=closed_only)
    known = F.coalesce(F.col("source_type").isin("gutenberg_text", "wikisource", "wikipedia"), F.lit(False))
    none = F.lit(None).cast("string")
    other = fetched.where(~known).select("source_id", none.alias("text"), none.alias("title"), F.concat(F.lit("no extractor for "), F.coalesce("source_type", F.lit("a source without a type"))).alias("error"))
    return books.unionByName(pages).unionByName(other)
