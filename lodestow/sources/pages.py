"""Attachment links of web pages."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import blank_as_null
from ..functions.numbers import size_bytes
from ..session import visible


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nth, url): href and data-url values in order, each once whatever its case."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)\b(?:href|data-url)="([^"]+)"'), 1)).alias("at", "url"))
    once = found.groupBy(key, F.lower("url").alias("_u")).agg(F.min("at").alias("at"), F.min_by("url", "at").alias("url"))
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("nth"), "url")


def file_name(url: Column) -> Column:
    """The name that a link's file is kept under: its fname parameter, or the last part of its path, unescaped."""
    given = F.nullif(F.regexp_extract(url, r"[?&]fname=([^&#]*)", 1), F.lit(""))
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    raw = F.coalesce(given, last)
    return F.coalesce(F.try_url_decode(raw), raw)


def prioritised(links_df: DataFrame, scores: list[tuple[str, int]], order: list[Column]) -> DataFrame:
    """Links with ``score`` by the first text that they contain, the highest first, else in ``order``."""
    chain = F.lit(0)
    for text, score in reversed(scores):
        chain = F.when(F.contains(F.lower("url"), F.lit(text.lower())), score).otherwise(chain)
    return links_df.withColumn("score", chain).orderBy(F.desc("score"), *order)


#: Named entities that link texts use.
_ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&copy;": "©", "&reg;": "®", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&middot;": "·", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """A text with numbered entities and the common named ones as characters, & last."""
    number = r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"

    def character(e: Column) -> Column:
        code = F.when(F.startswith(e, F.lit("x")), F.conv(F.substring(e, 2, 6), 16, 10)).otherwise(e).cast("bigint")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    found = F.transform(F.regexp_extract_all(text, F.lit(number), 1), lambda e: character(F.lower(e)))
    parts = F.split(text, r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});", -1)
    text = F.when(F.contains(text, F.lit("&#")), F.array_join(F.zip_with(parts, found, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")).otherwise(text)
    for entity, sign in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def is_attachment(url: Column, words: list[str], extensions: list[str], hosts: list[str]) -> Column:
    """Whether a link leads to a file: it has one of the words, or one of the extensions before its query, or is at one of
    the hosts and neither a page nor a folder.  Links that lead nowhere (#, scripts, mail, telephone) do not."""
    leads = ~url.rlike("(?i)^(?:javascript|mailto|tel):") & (F.trim(url) != "") & (url != "#")
    bare = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    ends = lambda *e: reduce(Column.__or__, [F.endswith(bare, F.lit(x)) for x in e])
    any_of = lambda texts: reduce(Column.__or__, [F.contains(url, F.lit(x)) for x in texts], F.lit(False))
    at_host = any_of(hosts) & ~F.endswith(url, F.lit(".html")) & ~F.endswith(url, F.lit("/"))
    return leads & (any_of(words) | ends(*[f".{e}" for e in extensions]) | at_host)


_DIV = re.compile(r"<(/?)div\b([^>]*)>", re.IGNORECASE)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.IGNORECASE)


def content_part(pages: DataFrame, classes: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, body): what is inside the first div that has all the classes, up to its own end; the whole page without one."""

    def inside(page: str | None) -> str | None:
        depth, start = 0, -1
        for m in _DIV.finditer(page or ""):
            if start < 0:
                own = _CLASS.search(m[2]) if not m[1] else None
                if own and set(classes) <= set((own[1] or own[2] or "").split()):
                    start, depth = m.end(), 1
                continue
            depth += -1 if m[1] else 1
            if not depth:
                return page[start : m.start()]
        return page if start < 0 else page[start:]

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(map(inside, b.column(1).to_pylist()), pa.string())], names=[key, "body"])

    visible(pages.sparkSession)
    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, body string")


def link_title(text: Column, around: Column, title: Column) -> list[Column]:
    """``name`` and ``size`` of a link's file.

    A size in what stands around the link, or else in its text, ends the name, which is what comes before it
    without brackets and dashes.  Without a size the name is the link's text without bracketed numbers, or the
    title if that is blank or an address.
    """
    pattern = r"(?i)[0-9][0-9.]*\s*(?:KB|MB|GB)"
    t, a = F.trim(decoded(text)), F.trim(decoded(around))
    whole = F.when(a.rlike(pattern), a).when(t.rlike(pattern), t)
    before = F.trim(F.regexp_replace(F.split(whole, pattern)[0], r"[-|\s]+$", ""))
    sized = blank_as_null(F.regexp_replace(before, r"^[\[\](){}\s]+|[\[\](){}\s]+$", ""))
    bare = F.trim(F.regexp_replace(t, r"(?i)\s*[(\[{]\s*[0-9.]+\s*(?:KB|MB|GB|bytes)?\s*[)\]}]", ""))
    address = lambda c: F.startswith(F.lower(c), F.lit("http"))
    plain = F.coalesce(F.when(~address(bare), blank_as_null(bare)), blank_as_null(F.trim(title)))
    return [F.when(whole.isNotNull(), F.when(~address(sized), sized)).otherwise(plain).alias("name"), size_bytes(F.regexp_extract(whole, pattern, 0)).alias("size")]


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nth, url, name): links with the text inside them, without tags, entities decoded, white space single."""
    pair = F.posexplode(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>'), 0)).alias("at", "a")
    rows = pages.select(key, pair)
    inside = F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " ")
    return rows.select(key, (F.col("at") + 1).alias("nth"), F.regexp_extract("a", r'(?i)\bhref="([^"]*)"', 1).alias("url"), F.trim(decoded(inside)).alias("name"))
