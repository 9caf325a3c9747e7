"""HTML by regular expressions inside the plan: text, headings, links, listings, embedded JSON."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

#: A character reference with its semicolon, and the characters that the 252 names of HTML 4 stand for.
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}


def unescaped(x: Column | str) -> Column:
    """Numeric references and those by name become characters, each once; unknown names stay."""
    t = col(x)
    named = F.create_map(*[F.lit(y) for pair in NAMED.items() for y in pair])

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, "^" + REFERENCE, 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 9)).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(ref.startswith("#"), "\ufffd").otherwise(F.try_element_at(named, ref))
        return F.when((ref != "") & char.isNotNull(), F.concat(char, F.substring(piece, F.length(ref) + 3, F.length(piece)))).otherwise(piece)

    pieces = F.split(t, f"(?={REFERENCE})")
    return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(t)


def text_of(x: Column | str) -> Column:
    """The text of a piece of HTML: breaks become lines, other tags go, references are decoded."""
    t = F.regexp_replace(col(x), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "(?i)<br[^>]*>|</p>|</li>|</h[1-6]>|</div>", "\n")
    t = unescaped(F.regexp_replace(t, "<[^>]*>", " "))
    t = F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), "[ \\t]+", " ")
    return F.trim(F.regexp_replace(t, " *\\n[ \\n]*", "\n"))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, level, title): the table of contents."""
    pattern = "(?is)<h([1-4])[^>]*>(.*?)</h[1-4]>"
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"))
    each = pages.select(key, F.posexplode(pair).alias("pos", "h"))
    return each.select(key, (F.col("pos") + 1).alias("pos"), F.col("h.level").cast("int").alias("level"), F.trim(unescaped(F.regexp_replace("h.title", "<[^>]*>", ""))).alias("title"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, label) of the links, in page order."""
    pattern = '(?is)<a\\s+href="([^"]*)"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    each = pages.select(key, F.posexplode(pair).alias("pos", "a"))
    return each.select(key, (F.col("pos") + 1).alias("pos"), F.col("a.href").alias("href"), F.trim(unescaped(F.regexp_replace("a.label", "<[^>]*>", ""))).alias("label"))


def absolute(base: Column | str, href: Column | str) -> Column:
    """A link's target against its page's address: whole, from the host, or from the folder."""
    host = F.regexp_extract(col(base), "^([a-z]+://[^/]+)", 1)
    folder = F.regexp_extract(col(base), "^([a-z]+://.*/)", 1)
    return F.when(col(href).rlike("^[a-z]+://"), col(href)).when(col(href).startswith("/"), F.concat(host, col(href))).otherwise(F.concat(folder, col(href)))


def embedded_json(x: Column | str, schema: str) -> Column:
    """The JSON in a page's <script type="application/json">, by its schema; null where it is none."""
    return F.from_json(F.regexp_extract(col(x), '(?is)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1), schema)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, text): block elements in order, struck text left out; one begins where the last is unfinished."""
    kept = F.regexp_replace(html, "(?is)<(strike|s|del)>.*?</\\1>", "")
    pieces = F.filter(F.split(kept, "(?i)(?=<(?:p|h[1-6]|li|td|blockquote)[ >])"), lambda x: x.rlike("^(?i)<(p|h[1-6]|li|td|blockquote)[ >]"))
    each = pages.select(key, F.posexplode(pieces).alias("pos", "b"))
    body = F.regexp_replace("b", "(?is)</(p|h[1-6]|li|td|blockquote)>.*$", "")
    return each.select(key, (F.col("pos") + 1).alias("pos"), F.lower(F.regexp_extract("b", "^<([a-zA-Z0-9]+)", 1)).alias("kind"), text_of(body).alias("text"))
