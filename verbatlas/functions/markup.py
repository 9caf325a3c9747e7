"""HTML that may be shown: only what lists allow is written anew; all else is text or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import unescaped
from .text import col, once

# The elements, attributes and schemes of a document that is shown, and elements whose content is no text.
TAGS = "p div span br hr h1 h2 h3 h4 h5 h6 b strong i em u s sup sub small a ul ol li blockquote table thead tbody tfoot tr td th caption".split()
ATTRIBUTES = {"a": ["href", "name"], "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"]}
EVERYWHERE = ["id", "class"]
SCHEMES = "http https mailto".split()
NO_TEXT = "script style textarea option noscript iframe".split()
LINK = ' target="_blank" rel="noopener noreferrer nofollow"'

TAG = "^<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\\s/>])((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
ATTRIBUTE = "([a-zA-Z][a-zA-Z0-9:_-]*)\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"


def sanitised(x: Column | str) -> Column:
    """The allowed part of a piece of HTML.

    The text is cut before each ``<``. A piece that begins a whole tag is that tag written anew, if it is listed, with its listed attributes in
    their order; any other tag is left out, and its text stays, but for elements whose content is no text, which go to their end or the text's. A ``<`` that
    begins no tag becomes a reference. An address stays if it has a listed scheme, or none, after references are decoded and control characters
    taken out. Links open apart and give nothing to the page they open. Sanitised HTML is left as it is.
    """
    t = F.regexp_replace(col(x), "(?s)<!--.*?(?:-->|\\z)|<[!?][^>]*(?:>|\\z)", "")
    t = F.regexp_replace(t, f"(?is)<({'|'.join(NO_TEXT)})(?=[\\s/>]).*?(?:</\\1\\s*>|\\z)", "")
    return F.array_join(F.transform(F.split(t, "(?=<)"), lambda p: F.when(p.startswith("<"), once(p, piece)).otherwise(F.replace(p, F.lit(">"), F.lit("&gt;")))), "")


def piece(p: Column) -> Column:
    tag = F.lower(F.regexp_extract(p, TAG, 2))
    rest = F.replace(F.regexp_replace(p, TAG, ""), F.lit(">"), F.lit("&gt;"))
    end = F.regexp_extract(p, TAG, 1) == "/"
    written = F.when(end, F.when(tag.isin("br", "hr"), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))).otherwise(F.concat(F.lit("<"), tag, attributes(p, tag), F.lit(">")))
    return F.when(tag == "", F.concat(F.lit("&lt;"), F.replace(F.substring(p, F.lit(2), F.length(p)), F.lit(">"), F.lit("&gt;")))).otherwise(F.concat(F.when(tag.isin(TAGS), written).otherwise(""), rest))


def attributes(p: Column, tag: Column) -> Column:
    def parts(a: Column) -> Column:
        raw = F.regexp_extract(a, ATTRIBUTE, 2)
        value = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(F.lower(F.regexp_extract(a, ATTRIBUTE, 1)).alias("name"), value.alias("value"))

    every = F.transform(F.regexp_extract_all(F.regexp_extract(p, TAG, 3), F.lit(ATTRIBUTE), F.lit(0)), parts)

    def allowed(a: Column) -> Column:
        listed = a["name"].isin(EVERYWHERE)
        for t, names in ATTRIBUTES.items():
            listed = listed | ((tag == t) & a["name"].isin(names))
        return listed & ((a["name"] != "href") | safe(a["value"]))

    kept = F.filter(every, allowed)
    # of a name that is written twice the first counts, as in a browser
    first = F.filter(F.transform(kept, lambda a, i: F.struct(a["name"].alias("name"), a["value"].alias("value"), F.exists(F.slice(kept, F.lit(1), i), lambda b: b["name"] == a["name"]).alias("again"))), lambda a: ~a["again"])
    quoted = lambda v: F.replace(F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    text = F.array_join(F.transform(first, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), quoted(a["value"]), F.lit('"'))), "")
    return F.concat(text, F.when((tag == "a") & F.exists(first, lambda a: a["name"] == "href"), LINK).otherwise(""))


def safe(address: Column) -> Column:
    plain = F.lower(F.regexp_replace(unescaped(address), "[\\x00-\\x20\\x7f-\\xa0\\u200b-\\u200f\\ufeff]", ""))
    scheme = F.regexp_extract(plain, "^([^/?#:&]*):", 1)
    # a reference without its semicolon may hide a colon
    return ~plain.rlike("^[^/?#]*&") & (~plain.rlike("^[^/?#]*:") | scheme.isin(SCHEMES))
