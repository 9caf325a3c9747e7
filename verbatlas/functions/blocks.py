"""Lines of legal texts as blocks: what a line begins, whose part it is, and what it says of its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import blocks as html_blocks
from .html import unescaped
from .text import SIGN, col, collapsed, roman_value

# How paragraphs, items and letters begin, and how a change is noted.
ONLY_PARAGRAPH = "(?i)^Parágrafo\\s+único\\s*[.\\-–—]*\\s*"
PARAGRAPH = f"^§\\s*([0-9]+){SIGN}(?:\\s*-\\s*([A-Za-z])(?![a-zA-Z]))?\\s*[.\\-–—]*\\s*"
ITEM = "^([IVXLC]+)\\s*[-–—]\\s*"
LETTER = "^([a-z])\\s*\\)\\s*"
ARTICLE = f"^Art\\.?\\s*([0-9]+){SIGN}(-[A-Z])?\\s*[.\\-–—]*\\s*"
INLINE = "(?:^|[;:.]\\s)\\s*(?:[IVXLC]{1,7}\\s*[-–—]\\s+|[a-z]\\s*\\)\\s)"
NOTE = "\\((?:[^()]*(?:Redação dada|Incluíd[oa]|Acrescentad[oa]|Revogad[oa]|Vide|Vigência|Renumerad[oa])[^()]*)\\)"


def inline_enumeration(x: Column | str) -> Column:
    """Whether a block holds items or letters that should be blocks of their own."""
    return F.coalesce(col(x).rlike(INLINE), F.lit(False))


def block(x: Column | str) -> Column:
    """struct(kind, label, key, text) of a line: what it begins, and the part of an id for it; null for none."""
    t = F.trim(col(x))
    number, letter = F.regexp_extract(t, PARAGRAPH, 1), F.regexp_extract(t, PARAGRAPH, 2)
    sign = F.concat(F.lit("§ "), number, F.when(number.try_cast("int") <= 9, "º").otherwise(""))
    with_letter = lambda a, b: F.concat(a, F.when(letter != "", F.concat(F.lit("-"), b)).otherwise(""))
    roman, small = F.regexp_extract(t, ITEM, 1), F.regexp_extract(t, LETTER, 1)
    made = lambda kind, label, key, pattern: F.struct(F.lit(kind).alias("kind"), label.alias("label"), key.alias("key"), F.trim(F.regexp_replace(t, pattern, "")).alias("text"))
    return (
        F.when(t.rlike(ONLY_PARAGRAPH), made("paragrafo", F.lit("Parágrafo único"), F.lit("_pu"), ONLY_PARAGRAPH))
        .when(number != "", made("paragrafo", with_letter(sign, F.upper(letter)), with_letter(F.concat(F.lit("_p"), number), F.lower(letter)), PARAGRAPH))
        .when(roman != "", made("inciso", roman, F.concat(F.lit("_inc"), roman_value(roman).cast("string")), ITEM))
        .when(small != "", made("alinea", F.concat(small, F.lit(")")), F.concat(F.lit("_al"), small), LETTER))
    )


def addressed(lines: DataFrame, group: str, order: list[str], text: str = "text") -> DataFrame:
    """``lines`` with kind, label, body and ``suffix``, the block's address inside its group (an article).

    An item hangs from the last paragraph, or the article; a letter from the last item. Lines that begin nothing
    have no kind, and the address of none.
    """
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("__b", block(text))
    of = lambda kind: F.when(F.col("__b.kind") == kind, F.col("__b.key"))
    out = out.withColumn("__p", F.coalesce(F.last(of("paragrafo"), ignorenulls=True).over(w), F.lit("")))
    out = out.withColumn("__n", F.count(of("paragrafo")).over(w))
    inside = Window.partitionBy(group, "__n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__i", F.last(of("inciso"), ignorenulls=True).over(inside))
    item = F.when(F.col("__i").isNotNull(), F.concat("__p", "__i")).otherwise("")
    suffix = F.when(F.col("__b.kind") == "paragrafo", F.col("__p")).when(F.col("__b.kind") == "inciso", item).when(F.col("__b.kind") == "alinea", F.concat(item, F.col("__b.key")))
    return out.withColumns({"kind": F.col("__b.kind"), "label": F.col("__b.label"), "body": F.col("__b.text"), "suffix": suffix}).drop("__b", "__p", "__n", "__i")


def annotations(x: Column | str) -> Column:
    """The notes of changes in a text, in order."""
    return F.regexp_extract_all(col(x), F.lit(NOTE), F.lit(0))


def without_annotations(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(x), NOTE, " "), "\\s+", " "))


# The elements that bound a line.
BOUNDS = "p div h[1-6] li ul ol td th tr table tbody blockquote br hr center section article header footer body html title dl dt dd pre".split()


def lines_of(html: Column | str) -> Column:
    """The lines of a page, an array: bounded by block elements only, so that a note that is spread over links and spans, or over lines of the
    source, is in one of them."""
    t = F.regexp_replace(col(html), "(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\\1\\s*>", "")
    pieces = F.split(t, f"(?i)</?(?:{'|'.join(BOUNDS)})(?:\\s[^>]*)?/?>")
    return F.filter(F.transform(pieces, line), lambda x: x != "")


def line(x: Column) -> Column:
    """A piece of HTML as one line of text, whose spaces before a comma go."""
    return F.regexp_replace(collapsed(unescaped(F.regexp_replace(x, "<[^>]*>", ""))), " +(?=[,;.)])", "")


def outline(html: Column | str) -> Column:
    """The blocks of a page's act, an array of (article, suffix, kind, label, text), by one pass over its lines with what is open: the article, its paragraph,
    its item. A letter hangs from the open item or paragraph, an item from the open paragraph or the article. A line that begins nothing is
    more text of the block that is open; before the first article, it is a block of kind ``abertura``."""
    kind = "array<struct<article:string,suffix:string,kind:string,label:string,text:string>>"

    def entry(article: Column, suffix: Column, what: Column, label: Column, text: Column) -> Column:
        return F.array(F.struct(article.alias("article"), suffix.alias("suffix"), what.alias("kind"), label.alias("label"), text.alias("text")))

    def step(acc: Column, x: Column) -> Column:
        is_article, none = x.rlike(ARTICLE), F.lit("")
        number = F.lower(F.concat(F.regexp_extract(x, ARTICLE, 1), F.regexp_extract(x, ARTICLE, 2)))
        b = block(x)
        what = b["kind"]
        inside = b.isNotNull() & (acc["article"] != "")
        suffix = F.when(what == "paragrafo", b["key"]).when(what == "inciso", F.concat(acc["p"], b["key"])).otherwise(F.concat(F.when(acc["i"] != "", acc["i"]).otherwise(acc["p"]), b["key"]))
        out, n = acc["out"], F.size(acc["out"])
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, F.lit(1), n - 1), entry(last["article"], last["suffix"], last["kind"], last["label"], F.concat(last["text"], F.lit(" "), x)))
        new = (
            F.when(is_article, F.concat(out, entry(number, none, F.lit("artigo"), F.concat(F.lit("Art. "), number), F.trim(F.regexp_replace(x, ARTICLE, "")))))
            .when(inside, F.concat(out, entry(acc["article"], suffix, what, b["label"], b["text"])))
            .when(n > 0, longer)
            .otherwise(F.concat(out, entry(none, none, F.lit("abertura"), none, x)))
        )
        return F.struct(
            F.when(is_article, number).otherwise(acc["article"]).alias("article"),
            F.when(is_article, "").when(inside & (what == "paragrafo"), suffix).otherwise(acc["p"]).alias("p"),
            F.when(is_article | (inside & (what == "paragrafo")), "").when(inside & (what == "inciso"), suffix).otherwise(acc["i"]).alias("i"),
            new.alias("out"),
        )

    start = F.struct(*[F.lit("").alias(c) for c in ("article", "p", "i")], F.array().cast(kind).alias("out"))
    return F.aggregate(lines_of(html), start, step, lambda acc: acc["out"])


def scanned(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, text, notes) of a page's blocks, those that go on where the one before breaks off merged.

    A block goes on if it begins no article, paragraph, item or letter, begins in lower case, and the one
    before has no final mark. Notes of changes are taken out of the text. One page is one group.
    """
    each = html_blocks(pages, key, html).where("text <> ''")
    before = F.lag("text").over(Window.partitionBy(key).orderBy("pos"))
    goes_on = F.col("text").rlike("^[a-zà-ÿ]") & block("text").isNull() & before.isNotNull() & ~before.rlike("[.;:!?)]$")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = each.withColumn("__new", F.coalesce(~goes_on, F.lit(True)).cast("int")).withColumn("run", F.sum("__new").over(w))
    whole = runs.groupBy(key, F.col("run").alias("pos")).agg(F.min_by("kind", "pos").alias("kind"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("t"))
    return whole.select(key, "pos", "kind", without_annotations("t").alias("text"), annotations("t").alias("notes"))


def acts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, year, preamble, pos, text): a page of an act as its title, the lines before its first article, and its blocks.

    The title is the first heading; the year is the last one that it names. A page without an article is all preamble.
    """
    each = html_blocks(pages, key, html).where("text <> ''")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    each = each.withColumn("__in", F.max(F.col("text").rlike(ARTICLE)).over(w))
    each = each.withColumn("title", F.min_by(F.when(F.col("kind").rlike("^h[1-6]$"), F.col("text")), F.when(F.col("kind").rlike("^h[1-6]$"), F.col("pos"))).over(whole))
    ahead = F.sort_array(F.collect_list(F.when(~F.col("__in") & ~F.col("text").eqNullSafe(F.col("title")), F.struct("pos", "text"))).over(whole))
    each = each.withColumn("preamble", F.array_join(F.transform(ahead, lambda x: x["text"]), "\n"))
    year = F.element_at(F.regexp_extract_all("title", F.lit("(1[89][0-9]{2}|20[0-9]{2})"), F.lit(1)), -1).cast("int")
    at = F.row_number().over(Window.partitionBy(key, "__in").orderBy("pos"))
    return each.withColumn("year", F.when(F.col("title").rlike("1[89][0-9]{2}|20[0-9]{2}"), year)).withColumn("pos", at).where("__in").select(key, "title", "year", "preamble", "pos", "text")
