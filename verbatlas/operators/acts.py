"""What the pages of acts say of their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.blocks import ARTICLE, annotations, line, lines_of
from verbatlas.functions.html import absolute
from verbatlas.operators.compare import norm_named

# The verbs by which a note says what was done.
VERB = "(?i)\\((?:[^()]*?)(Redação dada|Incluíd[oa]|Acrescentad[oa]|Revogad[oa]|Vide|Vigência|Renumerad[oa])"


def changes(pages: DataFrame, key: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """(key, article, verb, norm, year, text, href): which norm changed which article of a page's act, by the notes in its text.

    One pass over a page's lines carries the article that runs (``12-a``, '' before the first). Notes that name no norm say nothing of one; the same norm at
    the same article is one change, the first. ``href`` is the address of the link that a note's text has, if any, against ``base``.
    """
    none = F.array().cast("array<struct<article:string,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        article = F.when(x.rlike(ARTICLE), F.lower(F.concat(F.regexp_extract(x, ARTICLE, 1), F.regexp_extract(x, ARTICLE, 2)))).otherwise(acc["article"])
        new = F.transform(annotations(x), lambda n: F.struct(article.alias("article"), n.alias("text")))
        return F.struct(article.alias("article"), F.concat(acc["out"], new).alias("out"))

    found = F.aggregate(lines_of(html), F.struct(F.lit("").alias("article"), none.alias("out")), step, lambda acc: acc["out"])
    anchor = '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>'
    labels = F.transform(F.regexp_extract_all(html, F.lit(anchor), F.lit(2)), line)
    each = pages.select(key, F.posexplode(found).alias("pos", "n"), F.arrays_zip(labels.alias("label"), F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href")).alias("links"), *([base] if base else []))
    each = each.withColumn("norm", norm_named(F.col("n.text"))).where("norm LIKE '%/%'")
    first = Window.partitionBy(key, "norm", "n.article").orderBy("pos")
    each = each.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    own = F.filter("links", lambda x: (x["label"] != "") & F.contains(F.col("n.text"), x["label"]))
    href = F.get(F.transform(own, lambda x: x["href"]), F.lit(0))
    return each.select(
        key, F.col("n.article").alias("article"), F.lower(F.regexp_extract("n.text", VERB, 1)).alias("verb"), "norm", F.substring_index("norm", "/", -1).cast("int").alias("year"), F.col("n.text").alias("text"),
        (absolute(base, href) if base else href).alias("href"),
    )
