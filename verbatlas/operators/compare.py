"""Changes between states: collections against sources, statuses before and after, norms found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.text import canonical, col, norm

# How a status says that a bill became a norm, and how norms are written.
BECAME = "transformad[ao] n[ao]|convertid[ao] n[ao]|promulgad|sancionad|norma juridica"
NORM = "(?i)(emenda constitucional|lei complementar|medida provisoria|decreto-lei|decreto|lei)\\s+(?:n[ºo°.]*\\s*)?([0-9]{1,3}(?:\\.[0-9]{3})*|[0-9]+)"
SPECIES = [("emenda constitucional", "EC"), ("lei complementar", "LC"), ("medida provisoria", "MP"), ("decreto-lei", "DL"), ("decreto", "Decreto"), ("lei", "Lei")]
CHANGES = "\\b(altera|revoga|acrescenta|modifica|da nova redacao|inclui|dispoe sobre)"
LAW_CONTEXT = "\\b(lei|decreto|codigo|medida provisoria)\\b"


def compared(corpus: DataFrame, source: DataFrame, key: str = "id", text: str = "text", order: str = "ordem") -> DataFrame:
    """(key, verdict, anchor): blocks to change, to add behind an anchor, or gone from the source.

    Texts are compared in canonical form, by hashes: no text crosses a shuffle. Null texts are equal. The anchor of a
    new block is the last block before it, in the source's order, that the corpus has.
    """
    c = corpus.select(F.col(key), F.sha2(canonical(text).cast("binary"), 256).alias("__c"), F.lit(True).alias("__in"))
    s = source.select(F.col(key), F.sha2(canonical(text).cast("binary"), 256).alias("__s"), F.col(order).alias("__o"), "parent")
    w = Window.partitionBy("parent").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    here = s.join(c, key, "left").withColumn("anchor", F.last(F.when(F.col("__in"), F.col(key)), ignorenulls=True).over(w))
    verdict = F.when(F.col("__in").isNull(), "add").when(~F.col("__c").eqNullSafe(F.col("__s")), "change")
    here = here.withColumn("verdict", verdict).where("verdict IS NOT NULL")
    gone = corpus.select(key).join(source.select(key), key, "left_anti").select(key, F.lit("gone").alias("verdict"))
    here = here.select(key, "verdict", F.when(F.col("verdict") == "add", F.col("anchor")).alias("anchor"))
    return here.unionByName(gone, allowMissingColumns=True)


def transitions(old: DataFrame, new: DataFrame, key: str, status: str, citable: list[str]) -> DataFrame:
    """(key, before, after, lost, gained): known rows whose status changed, and whether it left or entered
    the citable ones. New rows are no transition."""
    b = old.select(key, F.col(status).alias("before"))
    a = new.select(key, F.col(status).alias("after"))
    both = b.join(a, key).where(~F.col("before").eqNullSafe(F.col("after")))
    was, now = F.coalesce(F.col("before").isin(citable), F.lit(False)), F.coalesce(F.col("after").isin(citable), F.lit(False))
    return both.withColumns({"lost": was & ~now, "gained": ~was & now})


def became_norm(status: Column | str) -> Column:
    return norm(status).rlike(BECAME)


def norm_named(status: Column | str) -> Column:
    """'Lei 15.164/2025': the first norm that a text names, with the year that stands in the 30 characters after it."""
    plain = norm(status)
    kind = F.lower(F.regexp_extract(plain, NORM, 1))
    number = F.regexp_extract(plain, NORM, 2)
    at = F.regexp_instr(plain, F.lit(NORM)) + F.length(F.regexp_extract(plain, NORM, 0))
    year = F.regexp_extract(F.substring(plain, at, F.lit(30)), "(1[89][0-9]{2}|20[0-9]{2})", 1)
    label = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SPECIES])
    return F.when(number != "", F.concat(label, F.lit(" "), number, F.when(year != "", F.concat(F.lit("/"), year)).otherwise("")))


def norms_named(text: Column | str) -> Column:
    """All norms that a text names, each once, in order, as ``norm_named`` writes them."""
    plain = norm(text)
    pieces = F.slice(F.split(plain, f"(?<![a-z-])(?={NORM})"), 1, 1_000_000)
    return F.array_distinct(F.filter(F.transform(pieces, norm_named), lambda x: x.isNotNull()))


def matched_names(df: DataFrame, names: DataFrame, text: str, name: str, value: str) -> DataFrame:
    """``df`` with ``value``: of the name that equals its text in normal form, else of the longest one that the text
    holds; null for none. ``names`` is a curated table, every row of which a text is held against."""
    n = names.select(norm(name).alias("__n"), F.col(value).alias("__v"))
    t = norm(text)
    best = F.max_by("__v", F.struct((F.col("__n") == F.col("__t")).alias("a"), F.length("__n").alias("b"), F.col("__v").alias("c")))
    met = df.select(t.alias("__t")).distinct().join(n, F.contains("__t", F.col("__n"))).groupBy("__t").agg(best.alias(value))
    return df.withColumn("__t", t).join(met, "__t", "left").drop("__t")


def targets_of(text: Column | str, targets: dict[str, str]) -> Column:
    """The ids of the laws that a summary says it changes. ``targets``: id to pattern over the normal form.

    The summary must have a verb of change; a hit on digits alone also needs a word for a law.
    """
    t = norm(text)
    hit = []
    for name, pattern in targets.items():
        by_name = F.regexp_extract(t, pattern, 0).rlike("[a-z]")
        hit.append(F.when(t.rlike(pattern) & (by_name | t.rlike(LAW_CONTEXT)), F.lit(name)))
    return F.when(t.rlike(CHANGES), F.array_compact(F.array(*hit))).otherwise(F.array().cast("array<string>"))


def articles_of(text: Column | str, targets: Column) -> Column:
    """Article ids that a summary changes: only where it has exactly one target and names at most one
    number of a law, so that no article is ascribed to the wrong one."""
    t = col(text)
    laws = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("\\b[0-9]{1,3}\\.[0-9]{3}\\b"), F.lit(0))))
    lists = F.regexp_extract_all(t, F.lit("(?i)\\barts?\\.?\\s*((?:[0-9]{1,4}(?:-[a-z])?[ºo°]?(?:\\s*(?:,|e)\\s*)?)+)"), F.lit(1))
    numbers = F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.lower(x), F.lit("[0-9]{1,4}(?:-[a-z])?"), F.lit(0)))))
    ids = F.transform(numbers, lambda n: F.concat(F.get(targets, F.lit(0)), F.lit("_art"), n))
    return F.when((F.size(targets) == 1) & (laws <= 1), ids).otherwise(F.array().cast("array<string>"))


def after_cut(date: Column | str, cut: str) -> Column:
    """After a day, strictly; without a date a row is kept."""
    return col(date).isNull() | (col(date) > F.lit(cut).cast("date"))


def in_scope(text: Column | str, enters: str, leaves: str) -> Column:
    """What leaves wins over what enters."""
    t = norm(text)
    return t.rlike(enters) & ~t.rlike(leaves)


def parsed_date(x: Column | str) -> Column:
    """Day/month/year or ISO; null for another form."""
    t = F.trim(col(x))
    return F.coalesce(
        F.when(t.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(t, "dd/MM/yyyy")),
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")),
    )


def precedent_scope(articles: Column, text: Column | str, drugs: str, general: list[str], special: str) -> Column:
    """The first scope a precedent falls in: drugs, the general part (by article), the special part."""
    t = norm(text)
    listed = F.arrays_overlap(articles, F.array(*map(F.lit, general)))
    return F.when(t.rlike(drugs), "drugs").when(listed, "general").when(t.rlike(special), "special")
