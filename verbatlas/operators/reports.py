"""What a run says of itself: logs, report files, resolved templates, differences by law, confirmations, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.blocks import inline_enumeration
from verbatlas.functions.text import col
from verbatlas.operators.integrity import MARKER, markers, raise_if_any

CAREFUL = "an enumeration stands inside the block: look at it"


def logged(runs: DataFrame, path: str) -> None:
    """Appends the rows of a run to the log."""
    runs.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def report(rows: DataFrame, path: str, kind: str = "json", head: str = "") -> None:
    """A report for people, overwritten as a whole: JSON lines, or Markdown with a table. It is one file, as it is read
    by eye: hand over few rows, such as counts and samples."""
    one = rows.coalesce(1)
    if kind == "json":
        one.write.mode("overwrite").json(path)
        return
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\r\n]", " "), F.lit("")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    top = "\n".join([*([f"# {head}", ""] if head else []), "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)])
    titled = rows.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(top).alias("value"))
    body = one.select(F.lit(1).alias("n"), line.alias("value"))
    titled.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def bodies(docs: DataFrame, path: str, key: str = "id", html: str = "html") -> None:
    """HTML bodies by id, and their index beside them. Both are overwritten, so none is left that the index lacks."""
    docs.select(key, html).write.mode("overwrite").parquet(f"{path}/bodies")
    docs.withColumn("bytes", F.octet_length(html)).drop(html).write.mode("overwrite").json(f"{path}/index")


def body_of(spark, path: str, wanted: str, key: str = "id") -> DataFrame:
    """The body of an id that the index has; none for others."""
    index = spark.read.json(f"{path}/index").where(F.col(key) == wanted)
    return spark.read.parquet(f"{path}/bodies").where(F.col(key) == wanted).join(index.select(key), key, "left_semi")


def samples(found: DataFrame, rule: str = "rule", key: str = "key", most: int = 20) -> DataFrame:
    """(rule, n, sample): of each rule how many rows broke it, and the first ``most`` keys.

    A rule may be broken by a third of all rows: they are counted before the shuffle, and ranked by a window that
    Spark prunes to ``most`` in each task.
    """
    counts = found.groupBy(rule).agg(F.count("*").alias("n"))
    w = Window.partitionBy(rule).orderBy(key)
    first = found.select(rule, key).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    listed = first.groupBy(rule).agg(F.sort_array(F.collect_list(key)).alias("sample"))
    return counts.join(listed, rule)


# --- templates -----------------------------------------------------------------------------------


def pieces(templates: DataFrame, key: str, template: str = "template") -> DataFrame:
    """(key, pos, kind, value): a template as prose and citations, in order; empty prose is left out."""
    text = F.col(template)
    prose, cites = F.split(text, MARKER), F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    both = F.flatten(F.transform(prose, lambda p, i: F.array(F.struct(F.lit("prose").alias("kind"), F.trim(p).alias("value")), F.struct(F.lit("cite").alias("kind"), F.get(cites, i).alias("value")))))
    each = templates.select(key, F.posexplode(F.filter(both, lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("pos", "x"))
    return each.select(key, (F.col("pos") + 1).alias("pos"), "x.kind", "x.value")


def resolved(templates: DataFrame, blocks: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``pieces`` with the cited blocks' columns (id, citation, text, checked_at, changed_by; null for prose).

    With ``strict`` every id that names nothing, of markers and of ``grounds``, is gathered, and any stops the job: a brief is whole or isn't made.
    """
    if strict:
        ids = templates.select(key, F.explode(F.array_union(markers("template"), F.coalesce("grounds", F.array().cast("array<string>")))).alias("id"))
        raise_if_any(ids.join(blocks.select("id"), "id", "left_anti").select("id").distinct().orderBy("id"), "citations of nothing")
    each = pieces(templates, key)
    return each.join(blocks, (F.col("kind") == "cite") & (F.col("value") == F.col("id")), "left")


def brief(cases: DataFrame, theses: DataFrame, blocks: DataFrame, applies: Column) -> DataFrame:
    """(case, cited, checked, pending, snapshot): of each case's theses the blocks cited, those among them that were checked after a
    change, the theses that still wait for review, and the day of the text.

    ``cases`` (case, facts), ``theses`` (thesis, trigger, template, grounds, review); ``applies`` says whether a thesis does.
    Theses are a curated table of a few dozen rows that every case is held against.
    """
    met = cases.join(theses, applies)
    parts = resolved(theses, blocks, "thesis").where("kind = 'cite'").select("thesis", "pos", "id", "checked_at", "changed_by", "day")
    each = met.select("case", "thesis", "review").join(parts, "thesis", "left")
    checked = F.col("checked_at").isNotNull() & (F.size(F.coalesce("changed_by", F.array().cast("array<string>"))) > 0)
    return each.groupBy("case").agg(
        F.array_sort(F.collect_set("id")).alias("cited"), F.array_sort(F.collect_set(F.when(checked, F.col("id")))).alias("checked"),
        F.array_sort(F.collect_set(F.when(F.col("review") == "pending", F.col("thesis")))).alias("pending"), F.max("day").alias("snapshot"),
    )


# --- differences -----------------------------------------------------------------------------------


def law_report(found: DataFrame, source: DataFrame, corpus: DataFrame, cut: int) -> DataFrame:
    """(list, article, id, anchor, care): every difference in one of four lists.

    ``found`` (id, verdict, anchor): from ``compare.compared``; ``source`` and ``corpus`` (id, article, ...), the source with
    text and years, those of the norms that changed it. 'changed': a norm of the year ``cut`` or later; 'new article': one
    that the corpus lacks, made by such a norm; 'no norm': all other differences, among them blocks that hold an
    enumeration (with ``care``), which nobody should apply unseen; 'not found': articles that the source lacks.
    """
    late = F.exists("years", lambda y: y >= cut)
    told = found.join(source.select("id", F.col("article").alias("__a"), "text", "years"), "id", "left").join(corpus.select("id", F.col("article").alias("__c")), "id", "left")
    known = corpus.select(F.col("article").alias("__a")).distinct().withColumn("__known", F.lit(True))
    told = told.join(known, "__a", "left").withColumn("article", F.coalesce("__a", "__c"))
    has = F.coalesce(late, F.lit(False)) & (F.col("verdict") != "gone")
    fresh = has & (F.col("verdict") == "add") & F.col("__known").isNull()
    care = F.when(has & inline_enumeration("text"), F.lit(CAREFUL))
    kind = F.when(fresh, "new article").when(has & care.isNull(), "changed").otherwise("no norm")
    there = source.select("article").distinct()
    absent = corpus.select("article").distinct().join(there, "article", "left_anti")
    lost = told.join(absent.withColumn("__gone", F.lit(True)), "article", "left").where("__gone IS NULL")
    out = lost.select(kind.alias("list"), "article", "id", "anchor", care.alias("care"))
    none = F.lit(None).cast("string")
    return out.unionByName(absent.select(F.lit("not found").alias("list"), "article", none.cast(out.schema["id"].dataType).alias("id"), none.cast(out.schema["anchor"].dataType).alias("anchor"), none.alias("care")))


def confirmed(found: DataFrame, details: DataFrame, *sources: DataFrame, most: int = 12) -> DataFrame:
    """``found`` (norm, first, ...) with ``url`` and ``place`` of its publication; and ``asked``.

    A norm is looked up once for all its rows, and ``most`` norms in a run, in the order of ``first``; the day comes from
    ``details`` (norm, day), the place from the first of the ``sources`` (norm, day, url, place) that has it. What isn't
    asked for, or not found, has null: that isn't 'unpublished'.
    """
    norms = found.where("norm IS NOT NULL").groupBy("norm").agg(F.min("first").alias("__f"))
    asked = norms.orderBy("__f", "norm").limit(most).select("norm").join(details, "norm")
    out = asked
    for i, s in enumerate(sources):
        out = out.join(s.select("norm", "day", F.col("url").alias(f"__u{i}"), F.col("place").alias(f"__p{i}")), ["norm", "day"], "left")
    at = out.select("norm", F.coalesce(*[F.col(f"__u{i}") for i in range(len(sources))]).alias("url"), F.coalesce(*[F.col(f"__p{i}") for i in range(len(sources))]).alias("place"), F.lit(True).alias("asked"))
    return found.join(F.broadcast(at), "norm", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))  # at most ``most`` rows


# --- landed answers ---------------------------------------------------------------------------------


def unlinked(links: DataFrame) -> DataFrame:
    """(id, problem) of links (id, status, body, number) that don't answer, or whose page doesn't name the law's number, plain
    or with points."""
    dotted = F.regexp_replace(F.format_number(F.col("number"), 0), ",", ".")
    named = F.contains("body", F.col("number").cast("string")) | F.contains("body", dotted)
    problem = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).when(~F.coalesce(named, F.lit(False)), "the number isn't named")
    return links.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def counts_for(params: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted combinations with how many landed rows each has, 0 for none."""
    n = landed.groupBy(*keys).agg(F.count("*").alias("n"))
    return params.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_details(found: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their detail page, where one landed; of several the latest ``seen``."""
    w = Window.partitionBy(key).orderBy(F.col("seen").desc_nulls_last())
    last = details.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "seen")
    return found.join(last, key, "left")


def foreign_ids(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Ids that don't have their collection's form, or would be taken for another's."""
    return df.where(~F.coalesce(col(key).rlike(pattern), F.lit(False))).select(key)
