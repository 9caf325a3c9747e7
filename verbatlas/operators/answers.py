"""Checks of generated answers against the sources they were given, as frames of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.text import lexemes

#: Words in a row that count as copied.
COPIED = 12
ANSWER = "paragraphs array<struct<text:string, citations:array<int>>>, sources array<struct<id:int, doc_id:string>>, confidence string, followups array<string>"


def shingles(words: Column, n: int = COPIED) -> Column:
    """The distinct windows of ``n`` words, each joined by spaces."""
    last = F.size(words) - n
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(last >= 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def copied(texts: DataFrame, sources: DataFrame, key: str, source_key: str, n: int = COPIED) -> DataFrame:
    """(key, source_key, shared): texts that share windows of ``n`` words with a source.

    ``sources`` (source_key, text) is the short side: its windows are joined with those of the texts.
    """
    # the words in a projection of their own: inside a lambda they would be computed for every window
    have = sources.select(source_key, lexemes("text").alias("w")).select(source_key, F.explode(shingles(F.col("w"), n)).alias("s")).distinct()
    told = texts.select(key, lexemes("text").alias("w")).select(key, F.explode(shingles(F.col("w"), n)).alias("s"))
    return told.join(have, "s").groupBy(key, source_key).agg(F.count_distinct("s").alias("shared"))


def parsed_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    return answers.withColumn("a", F.from_json(raw, ANSWER))


def non_latin(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike("[\\p{L}&&[^\\p{IsLatin}]]")


def violations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, rule, detail) of answers (answer_id, raw): broken shape, no text, a source that wasn't
    retrieved (answer_id, doc_id), a citation without a source, a paragraph without a citation, and letters
    of other scripts. What an answer says of itself is seen in its row; only the ids of sources are shuffled."""
    a = parsed_answers(answers)
    whole = F.col("a").isNotNull() & F.col("a.paragraphs").isNotNull() & F.col("a.sources").isNotNull()
    own = a.select("answer_id", F.explode(F.when(whole, in_itself(F.col("a"))).otherwise(F.array(broken("shape", F.lit(""))))).alias("v")).select("answer_id", "v.*")
    named = a.where(whole).select("answer_id", F.explode(F.transform("a.sources", lambda s: s["doc_id"])).alias("doc_id"))
    unknown = named.join(retrieved, ["answer_id", "doc_id"], "left_anti").select("answer_id", F.lit("unknown source").alias("rule"), F.col("doc_id").alias("detail"))
    return own.unionByName(unknown)


def broken(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def in_itself(a: Column) -> Column:
    """array of (rule, detail): what is wrong in a parsed answer, whatever was retrieved."""
    paragraphs = F.transform(a["paragraphs"], lambda p, i: F.struct(p["text"].alias("text"), p["citations"].alias("citations"), (i + 1).alias("n")))
    empty = F.when(~F.exists(a["paragraphs"], lambda p: F.trim(p["text"]) != ""), F.array(broken("empty", F.lit("")))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))
    cited = F.array_distinct(F.flatten(F.transform(a["paragraphs"], lambda p: F.coalesce(p["citations"], F.array().cast("array<int>")))))
    has = F.transform(a["sources"], lambda s: s["id"])
    orphan = F.filter(cited, lambda c: ~F.coalesce(F.array_contains(has, c), F.lit(False)))
    bare = F.filter(paragraphs, lambda p: (F.trim(p["text"]) != "") & (F.coalesce(F.size(p["citations"]), F.lit(0)) <= 0))
    script = F.filter(paragraphs, lambda p: non_latin(p["text"]))
    each = lambda rule, xs, f: F.transform(xs, lambda x: broken(rule, f(x)))
    return F.concat(empty, each("orphan citation", orphan, lambda c: c), each("no citation", bare, lambda p: p["n"]), each("other script", script, lambda p: p["n"]))


def corrections(found: DataFrame) -> DataFrame:
    """(answer_id, message): an answer's violations in one text."""
    line = F.concat_ws(": ", "rule", F.nullif("detail", F.lit("")))
    return found.groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("message"))


def without_ids(text: Column) -> Column:
    """Prose without ids in brackets, and without the space they leave before punctuation."""
    t = F.regexp_replace(text, "\\s*[\\[(][a-z0-9_]+(?:_art[0-9]+[a-z0-9_-]*)[\\])]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\\s+([.,;:])", "$1"), " +", " "))


def contexts(hits: DataFrame, group: str, order: str, label: Column, text: Column) -> DataFrame:
    """(group, context): the found texts in order, each under its label, as one block for a model."""
    block = F.concat_ws("\n", label, text)
    rows = hits.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("x"))
    return rows.select(group, F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("context"))


def clean_thread(turns: DataFrame, thread: str, turn: str, text: str, ids: str) -> DataFrame:
    """The last three turns of a thread, 300 characters of each, with at most four well-formed ids."""
    from verbatlas.operators.ordered import last_turns

    ok = F.slice(F.array_distinct(F.filter(ids, lambda x: x.rlike("^[a-z0-9_-]+$"))), 1, 4)
    return last_turns(turns, thread, turn, 3).withColumns({text: F.substring(F.col(text), 1, 300), ids: ok})
