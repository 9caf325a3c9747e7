"""A question from its words to what is shown: address or fusion, floors, orders, threads, and an answer from facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.text import article_number, col, norm
from verbatlas.operators import intent, search

#: Letters of a gram that fuzzy names are compared by; the least similarity of a suggestion.
GRAM, LEAST_LIKENESS = 3, 0.3


def natural(number: Column | str) -> list[Column]:
    """Sort columns of an article's number: by the number, then no letter before letters."""
    n = article_number(number)
    return [n["base"].asc_nulls_last(), n["suffix"].asc_nulls_first()]


def law_place(law: Column | str, laws: list[str]) -> Column:
    """A law's place in the order of priority; unknown ones are last, together."""
    at = F.array_position(F.array(*map(F.lit, laws)), col(law))
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(laws)).otherwise(at - 1)


def addresses(question: str, df: DataFrame, laws: list[str], only: str | None = None) -> list[str]:
    """The ids of the articles that a question names, by law in order of priority; none if it names none."""
    c = df.sparkSession.range(1).select(intent.classified(F.lit(question)).alias("c")).first()["c"]
    if c["kind"] != "dispositivo" or not c["article"]:
        return []
    named = [c["law"]] if c["law"] else [only] if only else laws
    return [f"{x}_art{c['article'].lower()}" for x in named if only is None or x == only]


def direct(blocks: DataFrame, ids: list[str], laws: list[str], most: int = 12) -> DataFrame:
    """All blocks (id, law, article, ordem, ...) of the articles, by priority of their law and document order, then cut."""
    hit = blocks.where(F.col("article").isin(ids)).withColumn("__law", law_place("law", laws))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__law", "ordem"))
    return hit.orderBy("__law", "ordem").limit(max(most, 1)).withColumn("place", place).withColumn("score", F.lit(0.0)).drop("__law")


def consulted(blocks: DataFrame, vectors: DataFrame | None, terms: DataFrame, edges: DataFrame, question: str, laws: list[str], embed: Callable[[str], DataFrame | None], only: str | None = None, most: int = 12) -> tuple[str, DataFrame | None]:
    """(way, rows): 'nothing' for an empty question, 'direct' for an article that exists, else 'fused', with the
    vector leg where ``embed`` gives a vector. ``blocks``: id, law, article, ordem, title, text."""
    asked = question.strip()
    if not asked:
        return "nothing", None
    ids = addresses(asked, blocks, laws, only)
    if ids:
        rows = direct(blocks, ids, laws, most)
        if not rows.isEmpty():
            return "direct", rows
    where = None if only is None else F.col("law") == only
    return "fused", search.hybrid(blocks, vectors, terms, edges, asked, embed(asked), most=search.clamped(most), only=where)


def enriched(hits: DataFrame, view: DataFrame) -> DataFrame:
    """Hits with what the view says of each (text, citation, coverage, day of the snapshot, ...): an inner join, so that
    nothing is shown that the collection lacks. The hits are at most ``most`` for a query, and therefore broadcast."""
    return F.broadcast(hits).join(view, "id")


def acts_found(headers: DataFrame, blocks: DataFrame, vectors: DataFrame | None, query: str, vector: DataFrame | None = None, year: int | None = None, most: int = 40) -> DataFrame:
    """Acts for a question: (query_id, place, id, score, by_header, head_pos, lexical_pos, vector_pos, header_id, title, day, ordem, text).

    ``headers`` (header_id, title, year, day), ``blocks`` (id, header_id, ordem, text), ``vectors`` (id, vector). A header that meets
    the query counts for its first block and weighs double. The year narrows headers, and with them all legs, before they are ranked.
    """
    heads = headers if year is None else headers.where(F.col("year") == year)
    mine = blocks.join(heads.select("header_id"), "header_id", "left_semi")
    legs = {"head": search.header_hits(heads, mine, query), "lexical": search.lexical_leg(mine, query, title=None)}
    if vectors is not None and vector is not None:
        legs["vector"] = search.vector_leg(search.of_documents(vectors, mine), vector)
    scores = search.fused(legs, {"head": 2.0})
    if "vector" not in legs:
        scores = scores.withColumn("vector_pos", F.lit(None).cast("int"))
    full = enriched(scores, mine).join(heads.select("header_id", "title", "day"), "header_id").withColumn("by_header", F.col("head_pos").isNotNull())
    out = decree_order(full).where(F.col("place") <= most)
    return out.select("query_id", "place", "id", "score", "by_header", "head_pos", "lexical_pos", "vector_pos", "header_id", "title", "day", "ordem", "text")


def decree_floor(hits: DataFrame, k: int = search.K, least_weight: float = 1.0, most: int = 4, fewest: int = 2) -> DataFrame:
    """The first ``most`` hits above a single leg's best score; if there are none, the first ``fewest``, marked ``weak``."""
    floor = F.lit(round(least_weight / (k + 1), 6))
    w = Window.partitionBy("query_id")
    strong = F.max(F.col("score") > floor).over(w)
    n = F.row_number().over(Window.partitionBy("query_id", F.col("score") > floor).orderBy("place"))
    out = hits.withColumns({"weak": ~strong, "__n": n})
    return out.where(F.when(F.col("weak"), F.col("__n") <= fewest).otherwise((F.col("score") > floor) & (F.col("__n") <= most))).drop("__n")


def decree_order(hits: DataFrame) -> DataFrame:
    """Hits of a header first, then by score, newer acts, and the block's place; ``place`` numbers them."""
    w = Window.partitionBy("query_id").orderBy(F.col("by_header").desc(), F.col("score").desc(), F.col("day").desc_nulls_last(), "ordem", "id")
    return hits.withColumn("place", F.row_number().over(w))


def by_alphabet(df: DataFrame, name: str, language: str = "pt") -> DataFrame:
    """Rows in the order of a language's dictionary: accents and case come last."""
    return df.orderBy(F.collate(F.col(name), language), name)


def revealed(df: DataFrame, order: list[Column | str], step: int = 60, times: int = 1) -> DataFrame:
    """What a list shows after so many steps."""
    return df.orderBy(*order).limit(step * times)


def grams(x: Column | str, n: int = GRAM) -> Column:
    """The distinct grams of a name in normal form, with two spaces before and one after each word."""
    words = F.transform(F.filter(F.split(norm(x), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, n)))))


def did_you_mean(asked: DataFrame, names: DataFrame, most: int = 3, least: float = LEAST_LIKENESS) -> DataFrame:
    """(query_id, name_id, likeness, rank) of the names (name_id, name) that are most like each query (query_id, query).

    Likeness is shared grams over all grams. Only pairs that share a gram meet, in a join on it; a gram that
    many names have is spread over them, as the pairs are summed before the shuffle.
    """
    q = asked.select("query_id", grams("query").alias("g")).select("query_id", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    n = names.select("name_id", grams("name").alias("g")).select("name_id", F.size("g").alias("nn"), F.explode("g").alias("gram"))
    met = n.join(q, "gram").groupBy("query_id", "name_id").agg(F.count("*").alias("shared"), F.first("nq").alias("nq"), F.first("nn").alias("nn"))
    like = F.round(F.col("shared") / (F.col("nq") + F.col("nn") - F.col("shared")), 6)
    met = met.select("query_id", "name_id", like.alias("likeness")).where(F.col("likeness") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("likeness").desc(), "name_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def replayed(questions: list[str], ask: Callable[[str], tuple[str, DataFrame | None]], remembered: int = 3, inherited: int = 5, sources: int = 8) -> list[dict]:
    """A conversation without a model: for each question the way, the ids found above the floor, whether they are weak, and
    the ids inherited from the last turns that the question's own search lacks. ``ask`` as ``consulted``."""
    thread: list[list] = []
    out = []
    for q in questions:
        way, rows = ask(q)
        kept = search.above_floor(rows) if way == "fused" else rows
        found = [] if kept is None else kept.orderBy("place").collect()
        own = [r["id"] for r in found]
        past = dict.fromkeys(i for ids in reversed(thread[-remembered:]) for i in ids)
        taken = [i for i in past if i not in own][:inherited]
        out.append({"question": q, "way": way, "found": own, "weak": any(r["weak"] for r in found) if way == "fused" else False, "inherited": taken})
        thread.append([*own, *taken][:sources])
    return out


def answer_from_facts(hits: DataFrame) -> DataFrame:
    """(query_id, paragraphs, sources, followups): what can be said of a search without a model.

    ``hits``: query_id, place, id, citation, term, role, coverage, revoked, day. Paragraphs say what was found, from when the
    text is, what is partly covered or revoked, and how the hits of one term belong together. A query without
    hits gives no row. A query has few hits, so they are one group.
    """
    cell = F.struct("place", "id", "citation", "term", "role", "coverage", "revoked", "day")
    one = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(cell)).alias("h"))
    first = F.col("h")[0]
    n = F.size("h")
    partial, revoked = F.size(F.filter("h", lambda x: x["coverage"] == "partial")), F.size(F.filter("h", lambda x: x["revoked"]))
    opening = F.when(first["term"].isNotNull(), F.concat(F.lit("“"), first["term"], F.lit("” is a curated term; it leads to "), first["citation"], F.lit("."))).otherwise(
        F.concat(n.cast("string"), F.lit(" blocks were found; the first is "), first["citation"], F.lit("."))
    )
    state = F.concat(
        F.lit("The text is of "), F.date_format(first["day"], "dd/MM/yyyy"), F.lit("."),
        F.when(partial > 0, F.concat(F.lit(" "), partial.cast("string"), F.lit(" of a law that is partly covered."))).otherwise(""),
        F.when(revoked > 0, F.concat(F.lit(" "), revoked.cast("string"), F.lit(" revoked."))).otherwise(""),
    )
    cluster = F.filter("h", lambda x: x["role"].isNotNull())
    together = F.when(F.size(cluster) > 1, F.concat(F.lit("These belong together: "), F.array_join(F.transform(cluster, lambda x: F.concat(x["citation"], F.lit(" ("), x["role"], F.lit(")"))), ", "), F.lit(".")))
    seal = lambda x: F.when(x["revoked"], "revoked").when(x["coverage"] == "partial", "partial").otherwise("in force")
    sources = F.transform("h", lambda x: F.struct(x["place"].alias("n"), x["id"].alias("id"), x["citation"].alias("citation"), seal(x).alias("seal")))
    follow = F.slice(F.array_compact(F.array(
        F.when(first["term"].isNotNull(), F.concat(F.lit("Other blocks of “"), first["term"], F.lit("”"))), F.concat(F.lit("The whole text of "), first["citation"]),
        F.when(partial > 0, F.lit("What the collection covers")), F.lit("Arguments that apply"),
    )), 1, 3)
    return one.select("query_id", F.array_compact(F.array(opening, state, together)).alias("paragraphs"), sources.alias("sources"), follow.alias("followups"))


def any_predicate(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def visible(df: DataFrame, user: str | None, public: Column | None = None, owner: str | None = None) -> DataFrame:
    """Rows that a user may see: public ones, and their own. Unknown (null) is no."""
    tests = ([public] if public is not None else []) + ([F.col(owner) == user] if owner and user is not None else [])
    return df.where(F.coalesce(any_predicate(*tests), F.lit(False)))


def visible_children(children: DataFrame, parents: DataFrame, key: str, user: str, owner: str) -> DataFrame:
    """Rows whose parent is the user's."""
    return children.join(visible(parents, user, owner=owner).select(key), key, "left_semi")


def history(threads: DataFrame, turns: DataFrame, query: str, key: str, title: str, body: str, at: str) -> DataFrame:
    """Threads whose title, or one of whose turns, holds the query; each once, the latest first."""
    has = lambda c: F.contains(norm(c), norm(F.lit(query.strip())))
    by_body = threads.join(turns.where(has(body)).select(key), key, "left_semi")
    return threads.where(has(title)).unionByName(by_body).dropDuplicates([key]).orderBy(F.col(at).desc_nulls_last(), key)
