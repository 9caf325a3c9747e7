"""Curation, addresses, floors, reports and displays over the test tables: each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.functions import blocks, display
from verbatlas.operators import consult, curation, merge, ordered, reports, search
from verbatlas.operators import index as written
from verbatlas.plans.etl_queries import dealt, dealt_sql
from verbatlas.plans.search_queries import ASK, hybrid_sql, index_of, run, t

LAWS = ["O", "P"]


# --- search results -------------------------------------------------------------------------------


def q_enriched_hits(spark, d):
    """Hits with what the documents' view says of them: source, language, length, the day of the snapshot."""
    view = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars", F.lit("2025-01-31").cast("date").alias("snapshot"))
    return consult.enriched(run(spark, d), view).select("place", "id", "score", "source", "lang", "n_chars", "snapshot")


def q_decree_floor(spark, d):
    hits = run(spark, d, "the and that", most=60).withColumn("query_id", F.lit(1))
    return consult.decree_floor(hits).select("id", "place", "score", "weak")


def q_decree_order(spark, d):
    """Orders as acts of a customer: urgent ones as hits of the header, scores by price."""
    o = t(spark, d, "orders")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").startswith("1").alias("by_header"), F.round(F.col("o_totalprice") / 100_000, 0).alias("score"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 7).alias("ordem"))
    return consult.decree_order(hits).select("query_id", "id", "place")


def q_acts_found(spark, d):
    """Orders of a year as acts, line items as their blocks."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    heads = o.select(F.col("o_orderkey").alias("header_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"))
    lines = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("header_id"), F.col("l_linenumber").alias("ordem"), F.concat_ws(" ", "l_returnflag", F.when(F.col("l_quantity") > 49, "urgent f")).alias("text"))
    return consult.acts_found(heads, lines, None, "urgent f", year=YEAR).select("place", "id", "score", "by_header", "head_pos", "lexical_pos", "header_id", "title", "day")


YEAR = 1995


def q_law_priority(spark, d):
    """Orders as blocks, their status as the law, in the order of priority of laws; unknown laws last."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("law"), (F.col("o_custkey") % 40).cast("string").alias("article"), F.col("o_orderkey").alias("ordem"))
    return consult.direct(o, ["33", "7"], LAWS, 50).select("place", "id", "law", "score")


def q_natural_order(spark, d):
    """Numbers of articles, '7', '7-A', '10', in their natural order in each group."""
    p = t(spark, d, "part").select("p_partkey", "p_type", F.concat((F.col("p_partkey") % 23 + 1).cast("string"), F.when(F.col("p_partkey") % 3 == 1, "-A").when(F.col("p_partkey") % 3 == 2, "-B").otherwise("")).alias("number"))
    return ordered.renumbered(p, ["p_type"], [*consult.natural("number"), "p_partkey"], "place").select("p_partkey", "number", "place")


def q_did_you_mean(spark, d):
    """Every 50th part's name with two letters exchanged, against all names."""
    p = t(spark, d, "part")
    asked = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("query"))
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("name_id"))
    return consult.did_you_mean(asked, names)


def q_first_shown(spark, d):
    return consult.revealed(t(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 60, 2).select("o_orderkey")


def q_visible_rows(spark, d):
    """Open orders for all, the others for their customer."""
    return consult.visible(t(spark, d, "orders"), 7, F.col("o_orderstatus") == "O", "o_custkey").select("o_orderkey")


def q_visible_children(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return consult.visible_children(li, t(spark, d, "orders"), "o_orderkey", 7, "o_custkey").select("o_orderkey", "l_linenumber")


def q_history_union(spark, d):
    c = t(spark, d, "conversations")
    threads = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.max("turn").alias("last"))
    return consult.history(threads, c, "the", "conv_id", "title", "text", "last").select("conv_id", "last")


def q_fallback_answer(spark, d):
    """What can be said of the first hits without a model; documents stand for blocks."""
    hits = run(spark, d).select(F.lit(1).alias("query_id"), "place", "id", F.concat(F.lit("doc. "), "id").alias("citation"), "term", "role")
    view = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "partial").otherwise("whole").alias("coverage"), (F.col("doc_id") % 11 == 0).alias("revoked"), F.lit("2025-01-31").cast("date").alias("day"))
    out = consult.answer_from_facts(consult.enriched(hits, view))
    return out.select(F.element_at("paragraphs", 1).alias("opening"), F.element_at("paragraphs", 2).alias("state"), F.size("sources").alias("n"), F.element_at("followups", 1).alias("follow"))


INDEXED = "idiot pathetic"


def q_index_lookup(spark, d):
    """Documents with all words of a question, from the rows of the written index."""
    own = index_of(spark, d)
    rows = written.occurrences(own, *own.state()[2:], INDEXED.split())
    hit = rows.groupBy("id").agg(F.count("*").alias("words"), F.round(F.sum(search.TITLE * F.col("t") + search.BODY * F.col("b")), 6).alias("weight"), F.sum(F.size("at")).alias("places"))
    return hit.where("words = 2").drop("words")


# --- curation ---------------------------------------------------------------------------------------


def numbered(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.expr("doc_id div 10").alias("article"), F.col("doc_id").alias("pos"))


def q_curated_notes(spark, d):
    """Documents of every 40th key have their first line as an editor's note; it goes from the text."""
    docs = numbered(spark, d).where("length(text) > 0")
    notes = docs.where("id % 40 = 0").select("id", F.substring_index("text", "\n", 1).alias("remove"))
    out, _ = curation.without_notes(docs, notes)
    return out.where("id % 40 = 0").select("id", F.md5(out["text"].cast("binary")).alias("text"))


def q_curated_merge(spark, d):
    """Documents of every 7th key are no blocks: their text goes to the one before, ten documents being an article."""
    docs = numbered(spark, d)
    fixes = docs.where("id % 7 = 0 AND id % 10 > 0 AND length(text) > 0").select("id", F.substring(F.ltrim("text"), 1, 5).alias("begins"), F.lit("no block").alias("reason"))
    out, _ = curation.merged_back(docs, fixes)
    return out.select("id", F.length("text").alias("length"))


def q_curated_rewording(spark, d):
    docs = numbered(spark, d)
    words = docs.where("id % 9 = 0").select("id", F.col("text").alias("was"), F.concat(F.lit("new "), "text").alias("becomes"), F.array(F.lit("Lei 1/2025")).alias("norms"))
    _, log = curation.replaced(docs, words)
    return log.select("id", "rule", (F.length("after") - F.length("before")).alias("more"), "reason")


LINES = ["§ 1o Texto um;", "I - item um", "a) letra", "b) outra", "IV – item quatro", "§ 2º-A. Texto", "II - item dois", "Parágrafo único. Fim", "a) sem item", "sem marca", "§ 12 Longo"]


def q_block_addresses(spark, d):
    """Every document as an article of the same lines, of which the last has the document's first line."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("article"), F.concat(F.lit("§ 12 "), F.coalesce(F.trim(F.substring_index("text", "\n", 1)), F.lit(""))).alias("own"))
    rows = docs.select("article", F.posexplode(F.concat(F.array(*map(F.lit, LINES[:-1])), F.array("own"))).alias("n", "text"))
    return blocks.addressed(rows, "article", ["n"]).select("article", "n", "kind", "label", "suffix", F.md5(F.col("body").cast("binary")).alias("body"))


def q_inline_enumeration(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("; II - and more"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("a) one "), "text")).otherwise(F.col("text")).alias("x"))
    return rows.select("doc_id", blocks.inline_enumeration("x").alias("inside"))


NOTES = ["Art. 1º Texto. (Redação dada pela Lei nº #, de 2020) (Vide Lei 2)", "II - (Revogado)", "sem nota (mas com parênteses)", "(Incluído pela Lei nº 3, de 2021)"]


def q_annotations(spark, d):
    return dealt(spark, d, NOTES).select("n", F.array_join(blocks.annotations("x"), "|").alias("notes"), blocks.without_annotations("x").alias("text"))


def q_act_pages(spark, d):
    """Pages whose third paragraph begins an article: title, year, lines before it, and blocks."""
    p = t(spark, d, "pages").select("page_id", F.concat(F.lit("<h1>DECRETO 12, de 2021</h1><p>O governo decreta"), F.lit("<p>Art. 1º "), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), F.lit("<p>Art. 2º Fim")).alias("html"))
    return blocks.acts(p).select("page_id", "title", "year", "preamble", "pos")


# --- reports -----------------------------------------------------------------------------------------


def q_rule_samples(spark, d):
    li = t(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 45, "many").when(F.col("l_discount") > 0.08, "cheap").alias("rule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).where("rule IS NOT NULL")
    return reports.samples(li, most=5).select("rule", "n", F.array_join("sample", ",").alias("sample"))


def q_template_pieces(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.concat(F.lit("see {{cite:"), F.col("item_id").cast("string"), F.lit("}} and {{cite:"), (F.col("item_id") + 1).cast("string"), F.lit("}}{{cite:7}} end")).alias("template"), F.lit(None).cast("array<string>").alias("grounds"))
    blocks_ = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    return reports.resolved(b, blocks_, "item_id").select("item_id", "pos", "kind", "value", "source")


def q_law_report(spark, d):
    """Two snapshots of documents; ten are an article, and a norm's year follows from the key."""
    from verbatlas.operators.compare import compared

    base = t(spark, d, "documents").where("text IS NOT NULL")
    art = F.concat(F.lit("art"), F.expr("doc_id div 10").cast("string"))
    corpus = base.where("doc_id % 11 <> 0 AND doc_id div 10 % 9 <> 4").select(F.col("doc_id").alias("id"), "text", art.alias("article"))
    source = base.where("doc_id % 13 <> 0 AND doc_id div 10 % 12 <> 5").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" new"))).otherwise(F.col("text")).alias("text"), F.col("doc_id").alias("ordem"), F.expr("doc_id div 100").alias("parent"), art.alias("article"), F.array((2020 + F.col("doc_id") % 10).cast("int")).alias("years"))
    return reports.law_report(compared(corpus, source), source, corpus, 2025).groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("article").alias("articles"))


def q_confirmations(spark, d):
    o = t(spark, d, "orders")
    found = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("norm"), F.col("o_orderkey").alias("first"))
    details = t(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("norm"), F.col("c_nationkey").alias("day"))
    a = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("norm"), F.col("c_nationkey").alias("day"), F.concat(F.lit("a/"), "c_custkey").alias("url"), F.lit("A").alias("place"))
    b = t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("norm"), F.col("c_nationkey").alias("day"), F.concat(F.lit("b/"), "c_custkey").alias("url"), F.lit("B").alias("place"))
    return reports.confirmed(found, details, a, b).select("norm", "first", "url", "place", "asked")


def q_link_check(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 6 == 0, 404).when(F.col("page_id") % 10 == 5, None).otherwise(200).alias("status"), F.concat("html", F.when(F.col("page_id") % 4 == 0, F.lit("Lei 12.850")).when(F.col("page_id") % 4 == 1, F.lit("Lei 12850")).otherwise("")).alias("body"), F.lit(12850).alias("number"))
    return reports.unlinked(p)


def q_counts_for(spark, d):
    """Landed events counted for wanted pairs of type and day's hour; pairs without any count 0."""
    e = t(spark, d, "events").select("event_type", F.hour("ts").alias("hour"))
    params = spark.range(1).select(F.explode(F.array(*map(F.lit, ["click", "error", "nothing"]))).alias("event_type")).select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return reports.counts_for(params, e, ["event_type", "hour"])


def q_with_details(spark, d):
    o = t(spark, d, "orders")
    details = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").alias("seen"))
    last = details.withColumn("seen", F.struct("seen", "o_orderkey"))
    return reports.with_details(t(spark, d, "customer").select("c_custkey"), last, "c_custkey").select("c_custkey", "o_orderkey")


def q_replaced_groups(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = li.where("l_orderkey % 5 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.lit(0.0))
    out = merge.replaced_groups(li, new, ["l_orderkey"])
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


# --- displays -----------------------------------------------------------------------------------------


def q_shown_values(spark, d):
    o = t(spark, d, "orders")
    shown = display.published("o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, 1990).otherwise(F.year("o_orderdate")))
    return o.select("o_orderkey", shown["text"].alias("day"), shown["differs"].alias("differs"), display.number_br(F.floor("o_totalprice")).alias("price"), display.article_title(F.concat((F.col("o_orderkey") % 14 + 1).cast("string"), F.lit("-A"))).alias("title"))


STATUS = ["Cancelado", " sobrestado pelo tema 5", "Em julgamento", "Trânsito em julgado", "REVISADA", "Acórdão publicado", "afetado"]


def q_needs_care(spark, d):
    return dealt(spark, d, STATUS).select("n", display.needs_care("x").alias("care"))


def q_draft_objections(spark, d):
    """Drafts made of customers, each with one fault by its key."""
    c, k = t(spark, d, "customer"), F.col("c_custkey") % 8
    cpf = F.when(k == 2, "123").when(k == 3, "11111111112").when(k == 7, "529.982.247-25").otherwise("")
    drafts = c.select("c_custkey", F.when(k == 0, " ").when(k == 1, F.repeat("c_name", 9)).otherwise(F.col("c_name")).alias("name"), cpf.alias("cpf"), F.when(k == 4, "12345").otherwise("12345678").alias("phone"), F.when(k == 5, "a@b").otherwise("a@b.c").alias("email"), F.when(k == 6, F.repeat(F.lit("x"), 2001)).alias("note"))
    e = display.first_objection()
    return drafts.select("c_custkey", e["field"].alias("field"))


def q_foreign_ids(spark, d):
    docs = t(spark, d, "documents").select(F.concat(F.lit("doc_"), F.when(F.col("doc_id") % 100 == 0, "x").otherwise(""), F.col("doc_id")).alias("id"))
    return reports.foreign_ids(docs, "id", "^doc_[0-9]+$")


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SQL = {
    "q_enriched_hits": f"SELECT place, id, score, source, lang, n_chars, DATE '2025-01-31' AS snapshot FROM ({hybrid_sql()}) h JOIN documents ON doc_id = id",
    "q_decree_floor": f"""WITH h AS ({hybrid_sql('the and that', most=60)}), s AS (SELECT *, score > {round(1 / 61, 6)} AS strong FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY strong ORDER BY place) AS n, NOT bool_or(strong) OVER () AS weak FROM s)
      SELECT id, place, score, weak FROM n WHERE CASE WHEN weak THEN n <= 2 ELSE strong AND n <= 4 END""",
    "q_decree_order": """SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY starts_with(o_orderpriority, '1') DESC, round(o_totalprice / 100000, 0) DESC, o_orderdate::DATE DESC, o_orderkey % 7, o_orderkey) AS place FROM orders""",
    "q_acts_found": f"""WITH o AS (SELECT * FROM orders WHERE year(o_orderdate) = {YEAR}),
      l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS k, l_linenumber AS n, l_quantity > 49 AS u, (l_returnflag = 'F')::INT AS f FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
      h AS (SELECT k.id, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM o WHERE starts_with(o_orderpriority, '1') AND o_orderstatus = 'F' QUALIFY pos <= 200) JOIN (SELECT k, min_by(id, n) AS id FROM l GROUP BY 1) k ON k = o_orderkey),
      x AS (SELECT id, row_number() OVER (ORDER BY {search.BODY} * (2 + f) DESC, id) AS pos FROM l WHERE u QUALIFY pos <= 200),
      s AS (SELECT coalesce(h.id, x.id) AS id, round(coalesce(2.0 / (60 + h.pos), 0) + coalesce(1.0 / (60 + x.pos), 0), 6) AS score, h.pos AS head_pos, x.pos AS lexical_pos FROM h FULL JOIN x ON h.id = x.id)
      SELECT row_number() OVER (ORDER BY head_pos IS NOT NULL DESC, score DESC, o_orderdate::DATE DESC, n, s.id) AS place, s.id, score, head_pos IS NOT NULL AS by_header, head_pos, lexical_pos, k AS header_id,
        o_orderpriority || ' ' || o_orderstatus AS title, o_orderdate::DATE AS day FROM s JOIN l ON l.id = s.id JOIN o ON o_orderkey = k QUALIFY place <= 40""",
    "q_law_priority": """SELECT row_number() OVER (ORDER BY p, id) AS place, id, law, 0.0::DOUBLE AS score FROM (
      SELECT o_orderkey AS id, o_orderstatus AS law, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS p FROM orders WHERE o_custkey % 40 IN (33, 7) ORDER BY p, id LIMIT 50)""",
    "q_natural_order": """WITH p AS (SELECT p_partkey, p_type, p_partkey % 23 + 1 AS b, CASE p_partkey % 3 WHEN 1 THEN '-A' WHEN 2 THEN '-B' ELSE '' END AS s FROM part)
      SELECT p_partkey, b || s AS number, row_number() OVER (PARTITION BY p_type ORDER BY b, s, p_partkey) AS place FROM p""",
    "q_did_you_mean": f"""WITH q AS (SELECT p_partkey AS query_id, {GRAMS.format("p_name[2:2] || p_name[1:1] || p_name[3:]")} AS g FROM part WHERE p_partkey % 50 = 0),
      n AS (SELECT min(p_partkey) AS name_id, {GRAMS.format('p_name')} AS g FROM part GROUP BY p_name),
      m AS (SELECT query_id, name_id, len(list_intersect(q.g, n.g)) AS s, len(q.g) AS a, len(n.g) AS b FROM q, n),
      l AS (SELECT query_id, name_id, round(s / (a + b - s), 6) AS likeness FROM m WHERE s > 0)
      SELECT query_id, name_id, likeness, row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, name_id) AS rank FROM l WHERE likeness >= 0.3 QUALIFY rank <= 3""",
    "q_first_shown": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 120",
    "q_visible_rows": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_custkey = 7",
    "q_visible_children": "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)",
    "q_history_union": "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 HAVING bool_or(contains(strip_accents(lower(text)), 'the'))",
    "q_fallback_answer": f"""WITH h AS (SELECT place, id, term, id % 3 = 0 AS partial, id % 11 = 0 AS revoked FROM ({hybrid_sql(ASK)})), f AS (SELECT * FROM h WHERE place = 1)
      SELECT CASE WHEN f.term IS NOT NULL THEN '“' || f.term || '” is a curated term; it leads to doc. ' || f.id || '.' ELSE n || ' blocks were found; the first is doc. ' || f.id || '.' END AS opening,
        'The text is of 31/01/2025.' || CASE WHEN p > 0 THEN ' ' || p || ' of a law that is partly covered.' ELSE '' END || CASE WHEN r > 0 THEN ' ' || r || ' revoked.' ELSE '' END AS state, n,
        CASE WHEN f.term IS NOT NULL THEN 'Other blocks of “' || f.term || '”' ELSE 'The whole text of doc. ' || f.id END AS follow
      FROM f, (SELECT count(*)::INT AS n, count(*) FILTER (WHERE partial) AS p, count(*) FILTER (WHERE revoked) AS r FROM h)""",
    "q_index_lookup": f"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(split_part(text, chr(10), 1))), '[^a-z0-9]+'), lambda x: x <> '')) AS w, {search.TITLE} AS k FROM documents
      UNION ALL SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: x <> '')), {search.BODY} FROM documents)
      SELECT id, round(sum(k), 6)::DOUBLE AS weight, count(*) AS places FROM w WHERE w IN ('idiot', 'pathetic') GROUP BY 1 HAVING count(DISTINCT w) = 2""",
    "q_curated_notes": r"SELECT doc_id AS id, md5(trim(regexp_replace(replace(text, split_part(text, chr(10), 1), ''), '\s{2,}', ' ', 'g'), ' ')) AS text FROM documents WHERE doc_id % 40 = 0 AND length(text) > 0",
    "q_curated_merge": """WITH b AS (SELECT doc_id, text, doc_id // 10 AS a, doc_id % 7 = 0 AND doc_id % 10 > 0 AND length(text) > 0 AS f FROM documents WHERE text IS NOT NULL),
      r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY a ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
      SELECT min(doc_id) AS id, length(string_agg(CASE WHEN f THEN trim(text, ' ') ELSE text END, ' ' ORDER BY doc_id))::INT AS length FROM r GROUP BY a, run""",
    "q_curated_rewording": "SELECT doc_id AS id, 'rewording' AS rule, 4 AS more, 'worded by Lei 1/2025' AS reason FROM documents WHERE doc_id % 9 = 0 AND text IS NOT NULL",
    "q_block_addresses": """SELECT * FROM (VALUES (0, 'paragrafo', '§ 1º', '_p1', 'Texto um;'), (1, 'inciso', 'I', '_p1_inc1', 'item um'), (2, 'alinea', 'a)', '_p1_inc1_ala', 'letra'), (3, 'alinea', 'b)', '_p1_inc1_alb', 'outra'),
      (4, 'inciso', 'IV', '_p1_inc4', 'item quatro'), (5, 'paragrafo', '§ 2º-A', '_p2-a', 'Texto'), (6, 'inciso', 'II', '_p2-a_inc2', 'item dois'), (7, 'paragrafo', 'Parágrafo único', '_pu', 'Fim'), (8, 'alinea', 'a)', '_ala', 'sem item'),
      (9, NULL, NULL, NULL, NULL), (10, 'paragrafo', '§ 12', '_p12', 'Longo')) v(n, kind, label, suffix, body)""",
    "q_inline_enumeration": r"""SELECT doc_id, coalesce(regexp_matches(x, '(?:^|[;:.]\s)\s*(?:[IVXLC]{1,7}\s*[-–—]\s+|[a-z]\s*\)\s)'), FALSE) AS inside FROM (
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || '; II - and more' WHEN 1 THEN 'a) one ' || text ELSE text END AS x FROM documents)""",
    "q_annotations": """SELECT * FROM (VALUES (0, '(Redação dada pela Lei nº #, de 2020)|(Vide Lei 2)', 'Art. 1º Texto.'), (1, '(Revogado)', 'II -'), (2, '', 'sem nota (mas com parênteses)'), (3, '(Incluído pela Lei nº 3, de 2021)', '')) v(n, notes, text)""",
    "q_act_pages": "SELECT page_id, 'DECRETO 12, de 2021' AS title, 2021 AS year, 'O governo decreta' AS preamble, unnest([1, 2]) AS pos FROM pages",
    "q_rule_samples": """WITH f AS (SELECT CASE WHEN l_quantity > 45 THEN 'many' WHEN l_discount > 0.08 THEN 'cheap' END AS rule, l_orderkey * 10 + l_linenumber AS key FROM lineitem)
      SELECT rule, max(n) AS n, string_agg(key::VARCHAR, ',' ORDER BY key) AS sample FROM (SELECT *, count(*) OVER (PARTITION BY rule) AS n, row_number() OVER (PARTITION BY rule ORDER BY key) AS k FROM f WHERE rule IS NOT NULL) WHERE k <= 5 GROUP BY 1""",
    "q_template_pieces": """WITH p AS (SELECT item_id, unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest(['prose', 'cite', 'prose', 'cite', 'cite', 'prose']) AS kind, unnest(['see', item_id::VARCHAR, 'and', (item_id + 1)::VARCHAR, '7', 'end']) AS value FROM benchmark)
      SELECT item_id, pos, kind, value, source FROM p LEFT JOIN documents ON kind = 'cite' AND doc_id::VARCHAR = value""",
    "q_law_report": """WITH b AS (SELECT doc_id, doc_id // 10 AS a, doc_id % 11 <> 0 AND doc_id // 10 % 9 <> 4 AS c, doc_id % 13 <> 0 AND doc_id // 10 % 12 <> 5 AS s, 2020 + doc_id % 10 AS y FROM documents WHERE text IS NOT NULL),
      x AS (SELECT *, CASE WHEN s AND NOT c THEN 'add' WHEN c AND NOT s THEN 'gone' WHEN c AND s AND doc_id % 5 = 0 THEN 'change' END AS v, bool_or(c) OVER (PARTITION BY a) AS known, bool_or(s) OVER (PARTITION BY a) AS there FROM b),
      l AS (SELECT CASE WHEN v = 'add' AND NOT known AND y >= 2025 THEN 'new article' WHEN v <> 'gone' AND y >= 2025 THEN 'changed' ELSE 'no norm' END AS list, a FROM x WHERE v IS NOT NULL AND there
        UNION ALL SELECT DISTINCT 'not found', a FROM x WHERE c AND NOT there)
      SELECT list, count(*) AS n, count(DISTINCT a) AS articles FROM l GROUP BY 1""",
    "q_confirmations": """WITH f AS (SELECT o_custkey AS norm, o_orderkey AS first FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT norm, min(first) AS m FROM f GROUP BY 1 ORDER BY m, norm LIMIT 12),
      a AS (SELECT norm, CASE WHEN norm % 3 = 0 THEN 'a/' || norm WHEN norm % 5 <> 0 THEN 'b/' || norm END AS url, CASE WHEN norm % 3 = 0 THEN 'A' WHEN norm % 5 <> 0 THEN 'B' END AS place FROM n WHERE norm % 4 <> 0)
      SELECT f.norm, first, url, place, a.norm IS NOT NULL AS asked FROM f LEFT JOIN a USING (norm)""",
    "q_link_check": """SELECT page_id AS id, CASE WHEN page_id % 6 = 0 THEN 'status 404' WHEN page_id % 10 = 5 THEN 'status none' ELSE 'the number isn''t named' END AS problem FROM pages
      WHERE page_id % 6 = 0 OR page_id % 10 = 5 OR (page_id % 4 > 1 AND NOT contains(html, '12850') AND NOT contains(html, '12.850'))""",
    "q_counts_for": """WITH p AS (SELECT unnest(['click', 'error', 'nothing']) AS event_type), q AS (SELECT event_type, unnest(range(24))::INT AS hour FROM p)
      SELECT q.event_type, q.hour, count(e.event_id) AS n FROM q LEFT JOIN events e ON e.event_type = q.event_type AND hour(e.ts) = q.hour GROUP BY 1, 2""",
    "q_with_details": "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "q_replaced_groups": """SELECT l_orderkey, count(*) AS n, sum(q) AS q FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND has THEN 0 ELSE l_quantity END AS q
      FROM (SELECT *, bool_or(l_linenumber = 1) OVER (PARTITION BY l_orderkey) AS has FROM lineitem) WHERE NOT (l_orderkey % 5 = 0 AND has) OR l_linenumber = 1) GROUP BY 1""",
    "q_shown_values": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, year(o_orderdate) <> CASE WHEN o_orderkey % 3 = 0 THEN 1990 ELSE year(o_orderdate) END AS differs,
      replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS price, 'Art. ' || (o_orderkey % 14 + 1) || CASE WHEN o_orderkey % 14 + 1 <= 9 THEN 'º' ELSE '' END || '-A' AS title FROM orders""",
    "q_needs_care": "SELECT * FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, FALSE), (4, TRUE), (5, FALSE), (6, TRUE)) v(n, care)",
    "q_draft_objections": "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'cpf' WHEN 3 THEN 'cpf' WHEN 4 THEN 'phone' WHEN 5 THEN 'email' WHEN 6 THEN 'note' END AS field FROM customer",
    "q_foreign_ids": "SELECT 'doc_x' || doc_id AS id FROM documents WHERE doc_id % 100 = 0",
}
SQL["q_annotations"] = dealt_sql(SQL["q_annotations"], NOTES, filled=("notes", "text"))
SQL["q_needs_care"] = dealt_sql(SQL["q_needs_care"], STATUS)
SQL["q_block_addresses"] = f"""SELECT doc_id AS article, n, kind, label, suffix, md5(CASE WHEN n = 10 THEN coalesce(trim(split_part(text, chr(10), 1), ' '), '') ELSE body END) AS body
      FROM documents, ({SQL['q_block_addresses']})"""

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
