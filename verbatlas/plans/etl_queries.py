"""Writing, checking and cleaning: merges, integrity, comparisons, text rules, pages, answers, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions import blocks, html, markup, text
from verbatlas.operators import acts, answers, compare, integrity, intent, merge, sentence
from verbatlas.plans.search_queries import t
from verbatlas.sources import readers


def digit(key: Column, count: int) -> Column:
    """One of the digits 1 to 9 by a key, independent of the key's remainder by ``count``."""
    return (F.floor(key / count) % 9 + 1).cast("string")


def dealt(spark, d, values: list[str], name: str = "x") -> DataFrame:
    """(n, x): every order's key, with one of the texts by its remainder; # in a text becomes a digit of the key."""
    k = F.col("o_orderkey")
    text = F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    return t(spark, d, "orders").select(k.alias("n"), F.replace(text, F.lit("#"), digit(k, len(values))).alias(name))


def dealt_sql(sql: str, values: list, n: str = "n", filled: tuple[str, ...] = ()) -> str:
    """The rows of ``sql``, which has a row, or several, for the number of each text, for every order; # in the columns ``filled`` is its digit."""
    d = f"(o.o_orderkey // {len(values)} % 9 + 1)::VARCHAR"
    put = f" REPLACE ({', '.join(f'replace({c}, chr(35), {d}) AS {c}' for c in filled)})" if filled else ""
    return f"SELECT o.o_orderkey AS {n}, v.* EXCLUDE ({n}){put} FROM orders o JOIN ({sql}) v ON v.{n} = o.o_orderkey % {len(values)}"


def sql_list(values: list[str]) -> str:
    return ", ".join(f"({i}, '{v.replace(chr(39), chr(39) * 2)}')" for i, v in enumerate(values))


# --- merges --------------------------------------------------------------------------------------


def old_new(spark, d):
    e = t(spark, d, "labels").select("doc_id", "quality", "toxic")
    old = e.where("doc_id % 3 <> 0")
    new = e.where("doc_id % 3 <> 1").select("doc_id", (F.col("quality") + 10).alias("quality"), "toxic")
    return old, new


def q_merge_upsert(spark, d):
    old, new = old_new(spark, d)
    return merge.upsert(old, new, ["doc_id"], keep=("toxic",))


def q_merge_twice(spark, d):
    old, new = old_new(spark, d)
    return merge.upsert(merge.upsert(old, new, ["doc_id"]), new, ["doc_id"])


def q_merge_hash_gate(spark, d):
    docs = t(spark, d, "documents")
    vec = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    old = docs.join(vec, "doc_id", "left").select("doc_id", text.sha256("text").alias("h"), "label")
    new = docs.where("doc_id % 7 <> 0").select("doc_id", text.sha256(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"), F.lit(None).cast("int").alias("label"))
    return merge.upsert_gated(old, new, ["doc_id"], "h", "label").select("doc_id", "label")


def q_anti_delete(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merge.pruned(o, o.where("o_orderkey % 4 <> 0"), "o_orderkey", F.col("o_orderstatus") == "F")


def q_removed(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return merge.removed(o, o.where("o_orderkey % 4 <> 0"), "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey")


def q_new_keys(spark, d):
    old, new = old_new(spark, d)
    return merge.new_keys(old, new, ["doc_id"]).select("doc_id")


def q_set_from_arrays(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    arrays = spark.range(1).select(F.array(*[F.lit(k).cast("long") for k in (1, 5, 9)]).alias("ids"), F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("vs"))
    return merge.set_from_arrays(c, "c_custkey", "c_acctbal", arrays, "ids", "vs")


def q_promoted(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("became"), F.when(F.col("o_orderstatus") == "F", "Lei 1/1990").alias("norm"))
    latest = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "Lei 2/1991").alias("norm"))
    return merge.promoted(o, latest, "o_orderkey", "became", "norm")


# --- integrity and comparison ---------------------------------------------------------------------


def q_constraints_report(spark, d):
    li = t(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    rules = {"few": F.col("l_quantity") <= 49, "cheap": F.col("l_discount") < 0.1, "flag": F.col("l_returnflag").isin("A", "N", "R"), "open late": (F.col("l_linestatus") != "O") | (F.year("l_shipdate") > 1993)}
    return integrity.broken_rules(li, "id", rules).groupBy("rule").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("first"))


def q_repeated_keys(spark, d):
    li = t(spark, d, "lineitem")
    return integrity.repeated_keys(li, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")


def q_dangling(spark, d):
    e, c = t(spark, d, "events"), t(spark, d, "customer").where("c_custkey % 10 <> 3")
    return integrity.dangling(e, c, {"user_id": "c_custkey"}).groupBy("user_id").agg(F.count("*").alias("n"))


def q_anti_array_fk(spark, d):
    """Arrays of part keys against parts with a price below 1000."""
    p = t(spark, d, "part").where("p_partkey % 3 <> 1")
    items = F.array((F.col("o_orderkey") % 2000).cast("string"), (F.col("o_orderkey") * 7 % 2000).cast("string"))
    return integrity.dangling_items(t(spark, d, "orders"), "o_orderkey", items, p, "p_partkey")


def q_marker_fk(spark, d):
    """Markers in templates made of benchmark items, against the documents with an even id."""
    b = t(spark, d, "benchmark").select("item_id", F.concat(F.lit("see {{cite:"), F.col("item_id").cast("string"), F.lit("}} and {{cite:"), (F.col("item_id") * 2).cast("string"), F.lit("}} {{cite:x-1}}")).alias("template"))
    targets = t(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return integrity.dangling_items(b, "item_id", integrity.markers("template"), targets, "id")


def q_corpus_diff(spark, d):
    base = t(spark, d, "documents")
    corpus = base.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), "text")
    # every nineteenth source text has its accents apart, as some publishers write them: no change
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    words = F.when(F.col("doc_id") % 19 == 0, apart).otherwise(F.col("text"))
    source = base.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 == 0, F.concat(words, F.lit(" new"))).otherwise(words).alias("text"), F.col("doc_id").alias("ordem"), F.expr("doc_id div 100").alias("parent"))
    return compare.compared(corpus, source)


def q_status_transition(spark, d):
    o = t(spark, d, "orders")
    old = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("status"))
    return compare.transitions(old, new, "o_orderkey", "status", ["F"])


# --- text ---------------------------------------------------------------------------------------


def q_sha256_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", text.sha256(text.embedding_text(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"))).alias("h"))


def q_slug(spark, d):
    return t(spark, d, "pages").select("page_id", text.slug("url").alias("slug"))


def lines(spark, d):
    """(doc_id, pos, line) of all documents' whole texts."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def q_clean_ordinals(spark, d):
    """Every line, of which some are made to announce an act or an ordinal."""
    head = F.when(F.col("pos") % 5 == 0, "Art. 1o da Lei no 9.099, no 1º grau ").when(F.col("pos") % 5 == 1, "§ 2° do Decreto no 12.848, nos termos do no 1.234 ").otherwise("")
    x, n = text.ordinals("line")
    made = lines(spark, d).select("doc_id", "pos", F.concat(head, "line").alias("line"))
    return made.select("doc_id", "pos", F.md5(x.cast("binary")).alias("cleaned"), n.alias("places"))


def q_clean_footnotes(spark, d):
    x, n = text.without_footnote("line")
    made = lines(spark, d).select("doc_id", "pos", F.concat("line", F.when(F.col("doc_id") % 2 == 0, "3").otherwise("")).alias("line"))
    return made.select("doc_id", "pos", F.md5(x.cast("binary")).alias("line"), n.alias("removed"))


TITLES = ["Pena suspensa. Fixação da pena", "art. 3# da lei. Pena - reclusão", "fica em vigor. Disposições Gerais.", "do crime; Dano em coisa de valor artístico", "só isto", "prescrição.4 Modo de conversão", "efeito. PARTE ESPECIAL"]


def q_marginal_title(spark, d):
    body, title, against = text.marginal_title("x")
    rest, division = text.trailing_division("x")
    return dealt(spark, d, TITLES).select("n", body.alias("body"), title.alias("title"), F.array_join(against, ",").alias("against"), rest.alias("rest"), division.alias("division"))


HEADINGS = [
    "CAPÍTULO III – Da Aplicação da Pena Fixação da pena", "Seção II Das Disposições Gerais", "TÍTULO I – Dos Crimes contra a Pessoa Homicídio simples", "CAPÍTULO I – Do Furto Furto",
    "CAPÍTULO II – Dos Crimes contra o Respeito aos Mortos", "CAPÍTULO V – Dos Crimes contra a Honra Calúnia", "SEÇÃO # - Da Prova", "TÍTULO IX-A – Das Penas Penas",
]


def q_heading_split(spark, d):
    h = text.heading_split("x")
    return dealt(spark, d, HEADINGS).select("n", h["heading"].alias("heading"), h["title"].alias("title"), h["rule"].alias("rule"))


#: The digits of Roman numerals, from units to thousands.
ROMAN_DIGITS = [["", *x.split()] for x in ("I II III IV V VI VII VIII IX", "X XX XXX XL L LX LXX LXXX XC", "C CC CCC CD D DC DCC DCCC CM", "M MM MMM")]


def q_roman(spark, d):
    """Every order's key modulo 4,000, written in Roman digits and read again; 0 is written as nothing, and some numerals have a letter too many."""
    k = F.col("o_orderkey") % 4000
    numeral = F.concat(*[F.get(F.array(*map(F.lit, xs)), (F.floor(k / 10**i) % 10).cast("int")) for i, xs in reversed([*enumerate(ROMAN_DIGITS)])])
    numeral = F.when(k % 7 == 0, F.lower(numeral)).when(k % 11 == 0, F.concat(numeral, F.lit("z"))).otherwise(numeral)
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("n"), text.roman_value(numeral).alias("value"))


LABELS = ["§ #º", "§ 1#", "§ #º-A", "Parágrafo único", "x"]


def q_paragraph_labels(spark, d):
    p = text.paragraph("x")
    return dealt(spark, d, LABELS).select("n", p["number"].alias("number"), p["suffix"].alias("suffix"), p["label"].alias("label"))


def q_text_differences(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    x = text.difference(F.col("a"), F.concat(F.substring("a", 1, 20), F.lit("##"), F.substring(F.col("a"), F.lit(25), F.length("a"))))
    return docs.select("doc_id", F.length(x["prefix"]).alias("prefix"), F.length(x["old"]).alias("old"), F.length(x["new"]).alias("new"), F.length(x["suffix"]).alias("suffix"))


def q_suspicions(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("s"))
    return docs.select("doc_id", F.explode(text.suspicions("s")).alias("doubt")).groupBy("doubt").agg(F.count("*").alias("n"))


def q_lexeme_counts(spark, d):
    words = t(spark, d, "documents").select(F.explode(text.lexemes("text")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where("n >= 200")


# --- monitoring ----------------------------------------------------------------------------------

TARGETS = {"lei_11343_2006": "11\\.?343|lei de drogas|lei antidrogas", "dl_2848_1940": "\\b2\\.848|codigo penal(?! militar)"}
SUMMARIES = [
    "Altera o art. 3# da Lei nº 11.343, de 2006", "Altera os arts. 33, 35 e 40 da Lei de Drogas", "Institui a semana do livro",
    "Altera a Lei nº 12.848, de 2013", "Altera o Código Penal e a Lei nº 11.343", "Revoga o art. 359-L do Decreto-Lei nº 2.848", "Altera o Código Penal Militar",
]


def q_change_filter(spark, d):
    targets = compare.targets_of("x", TARGETS)
    rows = dealt(spark, d, SUMMARIES).select("n", "x", targets.alias("found"))
    return rows.select("n", F.array_join("found", ",").alias("targets"), F.array_join(compare.articles_of("x", F.col("found")), ",").alias("articles"))


STATUSES = ["Transformada na Lei nº 15.16# de 14/07/2025", "Aguardando parecer", "Convertida na Lei Complementar 200, de 2023", "Norma jurídica gerada: Decreto-Lei nº 2.848, de 1940"]


def q_norm_named(spark, d):
    return dealt(spark, d, STATUSES).select("n", compare.became_norm("x").alias("became"), compare.norm_named("x").alias("norm"))


OPENINGS = [
    "Regulamenta a Lei de segurança pública", "Institui o conselho de Defesa Civil", "Fica instituído o plano de segurança", "Altera o código penal", "Prorroga o prazo do plano de segurança",
    "Aprova o regulamento da polícia penal", "Revoga o decreto de segurança", "Homologa situação de emergência, defesa civil", "Declara de utilidade a defesa civil", "Dispõe sobre segurança",
    "Dispõe sobre segurança no trânsito", "Institui a semana do livro",
]


def q_scope_include_exclude(spark, d):
    rows = dealt(spark, d, OPENINGS)
    return rows.where(compare.in_scope("x", "seguranca|defesa civil|penal", "transito")).select("n", intent.species("x").alias("species"))


def q_parsed_dates(spark, d):
    """The days of the orders, written as people and as machines write them, and in forms that are no day."""
    day = F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00")))
    form = form.when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "d/M/yy")).when(F.col("o_orderkey") % 5 == 3, "").otherwise("30/02/2025")
    x = compare.parsed_date("x")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("n"), form.alias("x")).select("n", x.alias("day"), compare.after_cut(x, "1996-01-31").alias("kept"))


# --- pages ---------------------------------------------------------------------------------------


def q_html_text(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2(html.text_of("html").cast("binary"), 256).alias("text"))


def q_html_toc(spark, d):
    """With the items of the menus as second headings, so that two levels occur."""
    return html.headings(t(spark, d, "pages").select("page_id", F.replace(F.replace("html", F.lit("<li>"), F.lit("<h2>")), F.lit("</li>"), F.lit("</h2>")).alias("html")))


def q_html_links(spark, d):
    p = t(spark, d, "pages")
    out = html.links(p).join(p.select("page_id", "url"), "page_id")
    return out.select("page_id", "pos", html.absolute("url", "href").alias("target"), "label")


def q_html_blocks(spark, d):
    return html.blocks(t(spark, d, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def act_page(last: str):
    """A page of an act made of a page's heading and a digit of its key."""
    d = (F.col("page_id") % 9 + 1).cast("string")
    h = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    return F.concat(
        F.lit("<h1>DECRETO</h1><p>O governo\n decreta<p>Art. 1º "), h, F.lit(" (Redação dada pela\n Lei nº 1.23"), d, F.lit(', de 2020)<br>and more<p>§ 1º Texto (Incluído pela <a href="/l'), d, F.lit('">Lei <span>nº 5.55'), d,
        F.lit("</span>, de 2021</a>)<p>I - item<p>a) letra<p>loose\n text<p>Art. 2º-A Outro (Revogado)<p>II – item (Incluído pela Lei nº 5.55"), d, F.lit(", de 2021)(Incluído pela Lei nº 5.55"), d, F.lit(f", de 2021)<p>{last}"),
    )


def q_page_changes(spark, d):
    p = t(spark, d, "pages").select("page_id", "url", act_page("Parágrafo único. Fim").alias("html"))
    return acts.changes(p, base="url").select("page_id", "article", "verb", "norm", "year", "href")


def q_page_outline(spark, d):
    p = t(spark, d, "pages").select("page_id", act_page("Parágrafo único. Fim").alias("html"))
    return p.select("page_id", F.posexplode(blocks.outline("html")).alias("pos", "b")).select("page_id", "pos", "b.article", "b.suffix", "b.kind", "b.label", F.md5(F.col("b.text").cast("binary")).alias("text"))


def q_sanitised(spark, d):
    """Pages as they may be shown: how many paragraphs, items and links are left, and how many tags that no list has."""
    shown = t(spark, d, "pages").select("page_id", markup.sanitised("html").alias("x"))
    counts = [F.regexp_count("x", F.lit(f"<{k}[ >]")).alias(n) for k, n in (("p", "paragraphs"), ("li", "items"), ("a", "links"))]
    listed = f"</?(?:{'|'.join(markup.TAGS)})[ >]"
    return shown.select("page_id", *counts, (F.regexp_count("x", F.lit("<")) - F.regexp_count("x", F.lit(listed))).alias("unlisted"))


def q_listing_regex(spark, d):
    return readers.listing(t(spark, d, "pages").select("page_id", "html"), '<li><a href="/([^"]*)">([^<]*)</a></li>', {"path": 1, "label": 2})


# --- answers -------------------------------------------------------------------------------------


def q_shingle_overlap(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    items = t(spark, d, "benchmark").select("item_id", "text")
    return answers.copied(docs, items, "doc_id", "item_id")


def q_non_latin(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("conv_id") % 9 == 0, "ж").otherwise("")).alias("text"))
    return c.where(answers.non_latin("text")).select("conv_id", "turn")


ANSWERS = [
    '{"paragraphs":[{"text":"First claim.","citations":[1]},{"text":"Second.","citations":[2]}],"sources":[{"id":1,"doc_id":"a"},{"id":2,"doc_id":"b"}],"confidence":"high","followups":[]}',
    '{"paragraphs":[{"text":"No source.","citations":[]}],"sources":[{"id":1,"doc_id":"z"}],"confidence":"low","followups":[]}',
    '{"paragraphs":[{"text":" ","citations":[]}],"sources":[],"confidence":"low","followups":[]}',
    '{"paragraphs":[{"text":"Orphan жук.","citations":[7]}],"sources":[{"id":1,"doc_id":"a"}]}',
    "not json",
]


def q_answer_validation(spark, d):
    a = dealt(spark, d, ANSWERS, "raw").withColumnRenamed("n", "answer_id")
    retrieved = a.select("answer_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("doc_id"))
    return answers.violations(a, retrieved)


def q_answer_corrections(spark, d):
    return answers.corrections(q_answer_validation(spark, d))


# --- calculators ----------------------------------------------------------------------------------


def q_sentencing(spark, d):
    """Orders as a grid of cases: crime, unfavourable vectors, aggravating facts and causes by arithmetic."""
    o = t(spark, d, "orders")
    crimes = F.array(*map(F.lit, sentence.CRIMES))
    k = F.col("o_orderkey")
    vec = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when((k + i) % (i + 2) == 0, "desf").otherwise("neutra"))
    agg = F.array_compact(F.array(F.when(k % 2 == 0, "reincidencia"), F.when(k % 3 == 0, "menoridade"), F.when(k % 5 == 0, "confissao")))
    causes = F.array_compact(F.array(F.when(k % 4 == 0, "privilegiado"), F.when(k % 6 == 0, "proximidade"), F.when(k % 7 == 0, "tentativa"), F.when(k % 9 == 0, "concurso")))
    s = sentence.sentence(F.get(crimes, (k % len(sentence.CRIMES)).cast("int")), vec, agg, causes)
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.*")


def sentencing_sql() -> str:
    rows = ", ".join(f"({i}, {v[0]}, {v[1]}, {v[2]}, {v[3]}, {2 if v[4] else 0}, {'privilegiado' in v[5]}, {'proximidade' in v[5]}, {'concurso' in v[5]})" for i, v in enumerate(sentence.CRIMES.values()))
    desf = " + ".join(f"CASE WHEN (k + {i}) % {i + 2} = 0 THEN {{}} ELSE 0 END".format(1 if i < 8 else "ninth") for i in range(9))
    count = " + ".join(f"CASE WHEN (k + {i}) % {i + 2} = 0 {'AND ninth > 0' if i == 8 else ''} THEN 1 ELSE 0 END" for i in range(9))
    return f"""WITH c(i, low, high, f0, f1, ninth, priv, prox, conc) AS (VALUES {rows}),
      a AS (SELECT o_orderkey AS k, c.* FROM orders JOIN c ON i = o_orderkey % {len(sentence.CRIMES)}),
      w AS (SELECT *, {desf} AS peso, {count} AS negativos FROM a),
      b AS (SELECT *, least(high::DOUBLE, low + peso * (high - low) / 8.0::DOUBLE) AS base FROM w),
      p1 AS (SELECT *, CASE WHEN k % 2 = 0 THEN base * 7 / 6 ELSE base END AS x FROM b),
      p2 AS (SELECT * EXCLUDE x, CASE WHEN k % 3 = 0 THEN greatest(low, x * 5 / 6) ELSE x END AS x FROM p1),
      p3 AS (SELECT * EXCLUDE x, least(high, CASE WHEN k % 5 = 0 THEN greatest(low, x * 5 / 6) ELSE x END) AS prov FROM p2),
      d AS (SELECT *, prov * CASE WHEN prox AND k % 6 = 0 THEN 7.0::DOUBLE / 6 ELSE 1 END * CASE WHEN conc AND k % 9 = 0 THEN 4.0::DOUBLE / 3 ELSE 1 END
        * CASE WHEN priv AND k % 4 = 0 THEN 1.0::DOUBLE / 3 ELSE 1 END * CASE WHEN k % 7 = 0 THEN 2.0::DOUBLE / 3 ELSE 1 END AS def FROM p3),
      e AS (SELECT *, floor(def + 0.5 + 1e-9)::INT AS definitiva, floor(least(f1, f0 + peso * (f1 - f0) / 8.0::DOUBLE) + 0.5)::INT AS multa FROM d)
      SELECT k AS o_orderkey, negativos, peso, round(base, 6) AS base, round(prov, 6) AS provisoria, definitiva, multa, definitiva < low AS abaixo,
        CASE WHEN definitiva > 96 THEN 'fechado' WHEN definitiva > 48 THEN 'semiaberto' ELSE 'aberto' END AS regime FROM e"""


def q_cpf(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 71_234_567 % 100_000_000_000).cast("string"), 11, "0").alias("cpf"))
    return c.select("c_custkey", text.cpf_valid("cpf").alias("valid"), text.cpf_masked("cpf").alias("masked"))


QUESTIONS = [
    "réu primário preso com # kg de maconha perto de escola, confessou", "não é reincidente, tráfico privilegiado", "furto de madrugada, tentativa",
    "latrocínio com arma de fogo", "porte para consumo pessoal de drogas", "roubo com comparsa e revólver, reincidente", "associação, 500 gramas",
]


def q_fact_extraction(spark, d):
    q = dealt(spark, d, QUESTIONS).select("n", sentence.read_from("x").alias("r"))
    return q.select("n", "r.crime", F.array_join("r.facts", ",").alias("facts"), "r.grams")


CPF_DIGIT = "CAST(substr(cpf, {}, 1) AS INT)"
CHECK = lambda n: "((" + " + ".join(f"{CPF_DIGIT.format(i + 1)} * {n + 1 - i}" for i in range(n)) + ") * 10 % 11 % 10)"
TEXT_SQL = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<br[^>]*>|</p>|</li>|</h[1-6]>|</div>', chr(10), 'g')"
TEXT_SQL = f"regexp_replace({TEXT_SQL}, '<[^>]*>', ' ', 'g')"


def decoded_sql(x: str) -> str:
    for a, b in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


LINES_SQL = "SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"
SQL = {
    "q_merge_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN quality + 10 ELSE quality END AS quality, toxic FROM labels",
    "q_merge_twice": "SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN quality + 10 ELSE quality END AS quality, toxic FROM labels",
    "q_merge_hash_gate": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN NULL ELSE label END AS label FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "q_anti_delete": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 4 <> 0",
    "q_removed": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0",
    "q_new_keys": "SELECT doc_id FROM labels WHERE doc_id % 3 = 0",
    "q_set_from_arrays": "SELECT c_custkey, CASE c_custkey WHEN 1 THEN 10.0 WHEN 5 THEN 20.0 WHEN 9 THEN 30.0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer",
    "q_promoted": "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS became, CASE WHEN o_orderstatus = 'F' THEN 'Lei 1/1990' WHEN o_orderkey % 3 = 0 THEN 'Lei 2/1991' END AS norm FROM orders",
    "q_constraints_report": """SELECT rule, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS first FROM lineitem, LATERAL (SELECT unnest([
        CASE WHEN l_quantity > 49 THEN 'few' END, CASE WHEN l_discount >= 0.1 THEN 'cheap' END, CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END,
        CASE WHEN l_linestatus = 'O' AND year(l_shipdate) <= 1993 THEN 'open late' END]) AS rule) WHERE rule IS NOT NULL GROUP BY 1""",
    "q_repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) > 1",
    "q_dangling": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) GROUP BY 1",
    "q_anti_array_fk": """SELECT DISTINCT o_orderkey, k::VARCHAR AS item FROM (SELECT o_orderkey, unnest([o_orderkey % 2000, o_orderkey * 7 % 2000]) AS k FROM orders)
      WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 1)""",
    "q_marker_fk": """SELECT DISTINCT item_id, item FROM (SELECT item_id, unnest([item_id::VARCHAR, (item_id * 2)::VARCHAR, 'x-1']) AS item FROM benchmark)
      WHERE item NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 2 = 0)""",
    "q_corpus_diff": """WITH b AS (SELECT *, doc_id % 11 <> 0 AS c, doc_id % 13 <> 0 AS s FROM documents),
      a AS (SELECT *, max(CASE WHEN c AND s THEN doc_id END) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b WHERE s)
      SELECT doc_id AS id, CASE WHEN NOT c THEN 'add' ELSE 'change' END AS verdict, CASE WHEN NOT c THEN before END AS anchor FROM a WHERE NOT c OR doc_id % 17 = 0
      UNION ALL SELECT doc_id, 'gone', NULL FROM b WHERE c AND NOT s""",
    "q_status_transition": """SELECT o_orderkey, o_orderstatus AS before, 'P' AS after, o_orderstatus = 'F' AS lost, FALSE AS gained FROM orders
      WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AND o_orderstatus <> 'P'""",
    "q_sha256_hash": "SELECT doc_id, sha256(lang || chr(10) || source || chr(10) || text) AS h FROM documents",
    "q_slug": "SELECT page_id, regexp_replace(regexp_replace(strip_accents(lower(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages",
    "q_clean_footnotes": f"""SELECT doc_id, pos, md5(CASE WHEN hit THEN regexp_replace(r, '[0-9]+$', '') ELSE l END) AS line, hit::INT AS removed FROM (
      SELECT *, rtrim(l, ' ') AS r, regexp_matches(rtrim(l, ' '), '[a-zà-ÿA-ZÀ-Ý)\\]"''»][.;:!?][0-9]{{1,2}}$') AS hit FROM (SELECT doc_id, pos, line || CASE WHEN doc_id % 2 = 0 THEN '3' ELSE '' END AS l FROM ({LINES_SQL})))""",
    "q_clean_ordinals": f"""WITH l AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN 'Art. 1o da Lei no 9.099, no 1º grau ' WHEN 1 THEN '§ 2° do Decreto no 12.848, nos termos do no 1.234 ' ELSE '' END || line AS x FROM ({LINES_SQL})),
      a AS (SELECT *, replace(replace(replace(replace(replace(x, 'Art. 1o da', 'Art. 1º da'), 'Lei no 9', 'Lei nº 9'), '§ 2° do', '§ 2º do'), 'Decreto no 12', 'Decreto nº 12'), 'do no 1.234', 'do nº 1.234') AS y FROM l)
      SELECT doc_id, pos, md5(y) AS cleaned, CASE pos % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS places FROM a""",
    "q_heading_split": """SELECT * FROM (VALUES (0, 'CAPÍTULO III – Da Aplicação da Pena', 'Fixação da pena', 'sentence-case'), (1, 'Seção II Das Disposições Gerais', NULL, 'uncut'),
      (2, 'TÍTULO I – Dos Crimes contra a Pessoa', 'Homicídio simples', 'sentence-case'), (3, 'CAPÍTULO I – Do Furto', 'Furto', 'repetition'), (4, 'CAPÍTULO II – Dos Crimes contra o Respeito aos Mortos', NULL, 'uncut'),
      (5, 'CAPÍTULO V – Dos Crimes contra a Honra Calúnia', NULL, 'uncut'), (6, 'SEÇÃO # - Da Prova', NULL, 'uncut'), (7, 'TÍTULO IX-A – Das Penas', 'Penas', 'repetition')) v(n, heading, title, rule)""",
    "q_marginal_title": """SELECT * FROM (VALUES (0, 'Pena suspensa.', 'Fixação da pena', '', 'Pena suspensa. Fixação da pena', NULL), (1, 'art. 3# da lei. Pena - reclusão', NULL, 'sanction', 'art. 3# da lei. Pena - reclusão', NULL),
      (2, 'fica em vigor. Disposições Gerais.', NULL, '', 'fica em vigor. Disposições Gerais.', NULL), (3, 'do crime;', 'Dano em coisa de valor artístico', '', 'do crime; Dano em coisa de valor artístico', NULL), (4, 'só isto', NULL, '', 'só isto', NULL),
      (5, 'prescrição.4', 'Modo de conversão', '', 'prescrição.4 Modo de conversão', NULL), (6, 'efeito. PARTE ESPECIAL', NULL, 'capitals', 'efeito.', 'PARTE ESPECIAL')) v(n, body, title, against, rest, division)""",
    "q_paragraph_labels": "SELECT * FROM (VALUES (0, '#', 'p#', '§ #º'), (1, '1#', 'p1#', '§ 1#'), (2, '#-A', 'p#-a', '§ #º-A'), (3, 'único', 'pu', 'Parágrafo único'), (4, NULL, NULL, NULL)) v(n, number, suffix, label)",
    "q_fact_extraction": """SELECT * FROM (VALUES (0, 'lei_11343_2006_art33', 'confissao,proximidade,quantidade expressiva', NULL::DOUBLE), (1, NULL, '', NULL), (2, 'dl_2848_1940_art155', 'repousoNoturno,tentativa', NULL), (3, NULL, '', NULL),
      (4, NULL, '', NULL), (5, 'dl_2848_1940_art157', 'armaDeFogo,concurso,reincidencia', NULL), (6, 'lei_11343_2006_art35', '', 500.0)) v(n, crime, facts, grams)""",
    "q_change_filter": """SELECT * FROM (VALUES (0, 'lei_11343_2006', 'lei_11343_2006_art3#'), (1, 'lei_11343_2006', 'lei_11343_2006_art33,lei_11343_2006_art35,lei_11343_2006_art40'), (2, '', ''), (3, '', ''), (4, 'lei_11343_2006,dl_2848_1940', ''),
      (5, 'dl_2848_1940', 'dl_2848_1940_art359-l'), (6, '', '')) v(n, targets, articles)""",
    "q_norm_named": "SELECT * FROM (VALUES (0, TRUE, 'Lei 15.16#/2025'), (1, FALSE, NULL), (2, TRUE, 'LC 200/2023'), (3, TRUE, 'DL 2.848/1940')) v(n, became, norm)",
    "q_html_blocks": "SELECT page_id, lower(k) AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(p|h[1-6]|li|td|blockquote)[ >]', 1)) AS k FROM pages) GROUP BY 1, 2",
    "q_roman": "SELECT o_orderkey AS n, CASE WHEN k = 0 OR (k % 7 <> 0 AND k % 11 = 0) THEN NULL ELSE k END AS value FROM (SELECT o_orderkey, o_orderkey % 4000 AS k FROM orders)",
    "q_text_differences": """WITH a AS (SELECT doc_id, text AS a FROM documents), b AS (SELECT *, substr(a, 1, 20) || '##' || substr(a, 25) AS b FROM a),
      p AS (SELECT *, string_split(a, '') AS x, string_split(b, '') AS y, least(length(a), length(b)) AS n FROM b),
      q AS (SELECT *, coalesce(nullif(list_position(list_transform(list_zip(x[1:n], y[1:n]), lambda p: p[1] <> p[2]), TRUE), 0), n + 1) - 1 AS h,
        coalesce(nullif(list_position(list_transform(list_zip(list_reverse(x)[1:n], list_reverse(y)[1:n]), lambda p: p[1] <> p[2]), TRUE), 0), n + 1) - 1 AS t0 FROM p),
      r AS (SELECT *, least(t0, n - h) AS t FROM q) SELECT doc_id, h AS prefix, length(a) - h - t AS old, length(b) - h - t AS new, t AS suffix FROM r""",
    "q_lexeme_counts": "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 HAVING count(*) >= 200",
    "q_scope_include_exclude": """SELECT * FROM (VALUES (0, 'Regulamenta'), (1, 'Institui'), (2, 'Institui'), (3, 'Altera'), (4, 'Altera'), (5, 'Aprova'), (6, 'Revoga'), (7, 'Emergência'), (8, 'Declara'), (9, 'Dispõe')) v(n, species)""",
    "q_parsed_dates": "SELECT n, d AS day, d IS NULL OR d > DATE '1996-01-31' AS kept FROM (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 <= 1 THEN o_orderdate::DATE END AS d FROM orders)",
    "q_html_text": f"SELECT page_id, sha256(trim(regexp_replace(regexp_replace({decoded_sql(TEXT_SQL)}, '[ \\t]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), ' ')) AS text FROM pages",
    "q_html_toc": f"""WITH p AS (SELECT page_id, replace(replace(html, '<li>', '<h2>'), '</li>', '</h2>') AS h FROM pages),
      a AS (SELECT page_id, regexp_extract_all(h, '(?is)<h([1-4])[^>]*>(.*?)</h[1-4]>', 1) AS l, regexp_extract_all(h, '(?is)<h([1-4])[^>]*>(.*?)</h[1-4]>', 2) AS x FROM p),
      u AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l)::INT AS level, unnest(x) AS x FROM a)
      SELECT page_id, pos, level, trim({decoded_sql("regexp_replace(x, '<[^>]*>', '', 'g')")}) AS title FROM u""",
    "q_html_links": """WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s+href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s+href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages)
      SELECT page_id, unnest(range(1, len(h) + 1)) AS pos, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || unnest(h) AS target, trim(unnest(l)) AS label FROM a""",
    "q_listing_regex": """WITH a AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 1) AS p, regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2) AS l FROM pages)
      SELECT page_id, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS path, unnest(l) AS label FROM a""",
    "q_shingle_overlap": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
      b AS (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
      ws AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w)),
      bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b))
      SELECT doc_id, item_id, count(*) AS shared FROM ws JOIN bs USING (s) GROUP BY 1, 2""",
    "q_non_latin": "SELECT conv_id, turn FROM conversations WHERE conv_id % 9 = 0",
    "q_answer_validation": """SELECT * FROM (VALUES (1, 'no citation', '1'), (1, 'unknown source', 'z'), (2, 'empty', ''), (3, 'orphan citation', '7'), (3, 'other script', '1'), (4, 'shape', '')) v(answer_id, rule, detail)""",
    "q_answer_corrections": "SELECT * FROM (VALUES (1, 'no citation: 1; unknown source: z'), (2, 'empty'), (3, 'orphan citation: 7; other script: 1'), (4, 'shape')) v(answer_id, message)",
    "q_sentencing": sentencing_sql(),
    "q_cpf": f"""WITH c AS (SELECT c_custkey, lpad((c_custkey * 71234567 % 100000000000)::VARCHAR, 11, '0') AS cpf FROM customer)
      SELECT c_custkey, cpf <> repeat(cpf[1], 11) AND {CHECK(9)} = {CPF_DIGIT.format(10)} AND {CHECK(10)} = {CPF_DIGIT.format(11)} AS valid,
        cpf[1:3] || '.' || cpf[4:6] || '.' || cpf[7:9] || '-' || cpf[10:11] AS masked FROM c""",
    "q_suspicions": """SELECT doubt, count(*) AS n FROM (SELECT unnest([CASE WHEN regexp_matches(s, '^[a-zà-ÿ]') THEN 'lower-case start' END, CASE WHEN NOT regexp_matches(s, '[.;:!?)»”"'']$') THEN 'no final mark' END]) AS doubt
      FROM (SELECT trim(text, ' ') AS s FROM documents)) WHERE doubt IS NOT NULL GROUP BY 1""",
}
for name, (values, n, filled) in {
    "q_marginal_title": (TITLES, "n", ("body", "title", "rest", "division")), "q_heading_split": (HEADINGS, "n", ("heading",)), "q_paragraph_labels": (LABELS, "n", ("number", "suffix", "label")),
    "q_change_filter": (SUMMARIES, "n", ("articles",)), "q_norm_named": (STATUSES, "n", ("norm",)), "q_scope_include_exclude": (OPENINGS, "n", ()),
    "q_answer_validation": (ANSWERS, "answer_id", ()), "q_answer_corrections": (ANSWERS, "answer_id", ()), "q_fact_extraction": (QUESTIONS, "n", ()),
}.items():
    SQL[name] = dealt_sql(SQL[name], values, n, filled)
SQL["q_fact_extraction"] = f"SELECT * REPLACE (CASE WHEN n % {len(QUESTIONS)} = 0 THEN (n // {len(QUESTIONS)} % 9 + 1) * 1000.0::DOUBLE ELSE grams END AS grams) FROM ({SQL['q_fact_extraction']})"

SQL["q_sanitised"] = """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|textarea|option|noscript|iframe)[\\s/>].*?</(script|style|textarea|option|noscript|iframe)\\s*>', '', 'g') AS x FROM pages)
      SELECT page_id, len(regexp_extract_all(x, '(?i)<p[ >]')) AS paragraphs, len(regexp_extract_all(x, '(?i)<li[ >]')) AS items, len(regexp_extract_all(x, '(?i)<a[ >]')) AS links, 0 AS unlisted FROM p"""

#: A page's heading as one line, and a digit of its key.
HEADING_SQL = decoded_sql("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
PAGE_SQL = f"SELECT page_id, url, (page_id % 9 + 1)::VARCHAR AS d, trim(regexp_replace(regexp_replace({HEADING_SQL}, '[\\s\u00a0]+', ' ', 'g'), ' +([,;.)])', '\\1', 'g'), ' ') AS h FROM pages"
SQL["q_page_changes"] = f"""SELECT page_id, article, verb, replace(norm, '#', d) AS norm, year, CASE WHEN link THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/l' || d END AS href FROM ({PAGE_SQL}),
      (VALUES ('1', 'redação dada', 'Lei 1.23#/2020', 2020, FALSE), ('1', 'incluído', 'Lei 5.55#/2021', 2021, TRUE), ('2-a', 'incluído', 'Lei 5.55#/2021', 2021, TRUE)) v(article, verb, norm, year, link)"""
SQL["q_page_outline"] = f"""SELECT page_id, pos, article, suffix, kind, label, md5(replace(replace(text, '#', d), '~', h)) AS text FROM ({PAGE_SQL}),
      (VALUES (0, '', '', 'abertura', '', 'DECRETO O governo decreta'), (1, '1', '', 'artigo', 'Art. 1', '~ (Redação dada pela Lei nº 1.23#, de 2020) and more'), (2, '1', '_p1', 'paragrafo', '§ 1º', 'Texto (Incluído pela Lei nº 5.55#, de 2021)'),
        (3, '1', '_p1_inc1', 'inciso', 'I', 'item'), (4, '1', '_p1_inc1_ala', 'alinea', 'a)', 'letra loose text'), (5, '2-a', '', 'artigo', 'Art. 2-a', 'Outro (Revogado)'),
        (6, '2-a', '_inc2', 'inciso', 'II', 'item (Incluído pela Lei nº 5.55#, de 2021)(Incluído pela Lei nº 5.55#, de 2021)'), (7, '2-a', '_pu', 'paragrafo', 'Parágrafo único', 'Fim')) v(pos, article, suffix, kind, label, text)"""

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
