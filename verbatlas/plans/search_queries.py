"""Search over documents and embeddings: each query with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.lineage import shared_folder
from verbatlas.functions.text import lexemes, norm
from verbatlas.operators import index as written
from verbatlas.operators import search as s
from verbatlas.operators import stems
from verbatlas.operators import vectors as quantised

#: The question, the row whose vector is the query's, and the curated vocabulary of these queries.
ASK, VECTOR_OF, LANG = "toxic language that and", 7, "en"
DENSE_ASK = "idiot pathetic"
PLAIN_ASK, NOT_ASK, PHRASE, ANY_ASK = "the and that", "the and -idiot", '"of the" and', "idiot or moron the"
TERMS = [(1, "Toxic language", ["insults", "offensive words"]), (2, "High quality text", ["clean prose"]), (3, "Scum", ["that"])]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """id, title (the first line), text, lang."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "text", "lang", "source")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


#: Indexes that this process has written, by application, folder of tables and kind.
WRITTEN: dict[tuple[str, str, bool], written.Index] = {}


def index_of(spark: SparkSession, d: str, stemmed: bool = False) -> written.Index:
    """The index of the documents of ``d``: written by the first search of a session, read by all."""
    key = (spark.sparkContext.applicationId, d, stemmed)
    if key not in WRITTEN:
        own = written.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", stemmed=stemmed)
        written.added(own, documents(spark, d))
        WRITTEN[key] = own
    return WRITTEN[key]


def words_of(spark: SparkSession, d: str, ask: str):
    """The lexical leg of a question, from the written index."""
    return lambda only=None: written.lexical(index_of(spark, d), ask, only=only)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(F.col("id") == VECTOR_OF).select(F.lit(1).alias("query_id"), "vector")


def vocabulary(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(n).alias("term"), F.array(*map(F.lit, v)).alias("variants")) for i, n, v in TERMS])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as the curated subset of the two first terms."""
    lab = t(spark, d, "labels")
    tox = lab.where("toxic = 1").select(F.lit(1).alias("term_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "principal").otherwise("related").alias("role"), (F.col("doc_id") % 50).cast("int").alias("weight"))
    good = lab.where("quality = 1").select(F.lit(2).alias("term_id"), F.col("doc_id").alias("id"), F.lit("principal").alias("role"), F.lit(None).cast("int").alias("weight"))
    return tox.unionByName(good)


def run(spark: SparkSession, d: str, ask: str = ASK, vector: bool = True, only: str | None = None, most: int = 12) -> DataFrame:
    hits = s.hybrid(
        documents(spark, d), vectors(spark, d), vocabulary(spark), edges(spark, d), ask,
        asked(spark, d) if vector else None, most=most, only=None if only is None else F.col("lang") == only, words=words_of(spark, d, ask),
    )
    return hits.drop("query_id")


NORM = "strip_accents(lower({}))"
WORDS = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^a-z0-9]+'), lambda w: w <> '')"
FIRST_LINE = "split_part(text, chr(10), 1)"


def lexical_sql(ask: str, where: str = "TRUE", title: bool = True) -> str:
    p = s.parse_query(ask)
    t_words = WORDS.format(FIRST_LINE) if title else "[]::VARCHAR[]"
    tests = [f"list_contains(tb, '{w}')" for w in p["must"]] + [f"NOT list_contains(tb, '{w}')" for w in p["not"]]
    tests += ["(" + " OR ".join(f"list_contains(tb, '{w}')" for w in g) + ")" for g in p["any"]]
    tests += [f"contains(' ' || array_to_string(tb, ' ') || ' ', ' {' '.join(x)} ')" for x in p["phrases"]]
    wanted = ", ".join(f"'{w}'" for w in [*p["must"], *(w for g in p["any"] for w in g)])
    return f"""lex AS (
      SELECT id, lex, row_number() OVER (ORDER BY lex DESC, id) AS pos FROM (
        SELECT id, round({s.TITLE} * len(list_filter(tw, lambda w: w IN ({wanted}))) + {s.BODY} * len(list_filter(bw, lambda w: w IN ({wanted}))), 6) AS lex
        FROM (SELECT doc_id AS id, {t_words} AS tw, {WORDS.format('text')} AS bw, list_concat({t_words}, {WORDS.format('text')}) AS tb FROM documents WHERE {where})
        WHERE {' AND '.join(tests)}
      ) QUALIFY pos <= {s.CAP})"""


def term_sql(ask: str, where: str = "TRUE") -> str:
    names = ", ".join(f"({i}, '{n}', '{x.lower()}')" for i, n, v in TERMS for x in [n, *v])
    q = ask.lower()
    return f"""names(term_id, term, name) AS (VALUES {names}),
    met AS (SELECT DISTINCT term_id, term FROM names WHERE name = '{q}' OR (length(name) >= {s.CONTAINED} AND contains('{q}', name))),
    edges AS (
      SELECT 1 AS term_id, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'principal' ELSE 'related' END AS role, CAST(doc_id % 50 AS INT) AS weight FROM labels WHERE toxic = 1
      UNION ALL SELECT 2, doc_id, 'principal', NULL FROM labels WHERE quality = 1),
    hit AS (
      SELECT id, term, role, weight FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN role = 'principal' THEN 1 ELSE 0 END DESC, weight DESC NULLS LAST, term_id) AS n
        FROM met JOIN edges USING (term_id) WHERE id IN (SELECT doc_id FROM documents WHERE {where})) WHERE n = 1),
    term AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN role = 'principal' THEN 1 ELSE 0 END DESC, weight DESC NULLS LAST, id) AS pos FROM hit)"""


DIST = "round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"


def vector_sql(where: str = "TRUE") -> str:
    return f"""vec AS (
      SELECT id, row_number() OVER (ORDER BY dist, id) AS pos FROM (
        SELECT e.vec_id AS id, {DIST} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_OF}) q
        WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE {where})) QUALIFY pos <= {s.CAP})"""


def hybrid_sql(ask: str = ASK, vector: bool = True, where: str = "TRUE", most: int = 12, floor: bool = False) -> str:
    w = s.WEIGHTS
    vec = vector_sql(where) if vector else "vec AS (SELECT NULL::BIGINT AS id, NULL::BIGINT AS pos WHERE FALSE)"
    out = f"""WITH {term_sql(ask, where)}, {lexical_sql(ask, where)}, {vec},
    ids AS (SELECT id FROM term UNION SELECT id FROM lex UNION SELECT id FROM vec),
    f AS (
      SELECT ids.id, round(coalesce({w['term']} / ({s.K} + term.pos), 0) + coalesce({w['lexical']} / ({s.K} + lex.pos), 0) + coalesce({w['vector']} / ({s.K} + vec.pos), 0), 6) AS score,
             term.term, term.role, term.weight, term.pos AS term_pos, lex.pos AS lexical_pos, vec.pos AS vector_pos
      FROM ids LEFT JOIN term USING (id) LEFT JOIN lex ON lex.id = ids.id LEFT JOIN vec ON vec.id = ids.id),
    o AS (
      SELECT row_number() OVER (ORDER BY term_pos IS NOT NULL DESC, CASE WHEN role = 'principal' THEN 1 WHEN role IS NULL THEN -1 ELSE 0 END DESC, weight DESC NULLS LAST, score DESC, id) AS place, *
      FROM f QUALIFY place <= {most})"""
    if not floor:
        return f"{out} SELECT place, id, score, term, role, weight, term_pos, lexical_pos, vector_pos FROM o"
    least = round(1 / (s.K + 1), 6)
    return f"""{out}, n AS (SELECT count(*) FILTER (WHERE score > {least}) AS strong FROM o)
    SELECT place, id, score, term, role, weight, term_pos, lexical_pos, vector_pos, strong < 3 AS weak FROM o, n
    WHERE CASE WHEN strong >= 3 THEN score > {least} ELSE place <= 3 END"""


def q_hybrid_rrf(spark, d):
    return run(spark, d)


def q_hybrid_rrf_filtered(spark, d):
    return run(spark, d, only=LANG)


def q_hybrid_no_vector(spark, d):
    return run(spark, d, vector=False)


def q_fusion_floor(spark, d):
    hits = s.hybrid(documents(spark, d), vectors(spark, d), vocabulary(spark), edges(spark, d), PLAIN_ASK, asked(spark, d), most=60, words=words_of(spark, d, PLAIN_ASK))
    return s.above_floor(hits).drop("query_id")


def legs(spark, d):
    queries = spark.range(1).select(F.lit(1).alias("query_id"), F.lit(ASK).alias("query"))
    docs = documents(spark, d)
    return {
        "term": s.term_leg(queries, vocabulary(spark), s.of_documents(edges(spark, d), docs), cap=None),
        "lexical": words_of(spark, d, ASK)(),
        "vector": s.vector_leg(s.of_documents(vectors(spark, d), docs), asked(spark, d)),
    }


def q_hybrid_stacked(spark, d):
    return s.fused(legs(spark, d)).drop("query_id")


def q_hybrid_full_outer(spark, d):
    return s.fused_by_joins(legs(spark, d)).drop("query_id")


def q_hybrid_left_joins(spark, d):
    """The union of the legs' ids, and a left join with each leg."""
    ls = legs(spark, d)
    ids = None
    for leg in ls.values():
        one = leg.select("id")
        ids = one if ids is None else ids.union(one)
    out = ids.distinct()
    score = F.lit(0.0)
    for n, leg in ls.items():
        out = out.join(leg.select("id", F.col("pos").alias(f"{n}_pos")), "id", "left")
        score = score + F.coalesce(F.lit(s.WEIGHTS[n]) / (s.K + F.col(f"{n}_pos")), F.lit(0.0))
    return out.select("id", F.round(score, 6).alias("score"), "term_pos", "lexical_pos", "vector_pos")


FUSED_SQL = f"""WITH {term_sql(ASK)}, {lexical_sql(ASK)}, {vector_sql()}
    SELECT coalesce(term.id, lex.id, vec.id) AS id,
      round(coalesce(3.0 / (60 + term.pos), 0) + coalesce(1.0 / (60 + lex.pos), 0) + coalesce(1.0 / (60 + vec.pos), 0), 6) AS score,
      term.pos AS term_pos, lex.pos AS lexical_pos, vec.pos AS vector_pos
    FROM term FULL JOIN lex ON term.id = lex.id FULL JOIN vec ON vec.id = coalesce(term.id, lex.id)"""


def q_term_exact(spark, d):
    """Part types as a vocabulary: which equal the question in normal form."""
    vocab = t(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_type").alias("term"), F.array().cast("array<string>").alias("variants"))
    name = t(spark, d, "part").agg(F.min("p_type").alias("query")).select(F.lit(1).alias("query_id"), F.upper("query").alias("query"))
    return s.matched_terms(name, vocab).select("term_id", "term")


def q_term_contained(spark, d):
    vocab = t(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"))
    asks = t(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("about "), F.col("p_name"), F.lit(" and more")).alias("query"))
    return s.term_counts(asks, vocab)


def q_cosine_topk(spark, d):
    return s.vector_leg(vectors(spark, d), asked(spark, d), 20).select("pos", "id", "dist")


def q_cosine_batch(spark, d):
    many = vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return s.vector_leg(vectors(spark, d), many, 5).select("query_id", "pos", "id", "dist")


#: Rows of a query that are compared exactly, of those that its index promises.
CANDIDATES = 40


def q_vector_recall(spark, d):
    """The five nearest of every fiftieth vector by the index, held against all pairs: how many there are, whether nine tenths of them are
    found, and whether a tenth of all vectors at most was compared."""
    rows = vectors(spark, d)
    many = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    book = quantised.learnt(rows)
    at = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    quantised.write(quantised.indexed(rows, book), at)
    found = quantised.nearest(spark.read.parquet(at), rows, many, book, 5, CANDIDATES).select("query_id", "id", F.lit(1).alias("found"))
    exact = s.vector_leg(rows, many, 5).select("query_id", "id")
    met = exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))
    return met.crossJoin(rows.agg((F.count("*") >= 10 * CANDIDATES).alias("few")))  # one row each


def lexical(ask):
    return lambda spark, d: words_of(spark, d, ask)().select("id", "lex", "pos")


def q_lexical_scan(spark, d):
    """The same as q_lexical_and, without an index."""
    return s.lexical_leg(documents(spark, d), PLAIN_ASK).select("id", "lex", "pos")


def q_lexical_density(spark, d):
    """Ranked by cover density, of the words of the bodies and titles together."""
    return written.lexical(index_of(spark, d), DENSE_ASK, density=True).select("id", "density", "lex", "pos")


def q_stems(spark, d):
    """The stem of every word of the documents."""
    words = documents(spark, d).select(F.explode(F.array_distinct(lexemes("text"))).alias("word")).distinct()
    return words.select("word", stems.stem("word").alias("stem"))


def q_index_stems(spark, d):
    """How many documents and places each stem of a stemmed index has."""
    own = index_of(spark, d, stemmed=True)
    rows = written.counts(own, *own.state()[2:])
    return rows.groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum(F.col("t") + F.col("b")).alias("places"))


def q_index_increments(spark, d):
    """An index by two increments, one of changed and one of returning documents, a removal and a merge: what it holds of each document."""
    docs = documents(spark, d).where("id IS NOT NULL")
    own = written.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=4)
    written.added(own, docs.where("id % 3 = 0"))
    written.added(own, docs.where("id % 3 <> 0"))
    written.added(own, docs.where("id % 5 = 0").withColumn("text", F.concat(F.lit("changed words "), F.col("text"))))
    written.removed(own, docs.where("id % 7 = 0").select("id"))
    written.added(own, docs.where("id % 35 = 0"))
    written.merged(own)
    rows = written.occurrences(own, *own.state()[2:])
    return rows.groupBy("id").agg(F.count("*").alias("lexemes"), F.sum(F.col("t") + F.col("b")).alias("places"), F.count_if(F.col("lexeme") == "changed").alias("changed"))


def q_cover_density(spark, d):
    words = documents(spark, d).select("id", lexemes("text").alias("w"))
    numbered = F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def places(word: str):
        return F.transform(F.filter(numbered, lambda p: p["x"] == word), lambda p: p["i"])

    at = F.array(places("pathetic"), places("idiot"))
    hit = words.select("id", at.alias("at")).where("forall(at, p -> size(p) > 0)")
    return hit.select("id", F.round(s.cover_density(F.col("at")), 6).alias("density"))


def q_header_leg_fusion(spark, d):
    """Orders as headers and line items as their blocks: a header's hit counts for its first block."""
    heads = t(spark, d, "orders").select(F.col("o_orderkey").alias("header_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"))
    lines = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("header_id"), F.col("l_linenumber").alias("ordem"), "l_returnflag")
    head = s.header_hits(heads, lines, "urgent f")
    body = s.ranked(lines.where("l_returnflag = 'R' AND ordem = 1").select(F.lit(1).alias("query_id"), "id").distinct(), F.col("id"))
    return s.fused({"head": head, "body": body}, {"head": 2.0, "body": 1.0}).drop("query_id")


def q_direct_address(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("ordem"), "l_partkey")
    return s.direct(lines, [(3, 1), (1, 2), (2, 3)], 12).select("asked", "parent_id", "ordem", "l_partkey", "score")


def q_norm_group(spark, d):
    g = documents(spark, d).select(F.md5(norm("text").cast("binary")).alias("same"))
    return g.groupBy("same").agg(F.count("*").alias("n"))


SQL = {
    "q_hybrid_rrf": hybrid_sql(),
    "q_hybrid_rrf_filtered": hybrid_sql(where=f"lang = '{LANG}'"),
    "q_hybrid_no_vector": hybrid_sql(vector=False),
    "q_fusion_floor": hybrid_sql(PLAIN_ASK, most=60, floor=True),
    "q_hybrid_stacked": FUSED_SQL,
    "q_hybrid_full_outer": FUSED_SQL,
    "q_hybrid_left_joins": FUSED_SQL,
    "q_term_exact": "SELECT p_partkey AS term_id, p_type AS term FROM part WHERE strip_accents(lower(p_type)) = (SELECT strip_accents(lower(min(p_type))) FROM part)",
    "q_term_contained": """WITH q AS (SELECT p_partkey AS query_id, 'about ' || lower(p_name) || ' and more' AS q FROM part WHERE p_partkey % 50 = 0)
      SELECT query_id, count(*) AS n, min(p_partkey) AS first FROM q JOIN part ON length(p_name) >= 12 AND contains(q, lower(p_name)) GROUP BY 1""",
    "q_cosine_topk": f"SELECT row_number() OVER (ORDER BY dist, id) AS pos, id, dist FROM (SELECT e.vec_id AS id, {DIST} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_OF}) q) QUALIFY pos <= 20",
    "q_cosine_batch": f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS pos, id, dist FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {DIST} AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) QUALIFY pos <= 5",
    "q_header_leg_fusion": f"""WITH h AS (
        SELECT id, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY 2 * {s.BODY} DESC, o_orderkey) AS pos FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'F' QUALIFY pos <= 200)
        JOIN (SELECT l_orderkey, min_by(l_orderkey * 10 + l_linenumber, l_linenumber) AS id FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
      b AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) QUALIFY pos <= 200)
      SELECT coalesce(h.id, b.id) AS id, round(coalesce(2.0 / (60 + h.pos), 0) + coalesce(1.0 / (60 + b.pos), 0), 6) AS score, h.pos AS head_pos, b.pos AS body_pos FROM h FULL JOIN b ON h.id = b.id""",
    "q_cover_density": f"""WITH w AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), p AS (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
      q AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS bx, lag(i) OVER (PARTITION BY id ORDER BY i) AS bi FROM p WHERE x IN ('pathetic', 'idiot'))
      SELECT id, round(sum(1.0::DOUBLE / (i - bi + 1)), 6) AS density FROM q WHERE x <> bx GROUP BY 1""",
    "q_direct_address": """SELECT asked, l_orderkey AS parent_id, l_linenumber AS ordem, l_partkey, 0.0::DOUBLE AS score FROM lineitem JOIN (VALUES (3, 1), (1, 2), (2, 3)) v(k, asked) ON l_orderkey = k
      ORDER BY asked, l_linenumber LIMIT 12""",
    "q_norm_group": "SELECT md5(strip_accents(lower(text))) AS same, count(*) AS n FROM documents GROUP BY 1",
}
def stem_sql(words: str) -> str:
    """(word, stem) of a table of distinct words: the stemmer's rules, a step a row."""
    r = stems

    def end(w: str, ends: list[str]) -> str:
        return f"regexp_extract({w}, '(?:{'|'.join(ends)})$')"

    def less(w: str, ends: list[str], least: str) -> str:
        return f"CASE WHEN {end(w, ends)} <> '' AND length({w}) - length({end(w, ends)}) >= {least} THEN left({w}, (length({w}) - length({end(w, ends)}))::INT) ELSE {w} END"

    def among(ends: list[str]) -> str:
        return "e IN (" + ", ".join(f"'{x}'" for x in ends) + ")"

    start = "CASE WHEN regexp_extract(w, '{0}') = '' THEN length(w) ELSE length(regexp_extract(w, '{0}')) END".format
    every = [*r.NOMINAL, *r.LOGIA, *r.AMENTE, *r.MENTE, *r.IDADE, *r.IVO, *r.IRA]
    return f"""m AS (SELECT w, {start(r.R1)} AS r1, {start(r.R2)} AS r2, {start(r.RV)} AS rv, {end('w', every)} AS e FROM {words}),
      l AS (SELECT *, left(w, (length(w) - length(e))::INT) AS l FROM m),
      la AS (SELECT *, {less('l', ['iv', 'os', 'ic', 'ad'], 'r2')} AS am FROM l),
      st AS (SELECT w, rv, CASE WHEN {among(r.NOMINAL)} AND length(l) >= r2 THEN l WHEN {among(r.LOGIA)} AND length(l) >= r2 THEN l || 'log'
          WHEN {among(r.AMENTE)} AND length(l) >= r1 THEN CASE WHEN l LIKE '%iv' AND am <> l THEN {less('am', ['at'], 'r2')} ELSE am END
          WHEN {among(r.MENTE)} AND length(l) >= r2 THEN {less('l', ['ante', 'avel'], 'r2')} WHEN {among(r.IDADE)} AND length(l) >= r2 THEN {less('l', ['abil', 'ic', 'iv'], 'r2')}
          WHEN {among(r.IVO)} AND length(l) >= r2 THEN {less('l', ['at'], 'r2')} WHEN {among(r.IRA)} AND length(l) >= rv AND l LIKE '%e' THEN l || 'ir' ELSE w END AS now FROM la),
      vb AS (SELECT w, rv, CASE WHEN now <> w THEN now ELSE left(w, (length(w) - length({end('substr(w, rv + 1)', r.VERBAL)}))::INT) END AS now FROM st),
      rs AS (SELECT w, rv, CASE WHEN now = w THEN {less('w', r.RESIDUAL, 'rv')} WHEN now LIKE '%ci' AND length(now) - 1 >= rv THEN left(now, -1) ELSE now END AS now FROM vb),
      fi AS (SELECT w, rv, now, now LIKE '%e' AND length(now) - 1 >= rv AS cut FROM rs),
      stemmed AS (SELECT w AS word, CASE WHEN cut AND (now LIKE '%gue' OR now LIKE '%cie') AND length(now) - 2 >= rv THEN left(now, -2) WHEN cut THEN left(now, -1) ELSE now END AS stem FROM fi)"""


SQL["q_stems"] = f"WITH ws AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM documents), {stem_sql('ws')} SELECT word, stem FROM stemmed"
SQL["q_index_stems"] = f"""WITH ea AS (SELECT doc_id AS id, unnest(list_concat({WORDS.format(FIRST_LINE)}, {WORDS.format('text')})) AS w FROM documents),
      ws AS (SELECT DISTINCT w FROM ea WHERE w NOT IN ({', '.join(f"'{x}'" for x in sorted(s.STOP))})), {stem_sql('ws')}
      SELECT stem AS lexeme, count(DISTINCT id) AS documents, count(*) AS places FROM ea JOIN stemmed ON w = word GROUP BY 1"""
SQL["q_vector_recall"] = f"SELECT 5 * count(*) FILTER (WHERE vec_id % 50 = 0) AS neighbours, TRUE AS enough, count(*) >= {10 * CANDIDATES} AS few FROM embeddings"
SQL["q_lexical_density"] = f"""WITH w AS (SELECT doc_id AS id, {WORDS.format(FIRST_LINE)} AS t, {WORDS.format('text')} AS b FROM documents),
      p AS (SELECT id, unnest(list_concat(t, b)) AS x, unnest(range(1, len(t) + len(b) + 1)) AS i, len(t) AS n FROM w),
      q AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS bx, lag(i) OVER (PARTITION BY id ORDER BY i) AS bi FROM p WHERE x IN ('pathetic', 'idiot')),
      g AS (SELECT id, round(sum(CASE WHEN x <> bx THEN 1.0::DOUBLE / (i - bi + 1) END), 6) AS density, round(sum(CASE WHEN i <= n THEN {s.TITLE} ELSE {s.BODY} END), 6)::DOUBLE AS lex FROM q GROUP BY 1 HAVING count(DISTINCT x) = 2)
      SELECT id, density, lex, row_number() OVER (ORDER BY density DESC, lex DESC, id) AS pos FROM g QUALIFY pos <= {s.CAP}"""
SQL["q_index_increments"] = f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 AND doc_id % 35 <> 0 THEN 'changed words ' || text ELSE text END AS text, {FIRST_LINE} AS title FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 35 = 0),
      w AS (SELECT id, unnest(list_concat({WORDS.format('title')}, {WORDS.format('text')})) AS x FROM d)
      SELECT id, count(DISTINCT x) AS lexemes, count(*) AS places, count(DISTINCT CASE WHEN x = 'changed' THEN x END) AS changed FROM w GROUP BY 1"""
for name, ask in {"q_lexical_scan": PLAIN_ASK, "q_lexical_and": PLAIN_ASK, "q_lexical_not": NOT_ASK, "q_phrase": PHRASE, "q_lexical_any": ANY_ASK}.items():
    SQL[name] = f"WITH {lexical_sql(ask)} SELECT id, lex, pos FROM lex"

QUERIES = {f.__name__: f for f in (
    q_hybrid_rrf, q_hybrid_rrf_filtered, q_hybrid_no_vector, q_fusion_floor, q_hybrid_stacked, q_hybrid_full_outer, q_hybrid_left_joins, q_term_exact,
    q_term_contained, q_lexical_scan, q_lexical_density, q_index_increments, q_stems, q_index_stems, q_cosine_topk, q_cosine_batch, q_vector_recall, q_cover_density, q_header_leg_fusion, q_direct_address, q_norm_group,
)} | {"q_lexical_and": lexical(PLAIN_ASK), "q_lexical_not": lexical(NOT_ASK), "q_phrase": lexical(PHRASE), "q_lexical_any": lexical(ANY_ASK)}
