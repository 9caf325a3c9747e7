"""Operators that no query shows: known values, files, retries, threads, streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import display, text
from verbatlas.operators import answers, compare, consult, curation, index, integrity, merge, ordered, relate, reports, search, sentence
from verbatlas.streaming import collect


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


# --- text -------------------------------------------------------------------------------------------


def test_normal_forms(spark):
    assert one(spark, text.norm("x"), x="ÁÉÍ ő ž é ł ß ﬁ ª") == "aei o z e ł ß ﬁ ª"
    assert text.plain("ÁÉ őž é") == "ae oz e"
    df = spark.createDataFrame([(["É", None, "b"],), ([],), (None,)], "xs array<string>")
    assert [r[0] for r in df.select(text.norm_all("xs")).collect()] == [["e", None, "b"], [], None]
    assert [r[0] for r in df.select(text.joined("xs", "-")).collect()] == ["É-b", "", ""]


@pytest.mark.parametrize(("number", "want"), [("7", (7, None)), ("216-B", (216, "B")), ("359-m-b", (359, "M-B")), ("7o", None), ("", None)])
def test_article_numbers(spark, number, want):
    got = one(spark, text.article_number("x"), x=number)
    assert (got and tuple(got)) == want


def test_articles_and_citations(spark):
    ids = ["lei_1_art33_p4_inc1", "lei_1_art7-a_pu", "lei_1_art33", "other"]
    assert [one(spark, text.article_of("x"), x=i) for i in ids] == ["lei_1_art33", "lei_1_art7-a", "lei_1_art33", "other"]
    assert [one(spark, text.ordinal("x"), x=n) for n in ("1", "3-A", "10", "33", "33-A", "x")] == ["1º", "3º-A", "10", "33", "33-A", "x"]
    chain = F.split("c", "/")
    assert one(spark, text.citation("n", chain, "law"), n="33", c="§ 4º/I/a", law="da Lei nº 11.343/2006") == "art. 33, § 4º, I, a, da Lei nº 11.343/2006"
    assert one(spark, text.citation("n", chain, "law"), n="7", c="", law="da Lei nº 1") == "art. 7º da Lei nº 1"


def test_markers_and_short_forms(spark):
    cases = [("§ 4º-A. Texto", "paragrafo", "Texto"), ("Parágrafo único - Fim", "paragrafo", "Fim"), ("IV – item", "inciso", "item"), ("a) letra", "alinea", "letra"), ("Art. 33. Importar", "caput", "Importar")]
    for x, k, want in cases:
        assert one(spark, text.without_marker("x", "k"), x=x, k=k) == want
    assert [one(spark, text.is_revoked("x"), x=x) for x in ("(Revogado)", "( (VETADO)", "Não revogado")] == [True, True, False]
    assert [one(spark, text.initials("x"), x=x) for x in ("Ana Maria Souza", " joão ", "")] == ["AS", "J", ""]
    assert one(spark, text.short_title("x", 20), x="a title that is much too long") == "a title that is…" and one(spark, text.short_title("x"), x="short") == "short"


def test_displays(spark):
    assert [one(spark, display.date_br("x"), x=x) for x in ("2025-01-31T10:00", "", "x")] == ["31/01/2025", "—", "—"]
    assert [one(spark, display.number_br("x"), x=x) for x in (1234567.5, 0.0, 12.0)] == ["1.234.567,5", "0", "12"]
    assert [one(spark, display.article_title("x"), x=x) for x in ("7-A", "33")] == ["Art. 7º-A", "Art. 33"]
    assert [one(spark, display.version_name("x"), x=x) for x in ("compilado", "original")] == ["compilada", "original"]
    draft = spark.createDataFrame([("A", "529.982.247-25", None, None, None), ("", "", "", "", "")], "name string, cpf string, phone string, email string, note string")
    assert [r[0] and r[0]["message"] for r in draft.select(display.first_objection()).collect()] == [None, "the name is missing"]


# --- search -----------------------------------------------------------------------------------------


def test_rules_written_twice_agree(spark):
    """What is computed by the driver for a query and by tasks for a collection."""
    words = ["Ação", "condenados", "privilégio", "a", "rei", "leis", "constitucionalmente", "ŽIVOT", "x1", "naturezas"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.norm("w")).collect()] == [text.plain(w) for w in words]
    assert search.parse_query('Ações "pena de" -réu')["not"] == ["reu"]


def test_clamped_sizes():
    assert [search.clamped(x) for x in ("5", 0, 99, "x", None, "nan", 3.9, float("inf"))] == [5, 1, 40, 8, 8, 8, 3, 8]


def test_a_stemmed_index_gives_what_a_scan_gives(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Penas", "as penas privativas de liberdade"), (2, "x", "liberdade e, muito depois de tudo, a pena"), (3, "x", "a pena é a liberdade; pena, liberdade"), (4, None, None), (5, "liberdade", "sem")], "id long, title string, text string")
    own = index.Index(spark, str(tmp_path / "i"), buckets=4, blocks=2, stemmed=True)
    index.added(own, docs)
    hits = index.lexical(own, "pena de liberdade", density=True).orderBy("pos").collect()
    assert [r["id"] for r in hits] == [3, 1, 2] and all(r["density"] > 0 for r in hits)
    plain = {r["id"] for r in docs.fillna("").where(F.lower("text").contains("liberdad") & F.lower(F.concat("title", F.lit(" "), "text")).contains("pena")).collect()}
    assert {r["id"] for r in hits} == plain


def test_a_vector_index_finds_what_a_scan_finds(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["id"]) for r in search.vector_leg(e, asked, 10).collect()}
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 4)  # in blocks
    assert {(r["query_id"], r["id"]) for r in search.vector_leg(e, asked, 10).collect()} == exact
    centres = search.centroids_of(e)
    index = search.indexed_vectors(e, centres)
    assert index.where("cell IS NOT NULL").count() == e.count()
    got = {(r["query_id"], r["id"]) for r in search.probed_leg(index, asked, centres, cap=10).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_overlaps_by_either_way(spark, monkeypatch):
    rows = [(k, [f"i{(k * j) % 7}" for j in range(k % 5)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, x array<string>")
    other = df.select(F.col("k").alias("o"), F.col("x").alias("y"))
    want = {(a, b, len(set(x) & set(y))) for a, x in rows for b, y in rows if set(x) & set(y)}
    assert {tuple(r) for r in relate.overlapping(df, other, "k", "o", "x", "y").collect()} == want
    rare = [(k, [f"i{k // 2}"]) for k in range(40)]
    df = spark.createDataFrame(rare, "k int, x array<string>")
    other = df.select(F.col("k").alias("o"), F.col("x").alias("y"))
    assert {tuple(r) for r in relate.overlapping(df, other, "k", "o", "x", "y").collect()} == {(a, b, 1) for a, _ in rare for b, _ in rare if a // 2 == b // 2}


def test_pairs_of_common_items_are_spread_over_tasks_and_never_shuffled(spark, monkeypatch):
    rows = [(k, [f"i{j}" for j in range(12) if (k * 7 + j * j) % 5]) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, x array<string>")
    want = {(a, b, len({*x} & {*y})) for a, x in rows for b, y in rows if {*x} & {*y}}
    monkeypatch.setattr(relate, "BLOCK", 11)
    pairs = relate.overlapping(df, df.select(F.col("k").alias("o"), F.col("x").alias("y")), "k", "o", "x", "y")
    assert {tuple(r) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan and pairs.rdd.getNumPartitions() >= 9 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(relate, "PAIRS", 100)
    inner = relate.overlapping_within(df, F.expr("k % 10 = 0"), "k", "o", "x")
    assert {tuple(r) for r in inner.collect()} == {(a, b, n) for a, b, n in want if a % 10 == 0 and a != b} and inner.columns == ["k", "o", "shared"]
    assert inner.rdd.getNumPartitions() == 9  # nine rows with ninety, a hundred pairs in a task


def test_pairs_of_rows_with_the_same_items_are_written_in_few_bytes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, sorted(x for x in "abcdefgh" if rng.random() < 0.8)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k long, x array<string>")
    relate.overlapping_within(df, F.expr("k % 10 = 0"), "k", "o", "x").write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    want = {(a, b): n for a, x in rows[::10] for b, y in rows if a != b and (n := len({*x} & {*y}))}
    assert {(r["k"], r["o"]): r["shared"] for r in found.collect()} == want and found.count() == len(want)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * len(want)
    assert max(r["n"] for r in found.groupBy(F.input_file_name()).agg(F.count_distinct("k").alias("n")).collect()) <= 256


def test_natural_and_priority_orders(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "7-B", "7", "7-A", "x", "359-M-B", "359-M-A")], "n string")
    assert [r[0] for r in df.orderBy(*consult.natural("n")).collect()] == ["7", "7-A", "7-B", "10", "359-M-A", "359-M-B", "x"]
    names = spark.createDataFrame([(x,) for x in ("Zeta", "água", "Agua", "beta", "Ábaco")], "n string")
    assert [r[0] for r in consult.by_alphabet(names, "n").collect()] == ["Ábaco", "Agua", "água", "beta", "Zeta"]


@pytest.fixture(scope="module")
def library(spark):
    rows = [(f"lei_1_art{a}{s}", law, f"lei_1_art{a}", i, "t", t) for i, (a, s, law, t) in enumerate([("33", "", "lei_1", "tráfico de drogas"), ("33", "_p4", "lei_1", "pena reduzida do tráfico"), ("35", "", "lei_1", "associação para o tráfico")])]
    blocks = spark.createDataFrame(rows, "id string, law string, article string, ordem int, title string, text string")
    terms = spark.createDataFrame([(1, "tráfico privilegiado", ["privilégio"])], "term_id int, term string, variants array<string>")
    edges = spark.createDataFrame([(1, "lei_1_art33_p4", "principal", 9), (1, "nowhere", "principal", 10)], "term_id int, id string, role string, weight int")
    return blocks, terms, edges


def test_consultation_ways(spark, library):
    blocks, terms, edges = library
    ask = lambda q, **k: consult.consulted(blocks, None, terms, edges, q, ["lei_1"], lambda _: None, **k)
    assert ask("  ") == ("nothing", None)
    way, rows = ask("art. 33")
    assert way == "direct" and [(r["place"], r["id"]) for r in rows.orderBy("place").collect()] == [(1, "lei_1_art33"), (2, "lei_1_art33_p4")]
    way, rows = ask("art. 999 tráfico")
    assert way == "fused"
    way, rows = ask("tráfico privilegiado")
    assert way == "fused" and rows.orderBy("place").first()["id"] == "lei_1_art33_p4" and "nowhere" not in {r["id"] for r in rows.collect()}


def test_a_conversation_is_replayed(library):
    blocks, terms, edges = library
    ask = lambda q: consult.consulted(blocks, None, terms, edges, q, ["lei_1"], lambda _: None)
    turns = consult.replayed(["art. 35", "tráfico privilegiado", ""], ask)
    assert turns[0] == {"question": "art. 35", "way": "direct", "found": ["lei_1_art35"], "weak": False, "inherited": []}
    assert turns[1]["found"][0] == "lei_1_art33_p4" and turns[1]["inherited"] == ["lei_1_art35"]
    assert turns[2]["way"] == "nothing" and turns[2]["inherited"][:1] == ["lei_1_art33_p4"]


# --- merges and integrity -----------------------------------------------------------------------------


def test_upserts_know_null_keys_and_stop_at_repeated_ones(spark):
    old = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 2), (2, 2)], "k int, v int")
    once = merge.upsert(old, new, ["k"])
    want = {(None, 2), (1, 1), (2, 2)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in merge.upsert(once, new, ["k"]).collect()}
    with pytest.raises(Exception, match="twice"):
        merge.upsert(old, new.unionByName(new), ["k"]).collect()


def test_comparison_sees_null(spark):
    schema = "id int, text string, ordem int, parent int"
    source = spark.createDataFrame([(1, "a", 1, 1), (2, None, 2, 1), (3, None, 3, 1), (4, "n", 4, 1)], schema)
    corpus = spark.createDataFrame([(1, None), (2, "b"), (3, None), (5, "g")], "id int, text string")
    assert {tuple(r) for r in compare.compared(corpus, source).collect()} == {(1, "change", None), (2, "change", None), (4, "add", 3), (5, "gone", None)}


def test_ancestors_of_long_chains_and_cycles(spark):
    chain = spark.range(40).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    out = relate.ancestors(chain, "id", "up")
    assert out.count() == 40 * 41 / 2 and out.agg(F.max("depth")).first()[0] == 39
    with pytest.raises(ValueError):
        relate.ancestors(chain.withColumn("up", F.coalesce("up", F.lit(39))), "id", "up")


def test_only_one_row_is_wanted(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert relate.one_or_none(df.where("k = 1")).collect()[0]["v"] == "a" and relate.one_or_none(df.where("k = 9")).count() == 0
    with pytest.raises(Exception, match="more than one"):
        relate.one_or_none(df).collect()




def test_only_missing_vectors_are_embedded_and_tries_repeat(spark):
    df = spark.createDataFrame([(1, "a", [9.0]), (2, "bb", None), (3, None, None)], "id int, text string, v array<double>")
    state = {"n": 0}

    def embed(texts):
        state["n"] += 1
        if state["n"] == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    out = merge.embedded(df, "id", "text", "v", embed, batch=2, first_wait=0.01)
    assert {(r["id"], r["v"][0]) for r in out.collect()} == {(1, 9.0), (2, 2.0), (3, 0.0)}

    def broken(texts):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        merge.embedded(df, "id", "text", "v", broken, tries=2, first_wait=0.01).collect()


def test_violations_are_raised_with_rows(spark):
    df = spark.createDataFrame([(1,)], "k int")
    integrity.raise_if_any(df.where("k = 2"), "nothing")
    with pytest.raises(ValueError, match="bad.*'k': 1"):
        integrity.raise_if_any(df, "bad")
    files = spark.createDataFrame([(True, [1]), (True, []), (None, [1]), (False, [1])], "completo boolean, decretos array<int>")
    assert integrity.complete_only(files).count() == 1


def test_curation_files_fail_loudly(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("fixes:\n  - {id: a, remove: x}\n  - {id: b}\n")
    assert [tuple(r) for r in curation.curated(spark, str(p), "id string, remove string", "fixes").collect()] == [("a", "x"), ("b", None)]
    for broken in ("fixes: []\n", "other: 1\n", "fixes:\n  - {id: a, wrong: 1}\n"):
        p.write_text(broken)
        with pytest.raises(Exception):  # noqa: B017
            curation.curated(spark, str(p), "id string, remove string", "fixes").collect()
    with pytest.raises(OSError):
        curation.curated(spark, str(tmp_path / "none.yaml"), "id string")


def test_curation_is_tied_to_the_text(spark):
    blocks = spark.createDataFrame([("a", "art1", 1, "One NE: gone here."), ("b", "art1", 2, "two"), ("c", "art1", 3, "three")], "id string, article string, pos int, text string")
    note = spark.createDataFrame([("a", "NE: gone ")], "id string, remove string")
    out, log = curation.without_notes(blocks, note)
    assert out.where("id = 'a'").first()["text"] == "One here." and log.first()["rule"] == "note"
    with pytest.raises(Exception, match="isn't in the text"):
        curation.without_notes(blocks, note.withColumn("remove", F.lit("else")))[0].collect()
    with pytest.raises(Exception, match="left in"):
        curation.without_notes(blocks, note.withColumn("remove", F.lit("here")))[0].collect()
    with pytest.raises(ValueError, match="not there"):
        curation.without_notes(blocks, note.withColumn("id", F.lit("z")))
    fixes = spark.createDataFrame([("b", "tw", "r1"), ("c", "three", "r2")], "id string, begins string, reason string")
    merged, log = curation.merged_back(blocks, fixes)
    assert [(r["id"], r["text"]) for r in merged.collect()] == [("a", "One NE: gone here. two three")] and log.first()["reason"] == "r1; r2"
    with pytest.raises(Exception, match="another text begins"):
        curation.merged_back(blocks, fixes.withColumn("begins", F.lit("x")))[0].collect()
    words = spark.createDataFrame([("b", "two", "2", ["Lei 1"])], "id string, was string, becomes string, norms array<string>")
    assert curation.replaced(blocks, words)[0].where("id = 'b'").first()["text"] == "2"
    with pytest.raises(Exception, match="than was checked"):
        curation.replaced(blocks, words.withColumn("was", F.lit("2")))[0].collect()


# --- reports --------------------------------------------------------------------------------------------


def test_report_files_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    for _ in range(2):
        reports.logged(df, str(tmp_path / "log"))
        reports.report(df, str(tmp_path / "json"))
        reports.report(df.orderBy("k"), str(tmp_path / "md"), "md", "Title")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()] == [{"k": 1, "v": "a|b"}, {"k": 2}]
    assert "".join(f.read_text() for f in (tmp_path / "md").glob("part-*")).splitlines() == ["# Title", "", "| k | v |", "| --- | --- |", "| 1 | a b |", "| 2 |  |"]


def test_bodies_have_no_orphans(spark, tmp_path):
    docs = spark.createDataFrame([("a", "<p>1", "A"), ("b", "<p>2", "B")], "id string, html string, title string")
    reports.bodies(docs, str(tmp_path))
    reports.bodies(docs.where("id = 'a'"), str(tmp_path))
    assert reports.body_of(spark, str(tmp_path), "a").first()["html"] == "<p>1" and reports.body_of(spark, str(tmp_path), "b").count() == 0


def test_norms_names_and_arrays(spark):
    assert one(spark, compare.norms_named("x"), x="Altera a Lei nº 11.343, de 2006, e o Decreto-Lei 2.848, de 1940; a Lei nº 11.343, de 2006") == ["Lei 11.343/2006", "DL 2.848/1940"]
    df = spark.createDataFrame([(1, "CÓDIGO PENAL"), (2, "o código penal militar de 1969"), (3, "x"), (4, "codigo penal")], "k int, t string")
    names = spark.createDataFrame([("código penal", "cp"), ("Código Penal Militar", "cpm")], "n string, v string")
    assert {r["k"]: r["v"] for r in compare.matched_names(df, names, "t", "n", "v").collect()} == {1: "cp", 2: "cpm", 3: None, 4: "cp"}
    rows = spark.createDataFrame([(1, 2, ["b", "c"]), (1, 1, ["a", "b"]), (2, 1, None)], "k int, o int, x array<string>")
    assert [(r["k"], r["x"]) for r in relate.joined_arrays(rows.where("x IS NOT NULL"), "k", "x", "o").collect()] == [(1, ["a", "b", "c"])]
    assert relate.having_any(rows, "x", ["c", "z"]).count() == 1
    turns = spark.createDataFrame([(1, 1, "T", None), (1, 2, None, "own"), (1, 3, None, "x")], "g int, o int, y string, own string")
    assert [(r["o"], r["own"], r["carried"]) for r in ordered.carried_conflicts(turns, ["g"], ["o"], F.col("y"), F.col("own")).collect()] == [(2, "own", "T")]


def test_a_brief_is_whole_or_stops(spark):
    cases = spark.createDataFrame([("c1", {"drug": "true"}), ("c2", {})], "case string, facts map<string,string>")
    theses = spark.createDataFrame([("t1", {"drug": "true"}, "see {{cite:a}}", ["b"], "pending"), ("t2", {}, "{{cite:b}} and {{cite:a}}", None, None)], "thesis string, trigger map<string,string>, template string, grounds array<string>, review string")
    blocks = spark.createDataFrame([("a", dt.date(2025, 1, 1), ["Lei 1"], dt.date(2024, 1, 1)), ("b", None, None, dt.date(2024, 1, 1))], "id string, checked_at date, changed_by array<string>, day date")
    out = {r["case"]: r for r in reports.brief(cases, theses, blocks, relate.facts_apply(F.col("trigger"), F.col("facts"))).collect()}
    assert (out["c1"]["cited"], out["c1"]["checked"], out["c1"]["pending"]) == (["a", "b"], ["a"], ["t1"]) and (out["c2"]["cited"], out["c2"]["pending"]) == (["a", "b"], [])
    with pytest.raises(ValueError, match="citations of nothing"):
        reports.resolved(theses, blocks.where("id = 'a'"), "thesis")


def test_answers_and_threads(spark):
    assert one(spark, answers.without_ids(F.col("x")), x="It holds (lei_1_art33_p4) , so [lei_1_art7-a] it is.") == "It holds, so it is."
    hits = spark.createDataFrame([(1, 2, "B", "two"), (1, 1, "A", "one")], "g int, o int, l string, t string")
    assert answers.contexts(hits, "g", "o", F.col("l"), F.col("t")).first()["context"] == "A\none\n\nB\ntwo"
    turns = spark.createDataFrame([(1, i, "x" * 400, ["a", "a", "b!", "c", "d", "e", "f"]) for i in range(5)], "k int, turn int, text string, ids array<string>")
    rows = answers.clean_thread(turns, "k", "turn", "text", "ids").collect()
    assert sorted(r["turn"] for r in rows) == [2, 3, 4] and all(len(r["text"]) == 300 and r["ids"] == ["a", "c", "d", "e"] for r in rows)


def test_scopes_and_sentences(spark):
    scope = lambda arts, t: one(spark, compare.precedent_scope(F.split("a", ","), "t", "droga", ["art59"], "furto"), a=arts, t=t)
    assert [scope("art59", "Drogas e furto"), scope("art59", "furto"), scope("art1", "FURTO"), scope("art1", "x")] == ["drugs", "general", "special", None]
    s = F.struct(F.lit(60.0).alias("base"), F.lit(62.0).alias("provisoria"), F.lit(62).alias("definitiva"), F.lit(500).alias("multa"), F.lit("semiaberto").alias("regime"))
    assert one(spark, sentence.memorial(F.lit("art. 33"), s)) == "art. 33: pena-base 5 anos; provisória 5 anos e 2 meses; definitiva 5 anos e 2 meses, 500 dias-multa, regime semiaberto."


# --- streams --------------------------------------------------------------------------------------------


def test_events_come_once_and_rates_are_refused(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, 7, at(0)), (1, 7, at(0)), (2, 7, at(1)), (3, 7, at(2)), (4, 7, at(3)), (5, 8, at(3))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    landed = lambda: collect.stream(spark, str(tmp_path / "in"), df.schema)

    def run(frame, name):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["event_id"] for r in run(collect.unique(landed()), "once")) == [1, 2, 3, 4, 5]
    got = run(collect.refusals(collect.unique(landed()), late=None), "rates")
    assert sorted((r["user_id"], r["in_window"], r["refused"]) for r in got) == [(7, 1, False), (7, 2, False), (7, 3, False), (7, 4, True), (8, 1, False)]
    assert collect.recent(df, F.lit(at(3)), "1 minute").count() == 3


def test_sql_functions(spark):
    collect.register(spark)
    row = spark.sql("SELECT norm('ÁÉ ő') AS a, norm_arr(array('É', NULL)) AS b, arr_join(array('x', 'y'), '-') AS c, arr_join(NULL, ' ') AS d").first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("ae o", ["e", None], "x-y", "")


def test_windows_of_a_full_join_are_not_ranked(spark):
    """A leg's places are given before legs are fused: an id of another leg never moves them."""
    a = search.ranked(spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "query_id int, id long, dist double"), F.col("dist"), F.col("id"))
    b = search.ranked(spark.createDataFrame([(1, 3, 9.0), (1, 2, 8.0)], "query_id int, id long, lex double"), F.col("lex").desc(), F.col("id"))
    out = {r["id"]: r for r in search.fused({"vector": a, "lexical": b}).collect()}
    assert {i: (r["vector_pos"], r["lexical_pos"]) for i, r in out.items()} == {1: (1, None), 2: (2, 2), 3: (None, 1)}


def test_best_overlaps_leave_out_surpassed_rows_alone(spark):
    rng = random.Random(5)
    rows = [(k, sorted(x for x in "abcdefgh" if rng.random() < 0.8)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, own array<string>")
    asked, all_of = df.where("k % 10 = 0"), df.select(F.col("k").alias("other"), F.col("own").alias("theirs"))
    pairs = relate.overlapping(asked, all_of, "k", "other", "own", "theirs", 3).where("k <> other").cache()
    assert pairs.count() < 30 * 299 / 4
    found = {(r["k"], r["other"], r["shared"], r["rank"]) for r in relate.best_overlaps(pairs, "k", "other", 3).collect()}
    want = set()
    for k, own in rows[::10]:
        each = sorted((-len({*own} & {*x}), o) for o, x in rows if o != k and {*own} & {*x})
        want |= {(k, o, -n, i + 1) for i, (n, o) in enumerate(each[:3])}
    assert found == want


def test_precedents_are_met_by_those_that_none_surpasses(spark, monkeypatch):
    known = spark.range(1, 400).select(F.col("id").alias("p"), F.sequence(F.lit(1), F.lit(9)).alias("own"), F.lit("ok").alias("status"), F.lit("t").alias("thesis"))
    asked = spark.range(50).select(F.col("id").alias("c"), F.sequence(F.lit(1), F.col("id") % 9 + 1).alias("want"))
    made = []
    best = relate.best_overlaps
    monkeypatch.setattr(relate, "best_overlaps", lambda pairs, *rest: (made.append(pairs.count()), best(pairs, *rest))[1])
    found = relate.citable_overlaps(asked, known, "c", "p", "want", "own", F.col("status") == "ok", "thesis").collect()
    assert {tuple(r) for r in found} == {(i, r, i % 9 + 1, r) for i in range(50) for r in (1, 2, 3)} and made[0] == 50 * 4


def test_of_rows_with_the_same_items_the_first_are_met_however_many_sets_there_are(spark):
    rows = [(k, [*"abcdefghi", f"i{k % 200}"]) for k in range(2_000)]  # 200 sets of ten rows each, of which none surpasses another
    known = spark.createDataFrame(rows, "p long, own array<string>")
    asked = spark.createDataFrame(rows[:200], "c long, want array<string>")
    pairs = relate.overlapping(asked, known, "c", "p", "want", "own", 3).cache()
    found = {(r["c"], r["p"], r["shared"], r["rank"]) for r in relate.best_overlaps(pairs, "c", "p", 3).collect()}
    assert found == {(c, c + 200 * i, 10, i + 1) for c in range(200) for i in range(3)}
    assert pairs.count() == 200 * 200 * 4


def test_a_difference_makes_no_value_of_a_character(spark):
    cases = [("aé€😀z", "aè€😁z", ("a", "é€😀", "è€😁", "z")), ("aa", "aaa", ("aa", "", "a", "")), ("xé", "xè", ("x", "é", "è", "")), ("éx", "ãx", ("", "é", "ã", "x")), ("", "", ("", "", "", ""))]
    long = "é" * 100_000
    cases += [(long + "a" + long, long + "b" + long, (long, "a", "b", long)), (None, "x", (None,) * 4), ("x", None, (None,) * 4)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", text.difference("a", "b").alias("d"))
    assert {r["i"]: tuple(r["d"]) for r in df.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_question_is_read_once(spark):
    ask = ["réu preso com 2,5 kg perto de escola, confessou", "não é reincidente; furto de madrugada", None]
    df = spark.createDataFrame([(x,) for x in ask], "x string").select(sentence.read_from("x").alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [
        ("lei_11343_2006_art33", ["confissao", "proximidade", "quantidade expressiva"], 2500.0), ("dl_2848_1940_art155", ["repousoNoturno"], None), (None, [], None)
    ]
    facts = spark.createDataFrame([], "x string").select(sentence.facts_in("x").alias("f"))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("latrocinio") <= 3


def test_an_answer_is_held_against_its_own_sources_in_its_row(spark):
    raw = ['{"paragraphs":[{"text":"a","citations":[1,5]},{"text":"ж"}],"sources":[{"id":1,"doc_id":"x"},{"id":2,"doc_id":"y"}]}', '{"paragraphs":[],"sources":[{"id":5,"doc_id":null}]}', None]
    given = spark.createDataFrame([*enumerate(raw)], "answer_id int, raw string")
    found = answers.violations(given, spark.createDataFrame([(0, "x"), (1, "y")], "answer_id int, doc_id string"))
    want = [(0, "orphan citation", "5"), (0, "no citation", "2"), (0, "other script", "2"), (0, "unknown source", "y"), (1, "empty", ""), (1, "unknown source", None), (2, "shape", "")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") <= 3  # the answers twice, and what was retrieved
