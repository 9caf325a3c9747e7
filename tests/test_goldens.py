"""Known values of the operators that no SQL expresses, and the streaming path."""

import datetime as dt
import random

from pyspark.sql import functions as F

from verbatlas.functions import blocks, text
from verbatlas.operators import compare, ordered, relate, search
from verbatlas.plans import catalog
from verbatlas.streaming import collect

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return {r["n"]: r for r in catalog.QUERIES[name](spark, SF).collect()}


def test_first_place_of_the_term_leg(spark):
    leg = spark.createDataFrame([(1, 7, 1)], "query_id int, id long, pos int")
    hit = search.fused({"term": leg}, {"term": 3.0}).first()
    assert hit["id"] == 7 and round(hit["score"], 6) == 0.04918


def test_nearest_vectors_by_products_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = df.where("id % 20 = 0 AND id < 400").select(F.col("id").alias("query_id"), "vector")
    every = search.ranked(search.vector_leg(df, asked, None).drop("pos"), F.col("dist"), F.col("id"), cap=6)
    assert sorted(map(tuple, search.vector_leg(df, asked, 6).collect())) == sorted(map(tuple, every.collect()))
    usual = df.where("id < 900")
    assert search.near(search.normed(usual), search.normed(asked).select("query_id", F.col("vector").alias("__q"), F.col("norm").alias("__n")), 6).count() < 20 * 440 / 4


def test_terms_are_counted_without_pairs_of_copies(spark):
    terms = spark.range(600).select(F.col("id").alias("term_id"), F.when(F.col("id") % 3 == 0, "Ação de Despejo").when(F.col("id") % 3 == 1, "acao de despejo rural").otherwise("short").alias("term"))
    asks = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") == 7, "nothing").when(F.col("id") == 8, "Short").otherwise("a ACAO DE DESPEJO rural e mais").alias("query"))
    counts = search.term_counts(asks, terms)
    found = {tuple(r) for r in counts.collect()}
    assert found == {(i, 200, 2) if i == 8 else (i, 400, 0) for i in range(300) if i != 7}
    pairs = search.matched_terms(asks.where("query_id < 12"), terms.withColumn("variants", F.array().cast("array<string>"))).groupBy("query_id").agg(F.count("*"), F.min("term_id"))
    assert {tuple(r) for r in pairs.collect()} == {r for r in found if r[0] < 12}


def test_ids_that_no_document_has_take_no_place(spark):
    docs = spark.createDataFrame([(1, "a", "apple pie"), (2, "b", "apple tart")], "id long, title string, text string")
    vectors = spark.createDataFrame([(9, [1.0, 0.0]), (2, [0.9, 0.1]), (1, [0.0, 1.0])], "id long, vector array<double>")
    terms = spark.createDataFrame([(1, "apple", [])], "term_id int, term string, variants array<string>")
    edges = spark.createDataFrame([(1, 8, "principal", 9), (1, 2, "related", 1)], "term_id int, id long, role string, weight int")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    hits = search.hybrid(docs, vectors, terms, edges, "apple", asked).orderBy("place").collect()
    assert [(r["id"], r["term_pos"], r["vector_pos"]) for r in hits] == [(2, 1, 1), (1, None, 2)]


def test_norms_named(spark):
    said = ["Transformada na Lei nº 15.164 de 14/07/2025", "Aguardando parecer", "Convertida na Lei Complementar 200, de 2023"]
    df = spark.createDataFrame([(x,) for x in said], "x string").select(compare.became_norm("x"), compare.norm_named("x"))
    assert [tuple(r) for r in df.collect()] == [(True, "Lei 15.164/2025"), (False, None), (True, "LC 200/2023")]
    found = rows(spark, "q_norm_named")
    assert all(r["became"] == (n % 4 != 1) for n, r in found.items()) and len(found) > 1000


def test_a_longer_number_is_no_target(spark):
    found = rows(spark, "q_change_filter")
    assert {r["targets"] for n, r in found.items() if n % 7 == 0} == {"lei_11343_2006"} and {r["targets"] for n, r in found.items() if n % 7 in (2, 3, 6)} == {""}


def test_ordinals_and_headings(spark):
    first = next(r for n, r in rows(spark, "q_heading_split").items() if n % 8 == 0)
    assert (first["heading"], first["title"]) == ("CAPÍTULO III – Da Aplicação da Pena", "Fixação da pena")


def test_a_word_behind_a_number_keeps_its_first_letter(spark):
    said = ["§ 12 orwher thouanan", "§ 12 o juiz", "§ 1o Texto", "§ 1 º Texto", "§ 2º-A. Texto", "§ 1oTexto", "Art. 5 os bens"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    found = df.select(F.coalesce(blocks.block("x")["text"], F.regexp_replace("x", blocks.ARTICLE, ""))).collect()
    assert [r[0] for r in found] == ["orwher thouanan", "o juiz", "Texto", "Texto", "Texto", "Texto", "os bens"]
    assert df.limit(1).select(text.without_marker("x", F.lit("paragrafo"))).first()[0] == "orwher thouanan"


def test_an_address_is_no_number_with_thousands_points(spark):
    said = ["el no 88.105.82.241 mi", "el no 88.105.182.241", "do no 1.234.", "do no 1.234.567, de", "do no 12.848"]
    df = spark.createDataFrame([(x,) for x in said], "x string").select(*text.ordinals("x"))
    assert [tuple(r) for r in df.collect()] == [(said[0], 0), (said[1], 0), ("do nº 1.234.", 1), ("do nº 1.234.567, de", 1), ("do nº 12.848", 1)]


def test_nested_children_of_nothing(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, x string")
    out = {r["k"]: r for r in relate.with_children(parents, children, "k", "o", ["x"]).collect()}
    assert [c["x"] for c in out[1]["children"]] == ["a", "b"] and out[2]["children"] == []


def test_rate_counts_the_call_itself(spark):
    calls = spark.createDataFrame([("u", i * 1000) for i in range(5)], "k string, ms long")
    out = ordered.over_rate(calls, "k", F.col("ms"), 3, 60_000).orderBy("ms").collect()
    assert [r["refused"] for r in out] == [False, False, False, True, True]


def test_stream_merges_what_landed_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    merge = collect.upsert_into(str(tmp_path / "out"), ["user_id"], "ts")
    for _ in range(2):  # the second run finds nothing new
        landed = collect.stream(spark, str(tmp_path / "in"), events.schema, files_at_once=1)
        collect.run_once(landed, merge, str(tmp_path / "checkpoint"))
    assert len([*tmp_path.glob("out/v*")]) == 2
    newest = collect.newest(spark, str(tmp_path / "out")).collect()
    latest = {}
    for r in events.collect():
        latest[r["user_id"]] = max(latest.get(r["user_id"], r["ts"]), r["ts"])
    assert {r["user_id"]: r["ts"] for r in newest} == latest and len(newest) == len(latest)


def test_a_late_row_replaces_no_newer_one(spark, tmp_path):
    merge = collect.upsert_into(str(tmp_path), ["k"], "at")
    batch = lambda *rows: spark.createDataFrame(rows, "k int, at int, v string")
    merge(batch((1, 5, "a"), (None, 1, "n")), 0)
    merge(batch((1, 3, "late"), (2, 1, "b")), 1)
    for _ in range(2):  # run again: the same
        merge(batch((2, 1, "again"), (None, 2, "m")), 2)
        assert {(r["k"], r["v"]) for r in collect.newest(spark, str(tmp_path)).collect()} == {(1, "a"), (2, "again"), (None, "m")}


def test_windows_and_sessions_count_every_event(spark):
    events = spark.createDataFrame([(i, i % 2, dt.datetime(2024, 1, 1, i % 5, 10), "view", 1.5) for i in range(20)], "event_id long, user_id long, ts timestamp, event_type string, value double")
    by_hour = collect.counts_by_window(events).collect()
    assert sum(r["n"] for r in by_hour) == 20 and len(by_hour) == 5
    assert sum(r["n"] for r in collect.sessions(events).collect()) == 20
