"""Every reader over files that the tests write."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import html
from verbatlas.sources import readers


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


LAW = {
    "lei": "lei_1", "nome": "Lei 1", "fonte": "x", "total_artigos": 2,
    "artigos": [
        {"id": "lei_1_art1", "artigo": "1", "contexto": {"titulo": "T", "capitulo": None, "secao": None}, "caput": "Caput um", "incisos": [{"numero": "I", "texto": "I - a", "alineas": ["a) x", "b) y"]}, {"numero": "IV", "texto": "IV - b", "alineas": []}],
         "paragrafos": [{"numero": "4", "texto": "§ 4o Um", "incisos": []}, {"numero": "4", "texto": "§ 4o-A. Dois", "incisos": [{"numero": "II", "texto": "II - c", "alineas": []}]}]},
        {"id": "lei_1_art2", "artigo": "2", "contexto": None, "caput": "Caput dois", "incisos": [], "paragrafos": [{"numero": "Parágrafo único", "texto": "Parágrafo único. Fim", "incisos": []}]},
    ],
}


def test_a_law_is_flattened_in_document_order(spark, tmp_path):
    (tmp_path / "law.json").write_text(json.dumps(LAW), encoding="utf-8")
    out = readers.flattened(readers.laws(spark, str(tmp_path / "law.json"))).orderBy("ordem").collect()
    assert [(r["ordem"], r["id"].removeprefix("lei_1_"), (r["pai_id"] or "").removeprefix("lei_1_"), r["tipo"]) for r in out] == [
        (1, "art1", "", "caput"), (2, "art1_inc1", "art1", "inciso"), (3, "art1_inc1_ala", "art1_inc1", "alinea"), (4, "art1_inc1_alb", "art1_inc1", "alinea"), (5, "art1_inc4", "art1", "inciso"),
        (6, "art1_p4", "art1", "paragrafo"), (7, "art1_p4-a", "art1", "paragrafo"), (8, "art1_p4-a_inc2", "art1_p4-a", "inciso"), (9, "art2", "", "caput"), (10, "art2_pu", "art2", "paragrafo"),
    ]


def test_a_repeated_id_or_a_broken_file_stops(spark, tmp_path):
    twice = LAW | {"artigos": [LAW["artigos"][1], LAW["artigos"][1]]}
    (tmp_path / "twice.json").write_text(json.dumps(twice), encoding="utf-8")
    with pytest.raises(Exception, match="twice"):
        readers.flattened(readers.laws(spark, str(tmp_path / "twice.json"))).collect()
    (tmp_path / "broken.json").write_text('{"lei": ', encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        readers.laws(spark, str(tmp_path / "broken.json")).collect()


def test_yearly_files_that_are_complete(spark, tmp_path):
    act = {"id": "d1", "numero": "1", "epigrafe": "e", "sumula": "s", "publicado_em": "2024-02-21", "blocos": [{"id": "d1_b1", "ordem": 1, "rotulo": None, "texto": "t"}]}
    for year, complete, acts in ((2023, True, [act]), (2024, False, [act]), (2025, True, [])):
        (tmp_path / f"{year}.json").write_text(json.dumps({"ano": year, "completo": complete, "decretos": acts}))
    (tmp_path / "index.json").write_text("{}")
    assert rows(readers.yearly(spark, str(tmp_path)), "ano", "id") == [(2023, "d1")]
    assert readers.yearly(spark, str(tmp_path), 2024).count() == 0


def test_landed_responses_and_pages(spark, tmp_path):
    for n, ids in enumerate(([1, 2], [2, 3])):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"id": i, "x": f"v{i}"} for i in ids]))
    assert rows(readers.landed_json(spark, str(tmp_path), "id int, x string", ["id"]), "id", "x") == [(1, "v1"), (2, "v2"), (3, "v3")]
    pages = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), ("a", 3, []), ("a", 4, [9]), ("b", 1, [1]), ("b", 3, [2]), ("c", 1, [])], "l string, p int, items array<int>")
    assert rows(readers.until_stop(pages, "l", "p", "items"), "l", "p") == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(readers.until_stop(pages, "l", "p", "items", full=2), "l", "p") == [("a", 1), ("a", 2), ("b", 1)]


def test_a_csv_with_a_mark_and_line_ends(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿seq,tese\n"1","one\ntwo ""quoted"", comma"\n2,plain\n', encoding="utf-8")
    assert rows(readers.precedents_csv(spark, str(tmp_path / "p.csv"), "seq string, tese string"), "seq", "tese") == [("1", 'one\ntwo "quoted", comma'), ("2", "plain")]


def test_server_events(spark):
    raw = 'event: x\r\ndata: {"a": 1}\r\n\r\ndata: {"a":\ndata: 2}\n\n: ping\n\ndata: junk\n\ndata: [DONE]\n\ndata: {"a": 3}'
    df = spark.createDataFrame([(1, raw), (2, "")], "id int, raw string")
    assert rows(readers.server_events(df, "raw", "a int"), "id", "event.a") == [(1, 1), (1, 2)]


def test_xml_fields(spark):
    df = spark.createDataFrame([("<r><a n='1'>x</a><b>y</b></r>",)], "x string")
    assert df.select(*readers.xml_fields("x", {"a": "r/a", "n": "r/a/@n", "c": "r/c"})).first()[:] == ("x", "1", "")


def test_zipped_texts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.txt", "é".encode())
        z.writestr("two.txt", "é".encode("cp1252"))
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04 no archive")
    out = readers.zipped_texts(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["text"]) for r in out if r["problem"] is None) == [("d/one.txt", "é"), ("two.txt", "é")]
    assert [r["path"][-5:] for r in out if r["problem"]] == ["b.zip"]
    assert readers.decoded(b"\x81") == "�"


def test_keys_literals_and_listings(spark):
    df = spark.createDataFrame([("http://a", None), ("http://a", "b")], "url string, body string")
    keys = [r[0] for r in df.select(readers.cache_key("url", "body")).collect()]
    assert len(set(keys)) == 2 and all(len(k) == 24 for k in keys)
    src = spark.createDataFrame([("const a = `one\ntwo`;\nb: `three`",), ("no",)], "value string")
    assert rows(readers.template_literals(src, "a"), "literal") == [("one\ntwo",)] and rows(readers.template_literals(src, "b"), "literal") == [("three",)]
    pages = spark.createDataFrame([(1, "<li>a=1<li>b=2"), (2, "")], "id int, html string")
    assert rows(readers.listing(pages, "<li>([a-z])=([0-9])", {"k": 1, "v": 2}), "id", "pos", "k", "v") == [(1, 1, "a", "1"), (1, 2, "b", "2")]


def test_words_to_lines_to_paragraphs(spark):
    words = []
    for col, x in ((0, 50.0), (1, 350.0)):
        for line, text in enumerate((("Art. 1 Um come-", "ço de frase", "§ 1º Dois") if col == 0 else ("I - três", "quatro"))):
            for k, w in enumerate(text.split()):
                words.append(("d", 1, x + 40 * k, x + 40 * k + 35, 100.0 + 12 * line + k % 2, w))
    df = spark.createDataFrame(words, "doc string, page long, x0 double, x1 double, top double, text string").repartition(3)
    lines = readers.lines_of_words(df)
    assert [r["text"] for r in lines.orderBy("page", "col", "line").collect()] == ["Art. 1 Um come-", "ço de frase", "§ 1º Dois", "I - três", "quatro"]
    assert [r["text"] for r in readers.paragraphs_of_lines(lines).orderBy("block").collect()] == ["Art. 1 Um começo de frase", "§ 1º Dois", "I - três quatro"]


def test_embedded_json_and_references(spark):
    df = spark.createDataFrame([('<script type="application/json" id=x>{"a": [1, 2]}</script>',), ("<p>none",)], "h string")
    assert [r[0] and r[0]["a"] for r in df.select(html.embedded_json("h", "a array<int>")).collect()] == [[1, 2], None]
    refs = spark.createDataFrame([("&#233;&#xE9;&eacute;&amp;lt; &nope; &#0; &amp &rarr;&#x1F600;",)], "t string")
    assert refs.select(html.unescaped(F.col("t"))).first()[0] == "ééé&lt; &nope; � &amp →😀"


def columns(lefts, top, rows, name, width=80):
    """Words of text columns that begin at ``lefts``: three words a line."""
    step = width / 3
    return [("d", 1, x + step * j, x + step * j + step - 4, top + 12.0 * r, f"{name}{c}.{r}.{j}") for c, x in enumerate(lefts) for r in range(rows) for j in range(3)]


def test_three_columns_under_a_title_and_over_a_footer(spark):
    title = [("d", 1, 20.0 + 60 * j, 78.0 + 60 * j, 10.0, f"t{j}") for j in range(5)]
    body = columns([20.0, 120.0, 220.0], 40.0, 6, "c")
    between = [("d", 1, 20.0 + 60 * j, 78.0 + 60 * j, 130.0, f"m{j}") for j in range(5)]
    more = columns([20.0, 170.0], 150.0, 4, "k", 130)
    rows = [*title, *body, *between, *more]
    df = spark.createDataFrame(rows[::-1], "doc string, page long, x0 double, x1 double, top double, text string")
    got = [r["text"] for r in readers.lines_of_words(df).orderBy("page", "line").collect()]
    want = ["t0 t1 t2 t3 t4"] + [" ".join(f"c{c}.{r}.{j}" for j in range(3)) for c in range(3) for r in range(6)] + ["m0 m1 m2 m3 m4"] + [" ".join(f"k{c}.{r}.{j}" for j in range(3)) for c in range(2) for r in range(4)]
    assert got == want


def test_one_column_with_a_wide_space_stays_one():
    words = [(10.0 + 30 * j, 36.0 + 30 * j, 12.0 * r) for r in range(8) for j in range(6)]
    assert readers.reading_order(words, 12.0) == [[*range(48)]]
    del words[2:4]  # a gap in one line
    assert len(readers.reading_order(words, 12.0)) == 1 and readers.reading_order([], 12.0) == []
