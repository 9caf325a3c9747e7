"""Inputs that must not stop a job, fill a memory or take more time than their size: pages, records, parts, personal data."""

import gzip
import json
import os
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import html_leaves, pii, sentencepiece_bpe, toxicity, warc

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("piece", ["<a ", "<!", '<a "', "<script", "</", "<a b='", '<p class="a" ', "<x/", "<!--", "<style>x"])
def test_ten_megabytes_of_broken_markup(piece):
    page, start = piece * (10_000_000 // len(piece)), time.process_time()
    html_leaves.parsed(page)
    assert time.process_time() - start < 2


@pytest.mark.parametrize("make", [lambda n: "<a '>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<li><div>" + "<b>" * n + "<li>" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<a \"'>" * n + '"'])
def test_time_is_in_proportion_to_the_page(make):
    def seconds(n):
        start = time.process_time()
        html_leaves.parsed(make(n))
        return time.process_time() - start

    seconds(2000)
    assert seconds(160_000) < 40 * seconds(10_000) + 0.5


def test_broken_tags_are_read_as_far_as_they_go():
    def text(page):
        return [x.text for x in html_leaves.parsed(page).leaves]

    assert text('<p title="a>b">one</p><p title="a>two</p>') == ["one", "two"]
    assert text("<p>one<b class='x>y'>two</b></p>") == ["onetwo"]
    assert text("<p>one < two <3 <p>three") == ["one < two <3", "three"]
    assert text("<p>one<script>if (a<b) '</p>'</script> two<script>x") == ["one two"]
    assert text("<p>one<!-- <p>two --><p>three<!-- four") == ["one", "three"]
    assert text("<i><div>one</i>two</div>three") == ["onetwo", "three"]


def record(block, **more):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a.example/"} | more
    return warc.Record([*fields.items(), ("Content-Length", str(len(block)))], block).to_bytes()


def message(payload, *headers, status="200 OK"):
    return f"HTTP/1.1 {status}\r\n".encode() + "".join(f"{h}\r\n" for h in headers).encode("latin-1") + b"\r\n" + payload


def chunks(data, size=7):
    return b"".join(b"%x;name=value\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


def test_encodings_and_charsets_of_responses():
    page = "<title>Über</title><p>añño ěščř €"
    latin, east = page.encode("cp1252", "ignore"), page.encode("iso8859-2", "ignore")
    deflate = zlib.compressobj(wbits=-15)
    raw_deflate = deflate.compress(page.encode()) + deflate.flush()
    cases = [
        (page.encode(), [], "utf-8", "añño ěščř €"),
        (latin, ["Content-Type: text/html; charset=ISO-8859-1"], "cp1252", "añño š €"),
        (b'<meta charset="iso-8859-2">' + east, [], "iso8859-2", "ao ěščř"),
        (b"\xef\xbb\xbf" + page.encode(), ["Content-Type: text/html; charset=latin1"], "utf-8", "añño ěščř €"),
        (page.encode("utf-16"), [], "utf-16-le", "añño ěščř €"),
        (page.encode(), ["Content-Type: text/html; charset=no-such-one"], "utf-8", "añño ěščř €"),
        (gzip.compress(page.encode()), ["Content-Encoding: gzip"], "utf-8", "añño ěščř €"),
        (gzip.compress(page.encode()[:20]) + gzip.compress(page.encode()[20:]), ["content-encoding: GZIP"], "utf-8", "añño ěščř €"),
        (zlib.compress(page.encode()), ["Content-Encoding: deflate"], "utf-8", "añño ěščř €"),
        (raw_deflate, ["Content-Encoding: deflate"], "utf-8", "añño ěščř €"),
        (chunks(gzip.compress(page.encode())), ["Transfer-Encoding: chunked", "Content-Encoding: gzip"], "utf-8", "añño ěščř €"),
        (chunks(page.encode()), ["Transfer-Encoding: chunked"], "utf-8", "añño ěščř €"),
    ]
    for payload, headers, charset, want in cases:
        meta, conversion = warc.derived(warc.record_from(record(message(payload, *headers))))
        about = json.loads(meta.block)
        assert about["payload"]["charset"] == charset and about["payload"]["digest"] == warc.digest(payload), headers
        assert conversion.block.decode().split("\n")[-1] == want, headers
        assert about["payload"]["codings"] == [h.split(": ")[1].lower() for h in headers if "coding" in h], headers


def test_no_record_stops_the_job(spark):
    page = b"<p>text</p>"
    blocks = [
        message(page, status="²00 OK"), message(page, status="9" * 400), message(page, "Content-Length: ²"), message(gzip.compress(page)[:-9], "Content-Encoding: gzip"), message(b"junk", "Content-Encoding: gzip"),
        message(b"zz\r\nno chunk", "Transfer-Encoding: chunked"), message(page, "Content-Type: text/html; charset=hex"), message(page, "Content-Type: text/html; charset=idna"), message(b"\xff\xfe\x00", "Content-Type: x"), b"", b"\r\n\r\n",
        message(b"<p>" + bytes(range(256)) * 10, "Content-Type: text/html; charset=punycode"), b"HTTP", message(b"<title>" * 1000),
    ]
    rows = [(i, record(b), "clash", 1) for i, b in enumerate(blocks)] + [(100, None, "x", 2), (101, b"WARC/1.1\r\n\r\n", "x", 3), (None, record(blocks[0]), None, None), (5, record(blocks[0]), "y", 4)]
    df = spark.createDataFrame(rows, "page_id long, record binary, record_type string, content_length int")
    out = warc.derivatives(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r["record_type"])
    assert set(by) == {i for i, *_ in rows} and all(sorted(v) in (["conversion", "metadata"], ["malformed"]) for k, v in by.items() if k != 5)
    assert by[0] == ["metadata", "conversion"] and sorted(by[5]) == ["conversion"] * 2 + ["metadata"] * 2
    assert by[100] == by[101] == ["malformed"]


def test_kept_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_BYTES", 20_000)
    own = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model())
    texts = [f"word{i} and more{i % 7} " + "x" * (i % 60) for i in range(2000)]
    ids = [own.encode([t])[0] for t in texts]
    assert ids == [np.array(own.sp.encode(t, add_bos=True, add_eos=True), np.uint32).tobytes() for t in texts]
    for some in (own.kept.young, own.kept.old):
        assert 0 < sum(map(sys.getsizeof, some)) + sum(map(sys.getsizeof, some.values())) + 100 * len(some) <= 20_000 + 500
    assert "▁and" in own.kept.young  # what is met again stays


def test_a_text_with_very_many_addresses_is_many_rows(spark):
    n = 5000
    text = " ".join(f"word{i % 50} other{i} user{i}@host{i % 3}.example" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "a plain text"), (3, None)], "doc_id long, text string")
    rows = pii.found(pii.keyed(docs))
    assert rows.where("c IS NULL").count() == 3 and rows.where("c IS NOT NULL").count() > 100_000
    assert rows.selectExpr("max(length(c) + length(t))").first()[0] < 200
    assert rows.where("c IS NOT NULL AND first").groupBy("c", "t").count().where("count > 1").isEmpty()
    out = {r["doc_id"]: r["base"] for r in pii.spans_of(docs).collect()}
    assert out[1].count("email:") == n and out[2] == out[3] == ""


def test_lists_for_the_driver_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile rotten words " if i % 2 else "kind gentle words ") + f"number {i}", "clash") for i in range(400)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(400)], "doc_id long, toxic int, text string")
    whole = toxicity.classified(docs, labels).collect()
    rows = toxicity.featured(toxicity.sample(docs, labels)[0])
    every = toxicity.ratios(rows)
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 3000)
    fewer = toxicity.ratios(rows)
    kept = np.flatnonzero(fewer)
    counts = {r[0]: r[1] for r in rows.select(F.explode("f").alias("f")).groupBy("f").count().collect()}
    assert 0 < sum(counts[f] for f in kept) <= 3000 < sum(counts[f] for f in np.flatnonzero(every))
    assert np.abs(every[kept]).min() >= np.abs(every[np.setdiff1d(np.flatnonzero(every), kept)]).max() - 1e-12
    for out in (whole, toxicity.classified(docs, labels).collect()):
        assert all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_other_queries_stay_where_a_library_is_missing(tmp_path):
    """Without the tokenizer library the queries of this subpackage are left out, and no others."""
    (tmp_path / "sentencepiece.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(k.startswith('op') for k in q))"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 100 and int(got[1]) > 100 and got[2] == "False"
