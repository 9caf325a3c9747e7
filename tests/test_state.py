"""Streams with state, tables by buckets, vector indexes and shown HTML, each against a plain version."""

import itertools
import json
import random
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.functions import markup
from verbatlas.operators import search, vectors
from verbatlas.streaming import collect, state

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    state.with_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def landed(spark, folder, rows, schema, n):
    """One file, in a folder that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    out = Path(folder) / "all"
    out.mkdir(exist_ok=True)
    for f in Path(f"{folder}/{n}").glob("*.parquet"):
        f.rename(out / f"{n}-{f.name}")
    return str(out)


def run(spark, df, tmp_path, name):
    """All that is there, in micro-batches, appended to a table."""
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(str(tmp_path / name)).collect()]


# --- state ----------------------------------------------------------------------------------------


def test_quota_goes_on_after_a_restart(spark, tmp_path):
    random.seed(3)
    start = datetime(2024, 1, 28)
    ticks = [(random.randint(1, 4), start + timedelta(hours=6 * i + random.random())) for i in range(60)]
    schema = "user_id long, ts timestamp"
    got = []
    for n, part in enumerate((ticks[:20], ticks[20:21], ticks[21:])):  # each run is a new query from the checkpoint
        where = landed(spark, str(tmp_path / "in"), part, schema, n)
        got = run(spark, state.quota(collect.stream(spark, where, schema, 1), most=3), tmp_path, "out")
    used, want = defaultdict(int), []
    for u, t in ticks:
        month = f"{t:%Y-%m}"
        allowed = used[u, month] < 3
        used[u, month] += allowed
        want.append((u, t, month, allowed, used[u, month]))
    assert sorted(got) == sorted(want) and {w[3] for w in want} == {True, False} and len({w[2] for w in want}) == 2


DOCS = [
    json.dumps({"paragraphs": [{"text": "Olá \"mundo\" \\ \n\t fim", "citations": [1]}, {"text": "𝄞 é \u0001"}], "textual": "no", "other": "text", "text": ""}),
    json.dumps({"text": "plain"}, ensure_ascii=True), '{"text" :\n "a\\u00e9\\ud834\\udd1eb\\ud834x\\udd1e\\/\\q\\u12zz"', '{"text"text":"x","text"::"y","text":"z', '{"te\\"text":"q"}', "", '"text":"', '{"text": 5, "text": null, "text":"ok"}',
]


def whole(doc):
    return state.fed(state.Reader(), doc)[1]


def test_texts_of_json():
    assert whole(DOCS[0]) == "Olá \"mundo\" \\ \n\t fim\n\n𝄞 é \u0001\n\n\n\n"
    assert whole(DOCS[2]) == "aé𝄞b�x�/q�\n\n"
    assert whole(DOCS[3]) == "z" and whole(DOCS[4]) == "q\n\n" and whole(DOCS[7]) == "ok\n\n"


def test_every_cut_gives_the_same_texts():
    for doc in DOCS:
        want = whole(doc)
        for n in (1, 2):
            for cuts in itertools.combinations(range(len(doc) + 1), n) if n == 1 or len(doc) < 60 else ():
                r, out = state.Reader(), ""
                for a, b in itertools.pairwise([0, *cuts, len(doc)]):
                    r, more = state.fed(r, doc[a:b])
                    out += more
                assert out == want
        r, out = state.Reader(), ""
        for c in doc:
            r, more = state.fed(r, c)
            out += more
        assert out == want


def test_texts_of_a_stream_out_of_order(spark, tmp_path):
    random.seed(5)
    pieces = [(k, i, doc[j : j + 3]) for k, doc in enumerate(DOCS) for i, j in enumerate(range(0, len(doc), 3))]
    random.shuffle(pieces)
    schema = "id long, seq long, piece string"
    for n in range(3):
        where = landed(spark, str(tmp_path / "in"), pieces[n::3], schema, n)
        got = run(spark, state.texts(collect.stream(spark, where, schema, 1)), tmp_path, "out")
    text = defaultdict(str)
    for k, _, x in sorted(got):
        text[k] += x
    assert {k: v for k, v in text.items() if v} == {k: whole(d) for k, d in enumerate(DOCS) if whole(d)}


# --- joins and tables -----------------------------------------------------------------------------


def test_streams_meet_in_time(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    acts = [(i, day(i % 5)) for i in range(10)]
    details = [(i, day(i % 5 + i % 4), f"d{i}") for i in range(8)] + [(3, day(30), "too late"), (9, day(1), "before")]
    a, b = "id long, ts timestamp", "id long, other_ts timestamp, what string"
    for n in (0, 1):  # the details come first for half of the acts
        w1 = landed(spark, str(tmp_path / "a"), acts[n::2], a, n)
        w2 = landed(spark, str(tmp_path / "b"), details[1 - n :: 2], b, n)
    end = landed(spark, str(tmp_path / "a"), [(99, day(60))], a, 5), landed(spark, str(tmp_path / "b"), [(98, day(60), "x")], b, 5)
    assert end == (w1, w2)
    joined = collect.in_time(collect.stream(spark, w1, a, 1), collect.stream(spark, w2, b, 1), "id", within="2 days", late="40 days")
    got = {(r[0], r[3]) for r in run(spark, joined, tmp_path, "out") if r[0] < 90}
    batch = {(i, w) for i, t in acts for j, t2, w in details if i == j and t <= t2 <= t + timedelta(days=2)}
    met = {i for i, _ in batch}
    assert {x for x in got if x[1]} == batch and {i for i, w in got if w is None} <= {i for i, _ in acts} - met


def test_bucketed_upserts(spark, tmp_path):
    """Batches with late, repeated and null-keyed rows; a batch that runs twice; files written in proportion to what is new."""
    path = str(tmp_path / "t")
    merge = collect.upsert_buckets(path, ["k"], "at", buckets=16)
    random.seed(7)
    rows, table = [], {}
    for n in range(5):
        batch = [(random.choice([None, *range(300)]), random.randint(0, 50) + (20 if n != 2 else -40), f"{n}-{i}") for i in range(300 if n == 0 else 4)]
        best = {}
        for k, at, v in batch:
            if k not in best or at > best[k][0]:
                best[k] = (at, v)
        batch = [(k, at, v) for k, (at, v) in best.items()]
        frame = spark.createDataFrame(batch, "k int, at int, v string")
        merge(frame, n)
        if n in (1, 3):
            merge(frame, n)
        for k, at, v in batch:
            if k not in table or at >= table[k][0]:
                table[k] = (at, v)
        got = sorted(map(tuple, collect.bucketed(spark, path).select("k", "at", "v").collect()), key=str)
        assert got == sorted([(k, *x) for k, x in table.items()], key=str)
        size = sum(f.stat().st_size for f in Path(f"{path}/data/n={n}").rglob("*.parquet"))
        rows.append(size)
    merge(frame.limit(0), 9)
    assert max(rows[1:]) < rows[0] / 2 and len(collect.manifest(spark, path)) <= 16
    assert collect.manifest(spark, str(tmp_path / "none")) == {}


def test_look_back_never_goes_before_the_cut(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in range(1, 29)], "ts timestamp")
    now = F.lit(datetime(2024, 1, 20))
    assert collect.recent(df, now, "7 days").count() == 16
    assert collect.recent(df, now, "7 days", cut_at=F.lit(datetime(2024, 1, 18))).count() == 11
    assert collect.recent(df, now, "7 days", cut_at=F.lit(datetime(2023, 1, 18))).count() == 16


# --- vectors --------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_vector_index_recall(spark, tmp_path, kind, monkeypatch):
    """Under a tenth of the vectors compared exactly, recall against all pairs of 0.9 or more."""
    if kind == "given":
        e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    else:
        r = np.random.default_rng(1)
        x = np.repeat(r.normal(size=(25, 32)), 40, 0) + 0.2 * r.normal(size=(1000, 32))
        e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    e = e.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * (64 if kind == "given" else 32))], e.schema))
    asked = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["id"]): r["dist"] for r in search.vector_leg(e.where("id >= 0"), asked, 5).collect()}
    book = vectors.learnt(e)
    vectors.write(vectors.indexed(e, book), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert index.count() == e.where("id >= 0").count()
    monkeypatch.setattr(vectors, "AT_ONCE", 4)
    n = int(0.08 * index.count())
    for probes in (None, 4) if kind == "clustered" else (None,):
        got = {(r["query_id"], r["id"]): r["dist"] for r in vectors.nearest(index, e, asked, book, 5, n, probes).collect()}
        both = got.keys() & exact.keys()
        assert len(both) >= 0.9 * len(exact) and all(got[k] == exact[k] for k in both), (kind, probes, len(both), len(exact))


def test_vector_index_of_nothing(spark):
    e = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    assert vectors.learnt(e) is None
    some = spark.createDataFrame([(i, [float(i % 3), 1.0] * 8) for i in range(5)], "id long, vector array<double>")
    book = vectors.learnt(some)
    index = vectors.indexed(some, book)
    assert vectors.nearest(index, some, some.limit(0).withColumnRenamed("id", "query_id"), book, 3).count() == 0
    got = vectors.nearest(index, some, some.withColumnRenamed("id", "query_id"), book, 2).collect()
    assert len(got) == 10 and all(r["dist"] >= 0 for r in got)


# --- shown HTML -----------------------------------------------------------------------------------

EVASIONS = [
    "<script>alert(1)</script>", "<scr<script>ipt>alert(1)</script>", "<img src=x onerror=alert(1)>", "<a href='java&#115;cript:alert(1)'>x</a>", '<a href="java\tscript:alert(1)">x</a>', '<a href=" javascript:alert(1)">x</a>',
    "<a href=JaVaScRiPt:alert(1)>x</a>", "<svg/onload=alert(1)>", "<p style='background:url(javascript:x)'>x</p>", "<iframe src=//evil></iframe>", "<a href='data:text/html,<script>alert(1)</script>'>x</a>", '<p onclick="x" id=a>x',
    "<!--><script>alert(1)</script>-->", "<p <script>alert(1)</script>", '<a title="x>" href="vbscript:x" onclick=y>z</a>', "<textarea><script>alert(1)</script></textarea>", "<style>@import 'x'", "<math><mtext><script>x</script>", "<a href='javascript&colon;alert(1)'>x",
    "<a href='&#x6A&#x61&#x76&#x61script:alert(1)'>x", "<p/onclick=alert(1)//>", "<A HREF=https://a.example/?q=<script>>x</A>", "<base href=//evil>", "<form action=x><input>", "<p id='\"><script>alert(1)</script>'>x",
]


def test_nothing_unlisted_is_shown(spark):
    from html.parser import HTMLParser

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.tags = []

        def handle_starttag(self, tag, attrs):
            self.tags.append((tag, dict(attrs)))

        handle_startendtag = handle_starttag

    random.seed(2)
    cases = EVASIONS + ["".join(random.choices([*EVASIONS, "<", ">", '"', "'", "text", "</p>", " href="], k=3)) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", markup.sanitised("x").alias("y"))
    for r in df.select("x", "y", markup.sanitised("y").alias("z")).collect():
        assert r["y"] == r["z"], r["x"]
        seen = Seen()
        seen.feed(r["y"])
        seen.close()
        for tag, attrs in seen.tags:
            assert tag in markup.TAGS, (r["x"], r["y"])
            assert set(attrs) <= {*markup.EVERYWHERE, *markup.ATTRIBUTES.get(tag, []), "target", "rel"}, (r["x"], r["y"])
            address = "".join(c for c in attrs.get("href") or "" if c > " ").lower()
            assert not address.split("/")[0].split("?")[0].split("#")[0].count(":") or address.startswith(("http:", "https:", "mailto:")), (r["x"], r["y"])


def test_what_is_listed_stays(spark):
    cases = {
        '<p class="a">One &amp; <b>two</b><br>three</p>': '<p class="a">One &amp; <b>two</b><br>three</p>', "<TD colspan=2 style=x>y</TD>": '<td colspan="2">y</td>', "a < b > c": "a &lt; b &gt; c",
        "<a href='/x?a=1&amp;b=2' onclick=z>l</a>": '<a href="/x?a=1&amp;b=2" target="_blank" rel="noopener noreferrer nofollow">l</a>', '<a name="t1">x</a><a href="#t1">y</a>': '<a name="t1">x</a><a href="#t1" target="_blank" rel="noopener noreferrer nofollow">y</a>',
        "<center>kept text</center><font color=red>too</font>": "kept texttoo", "<p>x<script>gone</script>y": "<p>xy", "<p id=a id=b>": '<p id="a">', None: None, "": "", "mailto <a href=mailto:a@b.c>m</a>": 'mailto <a href="mailto:a@b.c" target="_blank" rel="noopener noreferrer nofollow">m</a>',
    }
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", markup.sanitised("x").alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == cases
