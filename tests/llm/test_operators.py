"""Each operator against a plain version, over rows with nulls, empty, long and repeated texts, ties
and columns whose names clash with new ones."""

import gzip
import hashlib
import itertools
import json
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tests.llm import held_out_pages
from verbatlas.llm import audio, html_blocks, html_leaves, mixing, pii, quality, queries, sentencepiece_bpe, sharding, simhash, toxicity, warc
from verbatlas.llm.common import join_dimension

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, slot string, fp string, kept string, score string, n_tokens string, terms string"
LONG = "lorem ipsum dolor sit amet " * 30_000
BASE = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day in may " * 6
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + "indeed", "en", "b"), (3, BASE + "indeed", "en", "b"), (4, "", "en", "a"), (5, None, None, None),
    (None, BASE, "en", "a"), (None, "only here, with id none", None, "b"), (6, LONG, "fr", "a"), (7, "écrit à jean@exemple.fr ou +33 1 23 45 67 89, ip 10.0.0.256 et 10.0.0.25", "fr", "b"),
    (8, "card 4111 1111 1111 1111 and 4111-1111-1111-1112\n\ncall +1 (555) 010-9999\ncall +1 (555) 010-9999", "en", "b"), (9, "word*** more### $$$ <b> " * 20, "en", "c"),
    (10, "a b \x1c c d", "de", "c"), (11, "\n \t\n", "de", "c"), (12, "x y", "de", "c"), (13, "\U0001f600 漢字 é " * 10, "ja", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, len(t or ""), "slot", "fp", "kept", "score", "n", "terms") for i, t, la, s in TEXTS]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("FALSE")


def by_text(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# --- 1 sharding -----------------------------------------------------------------------------------


def test_lookup_table_equals_turns_by_brute_force():
    names, size = [f"s{i}" for i in range(5)], 101
    prefer = [sharding.preference(n, size) for n in names]
    orders = [[(a + j * b) % size for j in range(size)] for a, b in prefer]
    slot = [-1] * size
    for turn in range(size):
        i = turn % len(names)
        slot[next(x for x in orders[i] if slot[x] < 0)] = i
    assert sharding.filled(names, size) == slot
    n = Counter(slot)
    assert max(n.values()) - min(n.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(16)]
    before, after = sharding.filled(names, 2003), sharding.filled(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 15)
    assert moved < 0.1 * 2003


@pytest.mark.parametrize("size", [100, 3, 1 << 21])
def test_sizes_that_cannot_be_filled_are_refused(size):
    with pytest.raises(ValueError):
        sharding.filled([f"s{i}" for i in range(5)], size)


def test_placement(docs, empty):
    out = sharding.placed(docs, F.col("doc_id"), ["a", "b", "c"], 101, instead=F.col("text")).collect()
    assert len(out) == len(TEXTS) and {r["shard"] for r in out} <= {"a", "b", "c"}
    table = sharding.filled(["a", "b", "c"], 101)
    for r in out:
        key = str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert sharding.placed(empty, F.col("doc_id"), ["a"], 101).count() == 0


# --- 2 mixing -------------------------------------------------------------------------------------


def rake(cells, powers, rounds):
    w = dict(cells)
    share = []
    for k, p in enumerate(powers):
        own = defaultdict(float)
        for c, n in cells.items():
            own[c[k]] += n
        t = {v: n**p if n else 0.0 for v, n in own.items()}
        share.append({v: x / sum(t.values()) for v, x in t.items()})
    total = sum(cells.values())
    for _ in range(rounds):
        for k in range(3):
            own = defaultdict(float)
            for c, x in w.items():
                own[c[k]] += x
            w = {c: x * share[k][c[k]] * total / own[c[k]] if own[c[k]] else 0.0 for c, x in w.items()}
    return w, share


def full_rate(want, cells):
    upto, steps = 0, sorted({int(np.floor(np.log(want[c] / cells[c]) * 16)) for c in cells})
    for s in steps:
        own = [c for c in cells if int(np.floor(np.log(want[c] / cells[c]) * 16)) == s]
        upto += sum(cells[c] for c in own)
        if upto >= mixing.FULL * sum(cells.values()):
            return max(want[c] / cells[c] for c in own)


@pytest.mark.parametrize("in_task", [20_000, 0])
def test_raking_reaches_the_marginals(spark, monkeypatch, in_task):
    monkeypatch.setattr(mixing, "CELLS_IN_TASK", in_task)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    cells = {(s, la, t): (ord(s) * 7 + ord(la) * 3 + ord(t)) % 50 + 1 for s, la, t in itertools.product("abc", "xy", "pq")}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r for r in mixing.raked(df).collect()}
    want, share = rake(cells, list(mixing.POWERS.values()), 30)
    top = full_rate(want, cells)
    for c in cells:
        assert got[c].weight == pytest.approx(want[c], rel=1e-5) and got[c].rate == pytest.approx(min(1, want[c] / cells[c] / top), abs=1e-5)
        assert got[c].residual <= 1e-6
    total = sum(cells.values())
    for k, d in enumerate(mixing.DIMENSIONS):
        for v, p in share[k].items():
            assert sum(r.weight for r in got.values() if r[d] == v) == pytest.approx(p * total, rel=2e-6)


def test_given_shares_are_met(spark):
    df = spark.createDataFrame([("a", "x", "p", 900), ("b", "x", "p", 100)], "source string, lang string, topic string, tokens long")
    r = {x.source: x for x in mixing.raked(df, shares={"source": {"a": 0.5, "b": 0.5}}).collect()}
    assert r["a"].rate == pytest.approx(1 / 9, abs=1e-6) and r["b"].rate == 1.0
    df = spark.createDataFrame([("a", "x", "p", 900), ("b", "y", "p", 100)], "source string, lang string, topic string, tokens long")
    out = mixing.raked(df, shares={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}}).first()  # no weights meet these
    assert out["residual"] > 0.1


def test_a_tiny_cell_does_not_shrink_the_sample(spark):
    df = spark.createDataFrame([("a", "x", "p", 6000), ("b", "x", "p", 4000), ("c", "x", "p", 1)], "source string, lang string, topic string, tokens long")
    r = {x.source: x.rate for x in mixing.raked(df, shares={"source": {"a": 0.5, "b": 0.4, "c": 0.1}}).collect()}
    assert r["c"] == r["b"] == 1.0 and r["a"] == pytest.approx(5 / 6, abs=1e-6)


def test_mixed_rows(docs, empty, monkeypatch):
    texts = Counter()
    for i, t, *_ in TEXTS:
        key = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        texts[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 2**48] += 1
    out = mixing.mixed(docs).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["rate"] <= 1 for r in out) and "text" not in out[0].asDict()
    got = Counter()
    for (i, n, u), k in texts.items():
        own = [r for r in out if r["doc_id"] == i and r["n_tokens"] == n]
        assert any(r["sampled"] == (u < r["rate"]) for r in own)
        got[i, n] += k
    assert got == Counter((r["doc_id"], r["n_tokens"]) for r in out)
    assert mixing.mixed(empty).count() == 0
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["sampled"] for r in out)


def test_a_large_dimension_is_joined_with_salt(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    dim = spark.createDataFrame([(None, "n"), (1, "one"), (2, "two")], "k long, v string")
    want = Counter((r.k, r.v) for r in join_dimension(df, dim, ["k"]).collect())
    assert Counter((r.k, r.v) for r in join_dimension(df, dim, ["k"], rows=10**9).collect()) == want and sum(want.values()) == 500


# --- 3 SentencePiece --------------------------------------------------------------------------------


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    return [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]


def test_ids_equal_the_library(docs, empty):
    out = sentencepiece_bpe.encoded(docs).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    for r, ids in zip(out, library([r["text"] for r in out]), strict=True):
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encoded(empty).count() == 0


def test_odd_texts_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CACHE", 10)
    e = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model())
    texts = [None, "", "  a  b ", "\n\n x\n", "<s> </s> ▁▁x ▁", "é漢字😀\x00\t a b", "a" * 5000, " " * 300 + "b", "x▁\n▁y", "ſﬁ…", "word,other.third!?"] * 2
    for _ in range(2):
        assert [np.frombuffer(i, np.uint32).tolist() for i in e.encode(texts)] == library(texts)
    assert e.merged("▁the") == ["▁the"] and np.frombuffer(e.part_ids("▁unusual-word"), np.uint32).tolist() == library(["unusual-word"])[0][1:-1]


def test_a_difference_from_the_library_stops(monkeypatch):
    e = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model())
    monkeypatch.setattr(e, "part_ids", lambda part: b"\x05\0\0\0")
    with pytest.raises(ValueError, match="differ"):
        e.encode(["some words"])


# --- 4 toxicity -------------------------------------------------------------------------------------


def test_features_are_the_distinct_ngrams():
    a, b = toxicity.features(["Abcd abcd", "abcd"])
    assert len(set(a.tolist())) == len(a) and set(b.tolist()) <= set(a.tolist())
    assert [x.tolist() for x in toxicity.features(["abcd"])] == [b.tolist()] and len(toxicity.features([None, "", "ab"])[1]) == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.classified(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    assert out.count() == docs.count()


def plain_model(rows, share):
    """The same by loops: {feature: weight}, intercept. ``rows``: (label, set of features), in order."""
    n = [Counter(f for y, fs in rows for f in fs if y == k) for k in (0, 1)]
    often = [f for f in n[0] | n[1] if n[0][f] + n[1][f] >= toxicity.LEAST_DOCS]
    total = [sum(1 + n[k][f] for f in often) for k in (0, 1)]
    ratio = {f: np.log(((1 + n[1][f]) / total[1]) / ((1 + n[0][f]) / total[0])) for f in often}
    ratio = {f: r for f, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    names = sorted(ratio)
    x = np.array([[ratio[f] if f in fs else 0.0 for f in names] for _, fs in rows])
    y = np.array([k for k, _ in rows], float)
    step = 4 / (2 * (x**2).sum(1).mean() + 1 + 4 * toxicity.PENALTY)
    w = v = np.zeros(len(names))
    b = vb = 0.0
    for i in range(toxicity.STEPS):
        err = (1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y) / len(y)
        nw, nb = v - step * (x.T @ err + toxicity.PENALTY * v / len(y)), vb - step * err.sum()
        v, vb = nw + i / (i + 3) * (nw - w), nb + i / (i + 3) * (nb - b)
        w, b = nw, nb
    return {f: a * ratio[f] for f, a in zip(names, w, strict=True)}, toxicity.balanced(x @ w, y, share)


@pytest.mark.parametrize("copies", [1, 30])
def test_model_and_scores_by_plain_steps(spark, copies):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("n")).drop("n")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = sorted(((str(r["doc_id"]), r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in text))
    rows = [(y, set(toxicity.features([text[int(i)]])[0].tolist())) for i, y in known]
    weights, intercept = plain_model(rows, np.mean([y for y, _ in rows]))
    assert toxicity.sample(many, labels)[0].count() == len(rows)
    got, b = toxicity.learn(many.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("toxic", F.col("toxic").cast("bigint")))
    assert set(np.flatnonzero(got).tolist()) == {f for f, w in weights.items() if w} and b == pytest.approx(intercept, abs=1e-6)
    assert max(abs(got[f] - w) for f, w in weights.items()) < 1e-5
    for r in toxicity.classified(docs, labels).limit(50).collect():
        margin = sum(weights.get(f, 0.0) for f in toxicity.features([text[r["doc_id"]]])[0].tolist()) + intercept
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4) and r["predicted"] == (r["score"] >= 0.5)


def test_no_labels_and_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 3) for r in toxicity.classified(docs, none).collect()} == {0.0}
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1), (3, 0, 1), (8, 1, 0), (9, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.classified(docs, odd).collect()
    assert len(out) == len(TEXTS) and all(r["held_out"] for r in out if r["doc_id"] is None)
    assert toxicity.classified(empty, odd).count() == 0


def test_intercept_stands_in_the_gap():
    assert toxicity.balanced(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1.0]), 0.5) == -3.0


# --- 5 HTML ------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">menu one</a></li><li><a href=/y>menu two</a></li></ul></nav>
<article><h1>A title &amp; more</h1><p>First  paragraph here, with <b>bold words<br>and a break.<p>Second &lt;one&gt;, also long enough to be read as text.</article>
<div class="comments"><h3>Comments</h3><p>nice post</p></div><footer>&copy; site</footer></body></html>"""


def test_leaves():
    page = html_leaves.parsed(PAGE)
    assert [x.text for x in page.leaves][2:5] == ["A title & more", "First paragraph here, with bold words and a break.", "Second <one>, also long enough to be read as text."]
    assert page.title == "T" and page.links == ["/x", "/y"] and page.leaves[0].linked == len("menu one")
    assert html_leaves.parsed(None).leaves == [] and html_leaves.parsed("<p>open <!-- never closed").leaves[0].text == "open"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><p>the text",
        "<head><meta name=a content=b><title>x</title><p>the text",
        "<head><title>x</title>the text",
        "<body><svg class='i' /><p>the text",
        "<body><svg-icon name=a><p>the text</p></svg-icon>",
        "<body><svg><path d='x'><p>the text",
        "<body><p><object data=x>the text</object>",
        "<body><p>the <math><mi>text</mi></math>",
    ],
)
def test_no_page_is_lost_by_its_form(page):
    assert [x.text for x in html_leaves.parsed(page).leaves] == ["the text"]


def test_scripts_styles_and_comments_alone_stay_out():
    page = html_leaves.parsed("<head><title>T <b>x</title><script>var a</script><style>p{}</style></head><p>a<!-- no --><script src=x>no</script><style>no</style> b<script>no")
    assert [x.text for x in page.leaves] == ["a b"]
    page = html_leaves.parsed("<noscript>1</noscript><template><p>2</p></template><textarea>3</textarea><iframe>4</iframe><select><option>5</select><object>6</object><svg><text>7</text></svg><p><math>8</math>")
    assert "".join(x.text for x in page.leaves) == "12345" + "67" + "8"


def test_two_line_breaks_bound_a_block():
    page = html_leaves.parsed("<td>one<br>two<br> <br/>three<br>&nbsp;<br>four<br><b>five</b><br><i><br>six</i>")
    assert [x.text for x in page.leaves] == ["one two", "three", "four five", "six"]


def test_vectors_read_whole_blocks_and_paths():
    def vectors(*pages):
        return [html_blocks.Vectors().of(html_leaves.parsed(p).leaves)[-1] for p in pages]

    long = "word " * 200
    a, b = vectors(f"<p>{long}one two three", f"<p>{long}six ten four")
    assert (a != b).any()
    names = " ".join("abcdefgh")
    a, b = vectors(f"<div class='{names} ad'>x", f"<div class='{names} body'>x")
    assert (a != b).any()
    inner = "<div>" * 12 + "x"
    a, b = vectors(f"<aside>{inner}", f"<article>{inner}")
    assert (a != b).any()
    deep = html_leaves.parsed("<article>" + "<div>" * 3000 + "in" + "</div>" * 3000 + "out</article>after").leaves
    assert [(x.text, x.path.depth) for x in deep] == [("in", 3001), ("out", 1), ("after", 0)]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_blocks.new_weights(rng).items()}
    x, mask, y = rng.normal(size=(2, 4, html_blocks.DIMS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        z, _ = html_blocks.logits(w, x, mask)
        p = html_blocks.sigmoid(z)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = html_blocks.gradients(w, x, mask, y)
    for name in w:
        at = tuple(rng.integers(s) for s in w[name].shape)
        keep = w[name][at]
        w[name][at] = keep + 1e-5
        up = loss()
        w[name][at] = keep - 1e-5
        down = loss()
        w[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def read_main(pages, **settings):
    w, v = html_blocks.trained(), html_blocks.Vectors()
    parsed = [html_leaves.parsed(p) for p in pages]
    return [[x.text for x, on in zip(p.leaves, m, strict=True) if on] for p, m in zip(parsed, html_blocks.labelled(w, v, parsed), strict=True)]


@pytest.mark.parametrize("pages", [held_out_pages.PAGES, held_out_pages.FRESH])
def test_pages_of_other_layouts_are_read(pages):
    hit = got_all = want_all = 0
    for got, (_, want) in zip(read_main([h for h, _ in pages]), pages, strict=True):
        hit += sum(len(t) * n for t, n in (Counter(got) & Counter(want)).items())
        got_all, want_all = got_all + sum(map(len, got)), want_all + sum(map(len, want))
    assert hit > 0.9 * got_all and hit > 0.9 * want_all


def test_a_long_page_is_read_in_steps(monkeypatch):
    page = html_leaves.parsed("<title>Long</title><nav><a href=/>Home</a></nav><article><h1>Long</h1>" + "<p>The words of a paragraph, and some more of them.</p>" * 60 + "</article><footer>Copyright 2020</footer>")
    w, v = html_blocks.trained(), html_blocks.Vectors()
    x, mask = html_blocks.batched([v.of(page.leaves, page.title)])
    whole = html_blocks.logits(w, x, mask)[0][0]
    monkeypatch.setattr(html_blocks, "LONG", 7)
    assert np.abs(html_blocks.long_page(w, v, page) - whole).max() < 1e-3
    assert (html_blocks.labelled(w, v, [page])[0] == (whole > 0)).all() and whole[0] < 0 < whole[5]


def test_extracted_text_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_blocks.extracted(pages).collect()
    for r in out:
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        want = [html_leaves.tidy(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<<<>>>", "t")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r["text"] for r in html_blocks.extracted(df).collect()}
    assert out[1] == "\n".join(x.text for x in html_leaves.parsed(PAGE).leaves[2:5]) and out[2] == out[3] == ""
    assert html_blocks.extracted(df.where("FALSE")).count() == 0


# --- 6 WARC ------------------------------------------------------------------------------------------


def split_warc(data):
    out = []
    while data:
        r = warc.record_from(data)
        out.append(r)
        rest = data[len(r.to_bytes()) :]
        assert rest.startswith(b"\r\n\r\n")
        data = rest[4:]
    return out


def test_derivatives_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/\r\nX: y", "é\x00"), (3, "http://b/\r\nX: y", "é\x00")], "page_id long, url string, html string")
    sources = {r["page_id"]: warc.record_from(bytes(r["record"])) for r in warc.responses(df).collect()}
    out = warc.derivatives(warc.responses(df))
    rows = out.collect()
    assert len(rows) == 8
    for r in rows:
        rec, src = warc.record_from(bytes(r["record"])), sources[r["page_id"]]
        status, headers, payload = warc.http_message(src.block)
        assert status == 200 and r["refers_to"] == rec.field("WARC-Refers-To") == src.field("WARC-Record-ID")
        assert r["source_payload_digest"] == warc.digest(payload) and r["block_digest"] == warc.digest(rec.block) and r["content_length"] == len(rec.block)
        assert r["target_uri"] == src.field("WARC-Target-URI") and "\n" not in r["target_uri"]
        if r["record_type"] == "metadata":
            about = json.loads(rec.block)
            assert about["warc"] == [list(x) for x in src.fields] and about["http"]["headers"] == [list(x) for x in headers]
        else:
            assert rec.block.decode() == "\n".join(x.text for x in html_leaves.parsed(payload.decode()).leaves)
    warc.write(out, str(tmp_path / "wet"))
    found = []
    for f in Path(tmp_path / "wet").glob("part-*"):
        data = f.read_bytes()
        while data:  # a member at a time, as readers of WARC files do
            one = zlib.decompressobj(31)
            raw = one.decompress(data)
            data = one.unused_data
            found += split_warc(raw)
            assert len(split_warc(raw)) == 1
    assert sorted(r.to_bytes() for r in found) == sorted(bytes(r["record"]) for r in rows)
    assert warc.derivatives(warc.responses(df.where("FALSE"))).count() == 0
    with pytest.raises(ValueError):
        warc.record_from(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")


def test_repeated_headers_stay_and_bad_records_stop_nothing(spark):
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:1>"), ("WARC-Concurrent-To", "<urn:2>"), ("Content-Length", str(len(block)))]
    good = warc.Record(fields, block).to_bytes()
    other = warc.Record([("WARC-Type", "warcinfo"), ("Content-Length", "0")], b"").to_bytes()
    df = spark.createDataFrame([("a", good), ("b", None), ("c", b"junk"), ("d", good[:-1]), ("e", good.replace(b"Content-Length", b"Content-Size")), ("f", other)], "page_id string, record binary")
    rows = warc.derivatives(df).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in rows) == Counter([("a", "metadata"), ("a", "conversion"), *((x, "malformed") for x in "bcde")])
    about = json.loads(warc.record_from(bytes(next(r["record"] for r in rows if r["record_type"] == "metadata"))).block)
    assert about["http"]["headers"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"]] and [x for x in about["warc"] if x[0] == "WARC-Concurrent-To"] == [["WARC-Concurrent-To", "<urn:1>"], ["WARC-Concurrent-To", "<urn:2>"]]
    assert all(r["record"] is None and r["refers_to"] is None for r in rows if r["record_type"] == "malformed")


def test_a_large_record_ends_its_member_with_zero():
    for n in (10, 17 << 20):
        m = warc.member(b"x" * n)
        assert m.endswith(b"\0") and gzip.decompress(m) == b"x" * n + b"\r\n\r\n"


# --- 7 quality ---------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def test_counts_by_brute_force(docs, empty):
    rows = quality.measured(docs).collect()
    for r in rows:
        want = plain_counts(r["text"])
        assert tuple(r[c] for c in quality.MEASURED) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.judged(empty).count() == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judged(docs).where("kept").count()


def test_repeats_against_brute_force_at_random():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [str(x).encode() for x in rng.integers(0, 4, rng.integers(0, 60))]
        assert quality.repeated_words(words) == plain_counts(" ".join(w.decode() for w in words))[4]


def test_sketches_merge_and_keep_the_error(spark):
    values = np.random.default_rng(2).integers(0, 100_000, 3000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    assert all(r["b"] <= r["v"] <= r["b"] * 17 / 16 + 1 for r in df.collect())
    hist = df.groupBy("b").agg(F.count("*").alias("n")).withColumnRenamed("b", "bucket").withColumn("g", F.lit(1))
    q = quality.quantiles(hist, ["g"], {"q": (3, 4)}).first()
    exact = sorted(values)[int(np.ceil(0.75 * 3000)) - 1]
    assert q["docs"] == 3000 and q["q"] <= exact <= q["q"] * 17 / 16 + 1


def test_a_source_of_symbols_has_its_own_fence(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 7)), "en", "plain") for i in range(250)]
    rows += [(1000 + i, " ".join(f"w{j}*" for j in range(20 + i % 7)), "en", "stars") for i in range(250)]
    rows += [(2000, " ".join(f"w{j}*" for j in range(20)), "en", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(df).collect()}
    assert not kept.pop(2000) and all(kept.values())


def test_each_metric_rejects_what_the_base_rule_passes(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    lines = lambda n: [" ".join(word() for _ in range(9 + i % 4)) for i in range(n)]
    rows = [(i, "\n".join(lines(4 + i % 5)), "en", "a") for i in range(1500)]
    phrase = " ".join(word() for _ in range(6))
    same = "short line again"
    odd = {
        "symbols": "\n".join(x + " **" for x in lines(6)), "repeats": "\n".join([*lines(7), phrase, *lines(3), phrase]),
        "dup_lines": "\n".join([*lines(5), same, same, same]), "word_len": "\n".join(x.replace(" ", "") + " " + x for x in lines(5)),
    }
    rows += [(5000 + k, t, "en", "a") for k, t in enumerate(odd.values())]
    rows += [(6000 + k, t, "en", "small") for k, t in enumerate(odd.values())]  # by the fences of its language
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k, m in enumerate(odd):
        assert not got[5000 + k]["base_failed"] and not got[5000 + k]["kept"] and not got[6000 + k]["kept"], m
    assert sum(not r["kept"] for i, r in got.items() if i < 5000) <= 15


# --- 8 SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Of {fingerprint: ...}: the root of each by union of all pairs within two bits."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows)
    fps = [(i, plain_fingerprint(t)) for i, t, _, _ in TEXTS]
    roots = plain_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert got == Counter((i, f, least.get(roots[f])) for i, f in fps)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(docs, empty):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    fps = {f for f in (plain_fingerprint(t) for _, t, _, _ in TEXTS)}
    rows = kept.collect()
    assert len(rows) == len(set(plain_components(fps).values()))
    assert 1 in [r["doc_id"] for r in rows] and 2 not in [r["doc_id"] for r in rows]
    assert simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("most", [64, 2])
def test_links_lose_no_pair(spark, most):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {0, 2**64 - 1}
    for b in base:
        for _ in range(12):
            f = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, most)
    assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a % 2**64) ^ (r.b % 2**64)).bit_count() <= 2 for r in edges.collect())
    got = {r.node % 2**64: r.root for r in simhash.components(edges).collect()}
    want = plain_components(fps)
    groups = defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
    for g in groups.values():
        assert len({got.get(f, "alone") for f in g}) == 1 and (len(g) > 1) == (next(iter(g)) in got)
        if len(g) > 1:
            assert got[next(iter(g))] == min(map(signed, g))


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


# --- 9 personal data -----------------------------------------------------------------------------------


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PII_TEXTS = [
    "a@b.c@d.e f..@x.y.z", "@a.b x@y a@@b.c a+b@c-d.e.f.", "a@b..c a@b.c.@d.e", "1.2.3.4.5 1.2.3.4.5.6.7.8 001.002.003.0004 256.1.1.1", "4111111111111111 4111 1111 1111 1112 0000000000000000",
    "+1 (555) 010-9999 4111111111111111", "+12345678 ++1 234 567 890 +1-2", "x" * 1000 + "@" + "y" * 1000 + ".z", "1" * 3000, "é😀 a@b.co é",
]


def test_base_spans_by_brute_force():
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("a@.1+ -(2)4\n"), rng.integers(1, 60))) for _ in range(3000)]
    for t in [*PII_TEXTS, *odd, *(t for _, t, _, _ in TEXTS)]:
        assert pii.joined(pii.base_spans(t)) == plain_spans(t), t


def test_query_rows(spark, docs, empty):
    out = pii.spans_of(docs).collect()
    assert Counter((r["doc_id"], r["base"]) for r in out) == Counter((i, plain_spans(t)) for i, t, _, _ in TEXTS)
    assert pii.spans_of(empty).count() == 0
    rows = queries.op9_pii(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and (r["spans"] == base or "term:" in r["spans"])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k + ":") for s in base.split(",")) for k in ("email", "ip", "card", "phone"))


@pytest.mark.parametrize("sent", [100_000, 0])
def test_terms_that_disclose(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "TERMS_SENT", sent)
    filler = ["plain words here and there for a longer common text number " + str(i) for i in range(60)]
    told = [f"note {w} that Zorblatt can be reached at zed@corp.example for the common text" for w in ("alpha", "beta", "gamma", "delta")]
    df = spark.createDataFrame(list(enumerate(told + filler)), "doc_id long, text string")
    by_id = {r["doc_id"]: r["terms"] for r in pii.spans_of(df).collect() if r["terms"]}
    for i, t in enumerate(told):
        a = t.index("Zorblatt")
        assert f"term:{a}:{a + 8}" in by_id[i].split(",") and f"term:{t.index('common')}:{t.index('common') + 6}" not in by_id[i].split(",")
    assert set(by_id) == {0, 1, 2, 3}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df.selectExpr("doc_id", "text", "'en' lang", "'a' source", "0L n_chars")).collect()}
    assert "[NAME]" in clean[0] and "[EMAIL]" in clean[0] and "Zorblatt" not in clean[0] and clean[10] == filler[6]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_a_told_term_is_marked_in_the_whole_text(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "TERMS_SENT", sent)
    far = "so it goes on with many other plain words until the end of this quite long note"
    told = [f"note {w} that Zorblatt can be reached at zed@corp.example for the common text {far} says ZORBLATT, Zorblatt's and Anne-Zorblatt" for w in ("alpha", "beta", "gamma")]
    told.append(f"only {far} and {far} zed@corp.example {far} and {far} by Zorblatt")
    filler = ["plain words here and there for a longer common text number " + str(i) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(told + filler)), "doc_id long, text string")
    spans = {r["doc_id"]: r["terms"] or "" for r in pii.spans_of(df).collect()}
    for i, t in enumerate(told):
        want, got = [m.span() for m in re.finditer("zorblatt", t, re.I)], [(a, b) for a, _, b in pii.parsed(spans[i])]
        assert len(want) == (1 if i == 3 else 4) and all(any(a <= x and y <= b for a, b in got) for x, y in want)
    clean = pii.sanitised(df.selectExpr("doc_id", "text", "0L n_chars")).collect()
    assert len(clean) == 64 and not any("zorblatt" in r["text"].lower() for r in clean)


def plain_told(texts, alpha, support):
    """The disclosing (class, term) pairs by dictionaries over all documents."""
    word = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    n_t, n_c, docs, around = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        n_t.update({w.lower() for w in word.findall(text or "")})
        spans = pii.base_spans(text)
        if not spans:
            continue
        n_c.update(pii.held_by(text, spans))
        inside = lambda m: any(a < m.end() and m.start() < b for a, _, b in spans)  # noqa: E731, B023
        first = None
        for a, k, b in spans:
            before = [m for m in word.finditer(text[:a])][-12:]
            after = [m for m in word.finditer(text, b)][:12]
            near = [m[0].lower() for m in before + after if not inside(m)]
            first = first or (tuple(near),)
            for c in pii.classes_of(k, text[a:b]):
                for t in near:
                    if len(t) > 1:
                        docs[c, t].add(i)
                        around[c, t].add(tuple(near))
        cuts = [(0, 0), *sorted((a, b) for a, _, b in spans), (len(text), len(text))]
        reach, said = 0, set()
        for a, b in cuts:
            if a > reach:
                said |= {m[0].lower() for m in word.finditer(text, reach, a)}
            reach = max(reach, b)
        for c in {"any", *(k for _, k, _ in spans)}:
            for t in said:
                if len(t) > 1:
                    docs[c, t].add(i)
                    around[c, t].add(first)
    n = len(texts)
    return {(c, t) for (c, t), d in docs.items() if len(around[c, t]) >= support and n_c[c] < n and np.log(len(d) * n / (n_t[t] * n_c[c])) >= alpha * np.log(n / n_c[c]) - 1e-12}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_disclosing_terms_of_the_tables_equal_a_plain_count(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    want = plain_told([r["text"] for r in df.collect()], pii.ALPHA, pii.LEAST_SUPPORT)
    got = {tuple(r) for r in pii.told_in(df)[1].collect()}
    assert got == want and (sf == "sf0.001" or len(got) > 0)


def test_long_compounds_are_marked_by_runs():
    text = "-".join(["aa", "bb", "cc"] * 2000) + " aa-bb x-cc"
    got = pii.occurrences(text, [], {"bb-cc", "aa"})
    assert len(got) == 4001 and all(text[a:b] in ("aa", "bb-cc") for a, _, b in got)


def test_near_words_have_no_bound_in_characters():
    words = [c * 300 for c in "abcdefghijklmn"]
    for gap in (" ", " " * 700, " -- " * 200):
        text = gap.join([*words, "zed@corp.example", *words[::-1]])
        near = [t for c, t, _, _ in pii.meetings(text, pii.base_spans(text))[0] if "-group" not in c]
        assert near == list(dict.fromkeys(words[-12:] + words[::-1][:12]))


def test_sanitised_rows(docs):
    out = pii.sanitised(docs.select("doc_id", "text", "lang", "source", "n_chars", "kept")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in TEXTS)
    for r in out:
        assert plain_spans(r["text"]) == "" and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


# --- 10 audio --------------------------------------------------------------------------------------------


def plain_mel(x):
    """Log-mel frames by the definitions: convolution of the whole signal, a DFT as a matrix, a loop over frames."""
    z = np.zeros(3 * len(x))
    z[::3] = (x - 128.0) / 128
    n = 2 * audio.TAPS * audio.UP + 1
    t = np.arange(n) - n // 2
    y = np.convolve(z, np.sinc(t / 4) * np.hamming(n) * 3 / 4)[n // 2 : n // 2 + len(z)][::4]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = [700 * (10 ** (mel(3000) * i / 21 / 2595) - 1) for i in range(22)]
    f = np.arange(129) * 6000 / 256
    bank = np.array([np.clip(np.minimum((f - a) / (b - a), (c - f) / (c - b)), 0, None) for a, b, c in zip(edge, edge[1:], edge[2:], strict=False)])
    dft = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    out = []
    for at in range(0, max(1, -(-(len(y) - 256) // 128) + 1) * 128, 128):
        frame = np.zeros(256)
        frame[: len(y[at : at + 256])] = y[at : at + 256]
        # beyond the signal's end the filter still rings
        out.append(10 * np.log10(np.maximum(bank @ np.abs(dft @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)))) ** 2, 1e-10)))
    return np.array(out)


def plain_segments(level):
    lo, hi, out, start = min(level), max(level), [], None
    for i, v in enumerate(level):
        if start is None and v >= lo + audio.OPEN_AT * (hi - lo) and hi > lo:
            start = i
        elif start is not None and v < lo + audio.CLOSE_AT * (hi - lo):
            out.append((start, i))
            start = None
    return out + ([(start, len(level))] if start is not None else [])


def test_media_by_plain_steps(docs, empty):
    rows = audio.media(docs.select("doc_id", "text", "score")).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert bytes(r["media"])[44:] == want and r["tail_crc32"] == zlib.crc32(want[-32:])
        kept = audio.unpacked(bytes(r["mel"]))
        assert kept.schema.field("mel").type == audio.TENSOR and kept.num_rows == r["n_tensors"]
        frames = audio.frames_of(kept)
        spans = list(zip(kept["from_ms"].to_pylist(), kept["to_ms"].to_pylist(), strict=True))
        assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)) and spans[-1][1] == pytest.approx(len(frames) * audio.MS)
        if len(want) < 20_000:
            plain = plain_mel(np.frombuffer(want, np.uint8))
            assert frames.shape == plain.shape and np.abs(frames[:-2] - plain[:-2]).max(initial=0) < 1e-2
        level = frames.mean(axis=1, dtype=np.float64).tolist()
        assert [(x["from_ms"], x["to_ms"]) for x in r["segments"]] == [(a * audio.MS, b * audio.MS) for a, b in plain_segments(level)]
        parts = dict(p.split("=") for p in r["feature"].split(";"))
        assert parts["mel"] == ",".join(str(int(x)) for x in np.rint(frames.mean(axis=0, dtype=np.float64) * 10)) and int(parts["frames"]) == len(frames) and int(parts["segments"]) == len(r["segments"])
    same = defaultdict(set)
    for r in rows:
        same[r["text"] or ""].add((r["feature"], bytes(r["mel"])))
    assert all(len(v) == 1 for v in same.values()) and audio.media(empty.select("doc_id", "text")).count() == 0


def test_audio_query_digests_what_is_stored(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_audio(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows[:40]:
        payload, n = audio.payload_of(texts[r["doc_id"]])
        wav = audio.stored(payload)
        mel = audio.packed(audio.log_mel(np.frombuffer(payload, np.uint8)))
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"], r["tensors_sha256"]) == (n, len(wav), hashlib.sha256(wav).hexdigest(), hashlib.sha256(mel).hexdigest())
        assert r["spans_ms"] == ",".join(f"{int(a + 0.5)}-{int(b + 0.5)}" for a, b in audio.spans_ms(audio.frames_of(audio.unpacked(mel))))


def test_resampling_equals_the_full_convolution(monkeypatch):
    x = np.random.default_rng(5).integers(0, 256, 1000).astype(np.uint8)
    z = np.zeros(3000)
    z[::3] = (x - 128.0) / 128
    n = 2 * audio.TAPS * audio.UP + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / 4) * np.hamming(n) * 3 / 4
    full = np.convolve(z, h)[n // 2 : n // 2 + 3000][::4]
    assert np.abs(full - audio.resampled(x, 0, 750)).max() < 1e-12
    whole = audio.log_mel(x)
    monkeypatch.setattr(audio, "PIECE", 512)
    assert np.allclose(whole, audio.log_mel(x), atol=1e-4)


def test_segments_follow_the_two_levels():
    level = np.array([0, 0, 7, 5, 10, 5, 3, 5, 0, 9, 9.0])
    assert audio.segments(level) == [(2, 6), (9, 11)]
    assert audio.segments(np.full(9, -3.0)) == []
