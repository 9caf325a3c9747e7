"""The manifest, the repair of conversations and the language models against plain versions and SQL."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows as as_rows
from verbatlas.llm import langid, merkle, oracles, queries, turns

SF = "/root/testdata/sf0.001"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle", "op12_turns"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, wanted = queries.QUERIES[name](spark, SF), con.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(names, wanted.fetchall())


# --- 11 manifest ----------------------------------------------------------------------------------


def plain_tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out += level[i ^ 1 : (i ^ 1) + 1]
        i >>= 1
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_manifest_equals_plain_trees(spark, partitions):
    """Groups within a partition, over many, and of one row; null groups and keys, repeated keys and rows, clashing names."""
    random.seed(1)
    sizes = {None: 5, "": 1, "a": 333, "b": 2, "c": 1, "é": 64, "z": 7}
    rows = [(g, random.choice([None, *range(n)]), h(str(i), str(g)), f"extra {i}", "clash") for g, n in sizes.items() for i in range(n)]
    rows += rows[:3] + rows[40:44]
    frame = spark.createDataFrame(rows, "grp string, k long, text string, extra string, root string").withColumn("leaf", F.unhex("text"))
    before = [spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = merkle.manifest(frame, "grp", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    by = defaultdict(list)
    for g, k, leaf, *_ in rows:
        by[g].append((k is not None, k or 0, leaf))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[g])]) for g in order]
    top = plain_tree([t[-1][0] for t in trees])
    assert len(out) == len(rows) and Counter((r["grp"], r["k"], r["extra"]) for r in out) == Counter((g, k, e) for g, k, _, e, _ in rows)
    assert sorted((r["tree"], r["position"]) for r in out) == [(g, i) for g, t in enumerate(trees) for i in range(len(t[0]))]
    for r in out:
        t = trees[r["tree"]]
        assert (order[r["tree"]], t[0][r["position"]]) == (r["grp"], r["leaf"].hex()) and r["trees"] == len(trees) and r["total"] == len(t[0])
        assert r["proof"].hex() == "".join(siblings(t, r["position"]) + siblings(top, r["tree"]))
        assert (r["subroot"].hex(), r["root"].hex()) == (t[-1][0], top[-1][0])
        assert merkle.folded(r["leaf"], [(r["position"], r["total"]), (r["tree"], r["trees"])], r["proof"]) == r["root"]


def test_manifest_of_nothing_and_of_one_row(spark):
    frame = spark.createDataFrame([("a", 1, "x" * 1_000_000)], "grp string, k long, text string").withColumn("leaf", merkle.leaf(F.col("k"), F.col("text"), F.lit(None)))
    assert merkle.manifest(frame.where("FALSE"), "grp", "k").count() == 0
    (r,) = merkle.manifest(frame, "grp", "k").collect()
    assert r["leaf"].hex() == r["subroot"].hex() == r["root"].hex() == h("1:1", "1000000:" + "x" * 1_000_000, "-") and r["proof"] == b""


def test_subtrees_of_stretches_cover_each_leaf_once():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(77)]
    want = plain_tree([x.hex() for x in leaves])
    for lo, hi in ((0, 77), (0, 1), (3, 20), (31, 33), (64, 77), (76, 77), (5, 70)):
        covered = []
        for level, i, node in merkle.ragged(b"".join(leaves[lo:hi]), lo, 77):
            assert node.hex() == want[level][i]
            covered += range(i << level, min((i + 1) << level, 77))
        assert sorted(covered) == list(range(lo, hi))


def test_tampered_rows_are_found(spark):
    rows = queries.op11_merkle(spark, SF).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])


# --- 12 conversations -----------------------------------------------------------------------------


def plain_repair(rows):
    """Each conversation's summary, by a search over (cost, letters)."""
    names = {"u": "user", "a": "assistant"}
    out, by = {}, defaultdict(list)
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        by[c].append((t is not None, t or 0, r.encode(), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    for c, told in by.items():
        told.sort()
        seen, kinds = set(), []
        for *_, r, x in told:
            y = x.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        ts = {t for some, t, *_ in told if some}
        initials = [r[:1] for *_, r, _ in told]
        to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, letters, i, q, made = heapq.heappop(heap)
            if i == len(told) and q in ("", "a"):
                break
            if (i, q) in done:
                continue
            done.add((i, q))
            for w in "ua":
                if (q, w) in to:
                    heapq.heappush(heap, (cost + 5, letters + "I", i, to[q, w], (*made, names[w] + ":")))
            if i < len(told):
                *_, r, x = told[i]
                heapq.heappush(heap, (cost + 2, letters + "D", i + 1, q, made))
                if kinds[i] in ("", "truncated"):
                    more = 5 * (kinds[i] != "")
                    if (q, r[:1]) in to:
                        heapq.heappush(heap, (cost + more, letters + "K", i + 1, to[q, r[:1]], (*made, f"{r}:{x}")))
                    for w in "ua":
                        if (q, w) in to:
                            heapq.heappush(heap, (cost + more + 1, letters + "R", i + 1, to[q, w], (*made, f"{names[w]}:{x}")))
        counts = [kinds.count(k) for k in turns.FAULTS]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (max(ts) - min(ts) + 1 - len(ts) if ts else 0, *counts, illegal, cost, letters, h("\n".join(made)))
    return out


ROLES = ["user", "assistant"] * 3 + ["system", "tool", "unknown", "", None, "s"]
SAID = ["Hi.", "ok", "well done!", "", "  \n", None, "what?", "no stop", "a. b", "x" * 100_000 + "."]


@pytest.mark.parametrize("partitions", ["3", "29"])
def test_repair_equals_a_search(spark, partitions):
    """Short conversations, and one that holds half of the rows and reaches over many partitions; null ids and turns, ties, repeated rows."""
    random.seed(int(partitions))
    rows = []
    for c in [None, *range(60)]:
        for i in range(400 if c == 7 else random.choice([1, 2, 3, 5, 8, 13])):
            said = random.choice([*SAID, f"turn {i}.", f"turn {i}"])
            rows.append((c, random.choice([i, i, i, None, i // 2]), random.choice(ROLES), said, "edit", 1))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, edit string, cost int").repartition(5)
    before = [spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = turns.edits(frame).cache()
        found = {r[0]: tuple(r[1:]) for r in turns.summary(made).collect()}
        each = made.orderBy("conv_id", "__pid", "__seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert found == plain_repair([r[:4] for r in rows])
    for c, (*_, letters, digest) in found.items():
        own = [r for r in each if r["conv_id"] == c]
        assert "".join(r["edit"] for r in own) == letters and h("\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")) == digest
        roles = "".join(r["role"][:1] for r in own if r["edit"] != "D")
        assert re.fullmatch("(s?(ua)+)?", roles)
    assert sum(r["edit"] != "I" for r in each) == len(rows)


def test_automaton_stays_small():
    """Whatever the turns are, few states are met: the costs' differences are bounded."""
    auto = turns.Automaton()
    random.seed(2)
    for _ in range(300):
        auto.scan(bytes(random.choices(range(9), k=random.choice([3, 50, 2000]))), turns.END)
    assert len(auto.states) < 100 and len(auto.table) <= 9 * len(auto.states)
    for costs in auto.states:
        assert max(costs) <= 10 and min(costs) == 0


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.summary(turns.edits(frame)).count() == 0


def test_damage_follows_the_remainders(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, None, 5) for t in (*range(40), None)]
    got = Counter(map(tuple, turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want[c, t, "user" if k == 4 else r, "" if k == 1 else "One Two" if k == 2 else x] += 2 if k == 3 else 1
    assert got == want and len(want) < len(rows)


# --- 13 languages ---------------------------------------------------------------------------------


def plain_text(text):
    t = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    t = re.sub(" +", " ", t + " ").lstrip(" ")
    return "   " + t if t else ""


class PlainModel:
    """Interpolated Kneser-Ney by dictionaries, window by window."""

    def __init__(self, texts):
        grams = Counter(t[i : i + 4] for t in map(plain_text, texts) for i in range(len(t) - 3))
        self.n = {4: grams}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.total, self.kinds, self.d = {}, {}, {}
        for k, own in self.n.items():
            ones, twos = (sum(v == x for v in own.values()) for x in (1, 2))
            self.d[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in own.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / (len(self.n[1]) + 1)
        if not self.total[k][g[:-1]]:
            return lower
        return max(self.n[k][g] - self.d[k], 0) / self.total[k][g[:-1]] + self.d[k] * self.kinds[k][g[:-1]] / self.total[k][g[:-1]] * lower

    def entropy(self, text):
        t = plain_text(text)
        return -sum(math.log(self.p(t[i : i + 4])) for i in range(len(t) - 3)) / (len(t) - 3)


EXTRA = [
    (None, "quelques mots français sans numéro", None), (1001, None, "fr"), (1002, "", "de"), (1003, "123 $%& \n 456", "en"), (1004, "É", "fr"),
    (1005, "漢字 かな \U00020000\U0001d400", "ja"), (1006, "the house " * 30_000, "en"), (1006, "the house " * 30_000, "en"), (1007, "Straße straße", None), (1008, "\U0001f600", "en"),
]


@pytest.fixture(scope="module")
def spoken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame(EXTRA, "doc_id long, text string, lang string")
    return docs.unionByName(more).withColumns({"score": F.lit("clash"), "evidence": F.lit(1)}).repartition(3)


def test_cross_entropies_equal_a_plain_model(spark, spoken):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = langid.identified(spoken, learn=fold != 2, calibrate=fold == 3).collect()
    teach = defaultdict(list)
    rows = [*[tuple(r) for r in spoken.select("doc_id", "text", "lang").collect()]]
    for i, t, la in rows:
        if la is not None and i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            teach[la].append(t)
    models = {la: PlainModel(ts) for la, ts in teach.items() if any(plain_text(t) for t in ts)}
    assert len(out) == len(rows) and set(models) >= {"en", "fr", "de", "es", "ja"}
    for r in out:
        if not plain_text(r["text"]):
            assert (r["lang_pred"], r["score"], r["accepted"], r["entropy"]) == ("und", 0, False, None)
        elif len(r["text"]) < 4000 or r["doc_id"] == 1006:
            want = sorted((m.entropy(r["text"][:3000] if r["doc_id"] == 1006 else r["text"]), la) for la, m in models.items())
            assert r["lang_pred"] == want[0][1] and 0 <= r["score"] <= 1
            if r["doc_id"] != 1006:
                assert abs(r["entropy"] - want[0][0]) < 1e-4


def test_probabilities_sum_to_one_even_if_windows_are_left_out(spark, spoken):
    rows = spoken.where("lang = 'de'").select("text", "lang")
    grams = langid.counted(rows, F.lit(False)).drop("fold").withColumn("of", F.lit("a"))
    for most in (langid.MOST_WINDOWS, 2000, 0):
        m = langid.models_of(grams, most)["a"]
        assert most or len(m.keys) < 200
        singles = [g for g in np.arange(1, 1 << 16, dtype=np.uint64)]
        for context in (plain_text("von der Straße")[3:6], "zzq", "   "):
            c = np.uint64(0)
            for x in context:
                c = (c << np.uint64(16)) | np.uint64(ord(x))
            all_next = (c << np.uint64(16)) | np.array(singles, np.uint64)
            p = np.exp(m.of(all_next)[:, 0].astype(np.float64))
            known = int((m.find(np.array(singles, np.uint64)) >= 0).sum())
            uniform = math.exp(float(m.none[0]))
            # every unknown character has the share of the one unknown
            seen = m.find(np.array(singles, np.uint64)) >= 0
            assert known > 20 and uniform > 0 and p[seen].sum() < 1 < p[seen].sum() + 2 * p[~seen][0] + 1e-3


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else SF
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op13_langid(spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows) and len(rows) > 200
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows]
    assert sum(right) > 0.98 * len(rows)
    sure = [x for x, r in zip(right, rows, strict=True) if r["score"] > 0.9]
    assert sum(sure) > 0.99 * len(sure)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    out = langid.identified(frame, F.lit(True), F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in out} == {("und", 0.0, False)}
    assert langid.identified(frame.where("FALSE"), F.lit(True), F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "some words", "en"), (2, "andere", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identified(one, F.lit(True), F.lit(False)).collect()} == {"en"}


def test_calibration_is_monotone_and_finds_the_trusted_evidence(spark):
    rows = [("a", "a" if i % 2 else "b", 0.5) for i in range(100)] + [("a", "a", 5.0)] * 300 + [("b", "und", 9.0)] * 5
    shares, floor = langid.calibration(spark.createDataFrame(rows, "lang string, lang_pred string, evidence double"))
    assert shares == sorted(shares) and abs(shares[8] - 0.5) < 0.01 and shares[80] > 0.99 and 0.5 < floor <= 5
