"""Language identification by character models: interpolated Kneser-Ney, one for each language of the labelled texts.

Texts become runs of lower-cased letters with single gaps between. Every window of ORDER characters is counted for its language,
over all labelled texts: first in the scan's tasks, by sorting packed windows, then by Spark. From these counts alone follow, by joins and sums over the tables
of windows, the continuation counts of the shorter windows, the discounts (absolute, from the numbers of windows met once and twice), and
for each window the interpolated probability

    p(c | h) = max(n(hc) - D, 0) / n(h) + D * kinds(h) / n(h) * p(c | shorter h)

down to a uniform one over the characters met. The windows of all languages and orders with their log-probabilities and contexts' weights go into one
sorted array of 64-bit hashes (a bijection of the packed window, so none collide). What is sent to the tasks is bounded: beyond
MOST_WINDOWS of a length the rarest are left out (their mass stays with the shorter ones), by the least count that fits.

A text's cross-entropy in each language is its summed log-probability over its characters; the lowest decides, of equal ones the least name. How far it is
below the second, times the logarithm of the text's length, is the evidence. A second set of models, without a third of the labelled texts (fold ``calibrate``), scores just those, and gives by isotonic regression the share of right answers at
each evidence: that is the score. Answers below the evidence from which TRUST of them are right are marked as not ``accepted``.

Defined results: a text that is null or has no letter is ``und`` with score 0. Very long texts are scored whole. Equal texts get equal
results; of tied languages the least name. Rows without a language, or held out, teach nothing. With no labelled text, or an empty
table, every row is ``und``. With one language there is no second, and the score is the share of its rows. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, slices

#: Characters in the longest window, and bits of one in the packed window.
ORDER, BITS = 4, 16
#: Windows of each length that the models keep at most, over all languages (and as many again those of the calibration); each takes 8 bytes and 8 for each language.
MOST_WINDOWS = 1_000_000
#: Windows counted in a task before they are handed on.
HELD = 4_000_000
#: Of the accepted answers on texts that the models don't know, so many are right.
TRUST = 0.99
#: An odd number: multiplying by it modulo 2**64 is a bijection.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
GAP = 32
UNKNOWN = "und"
FIELDS = {"lang_pred": pa.string(), "evidence": pa.float64(), "entropy": pa.float64()}
DDL = "lang_pred string, evidence double, entropy double"


def letters_table() -> np.ndarray:
    """For each code point: the code of its lower-cased letter, below 2**BITS, or 0 for what is no letter."""
    if not LETTERS:
        to = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                to[i] = ord(c.lower()[0])
        LETTERS.append(np.where(to < 1 << BITS, to, (to ^ (to >> 8)) & 0xFFFF | 0x8000).astype(np.uint16))
    return LETTERS[0]


LETTERS: list[np.ndarray] = []


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with single gaps, each text with ORDER - 1 gaps before and one after it; and where each text begins, and the last ends."""
    to = letters_table()
    gaps, parts, starts, at = np.full(ORDER - 1, GAP, np.uint16), [], [0], 0
    for t in texts:
        x = to[np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)]
        x = np.append(x, np.uint16(0))
        before = np.empty(len(x), np.bool_)
        before[0], before[1:] = False, x[:-1] != 0
        x = x[(x != 0) | before]
        x[x == 0] = GAP
        parts += [gaps, x]
        at += len(x) + len(gaps)
        starts.append(at)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.array(starts)


def windows(x: np.ndarray) -> np.ndarray:
    """The packed windows that end at each place from ORDER - 1 on."""
    wide = x.astype(np.uint64)
    n = max(len(x) - ORDER + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(BITS)) | wide[k : k + n]
    return out


def own_windows(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of ``windows``, those that lie in one text."""
    w = windows(x)
    keep = np.ones(len(w), np.bool_)
    for s in starts[1:-1]:
        keep[max(s - ORDER + 1, 0) : s] = False
    return w[keep]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, ascending, and their counts."""
    w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(w, kind="stable")
    w, n = w[order], n[order]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    return w[first], np.add.reduceat(n, first) if len(w) else n


def counted(rows: DataFrame, fold: Column) -> DataFrame:
    """(lang, fold, gram, n): how often each window of ORDER characters is met in texts (``text``, ``lang``); ``fold`` is a boolean."""
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"), fold.alias("fold"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                by: dict[tuple, list[str]] = {}
                for t, *key in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    by.setdefault(tuple(key), []).append(t)
                for key, texts in by.items():
                    w = np.sort(own_windows(*codes(texts)))
                    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
                    new = w[first], np.diff(np.append(first, len(w)))
                    held.setdefault(key, []).append(new)
                    total += len(first)
                if total > HELD:
                    held = {k: [summed(v)] for k, v in held.items()}
                    total = sum(len(v[0][0]) for v in held.values())
                    if total > HELD // 2:
                        yield from handed(held)
                        held, total = {}, 0
        yield from handed(held)

    def handed(held: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        for (lang, is_fold), parts in held.items():
            w, n = summed(parts)
            for i in range(0, len(w), 1 << 16):
                g = w[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array([is_fold] * len(g), pa.bool_()), pa.array(g), pa.array(n[i : i + (1 << 16)])], names=["lang", "fold", "gram", "n"])

    return rows.mapInArrow(task, "lang string, fold boolean, gram long, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def cutoff(grams: DataFrame, most: int) -> int:
    """The least count from which at most ``most`` windows are kept: from the numbers of windows by count, in steps of their logarithm."""
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8 + 16))
    by = grams.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("n")).collect()
    total, least = 0, 1 << 62
    for r in by:
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    return least


def probabilities(grams: DataFrame, most: int = MOST_WINDOWS) -> DataFrame:
    """(lang, k, gram, logp, bow) from counts (lang, gram, n) of the longest windows: for each window of k characters its interpolated
    log-probability and, if it is a context, the logarithm of the weight of shorter ones after it."""
    by_order = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # a shorter window is counted once for each character before it
        by_order[k] = cut(by_order[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count("*").alias("n")))
    out, below = [], None
    for k in range(1, ORDER + 1):
        own, least = by_order[k], cutoff(by_order[k], most) if k > 1 else 1
        some = own.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count("*").alias("chars"))
        some = F.broadcast(some.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("discount"), "chars"))  # a row for each language
        context = F.shiftrightunsigned("gram", BITS).alias("context") if k > 1 else F.lit(0).cast("long").alias("context")
        own = own.select("lang", "gram", "n", context).join(some, "lang")
        own = own.withColumn("kept", F.when(F.col("n") >= least, F.col("n") - F.col("discount")).otherwise(0.0))
        sums = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("kept").alias("mass"))
        # what the kept windows leave goes to the shorter ones: the discount times the kinds, and the windows left out
        weights = cut(sums.select("lang", "context", "total", (1 - F.col("mass") / F.col("total")).alias("weight")))
        own = own.join(weights, ["lang", "context"])
        if k == 1:
            own = own.withColumn("p", F.col("kept") / F.col("total") + F.col("weight") / (F.col("chars") + 1))
            uniform = own.groupBy("lang").agg(F.first(F.log(F.col("weight") / (F.col("chars") + 1))).alias("logp"))
            out.append(uniform.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), "logp", F.lit(None).cast("double").alias("bow")))
        else:
            shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1)).join(shorter, ["lang", "suffix"])
            own = own.withColumn("p", F.col("kept") / F.col("total") + F.col("weight") * F.col("q"))
            out.append(weights.where("weight < 1").select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("weight").alias("bow")))
        below = cut(own.select("lang", "gram", "p", "kept"))
        out.append(below.where("kept > 0").select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("bow")))
    return reduce(DataFrame.union, out).groupBy("lang", "k", "gram").agg(F.max("logp").alias("logp"), F.max("bow").alias("bow"))


class Models:
    """The models of all languages in one sorted array of hashes: ``logp`` and ``bow`` have a column for each language."""

    def __init__(self, langs: list[str], rows: pa.Table) -> None:
        self.langs = langs
        k, gram = (rows.column(c).to_numpy() for c in ("k", "gram"))
        which = np.searchsorted(np.array(langs, object), rows.column("lang").to_numpy(zero_copy_only=False))
        logp, bow = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("logp", "bow"))
        keys = hashed(gram.view(np.uint64))
        self.keys, at = np.unique(keys, return_inverse=True)
        order = np.zeros(len(self.keys), np.int8)
        order[at] = k
        grams = np.zeros(len(self.keys), np.uint64)
        grams[at] = gram.view(np.uint64)
        self.logp = np.full((len(self.keys), len(langs)), np.nan, np.float32)
        self.bow = np.zeros((len(self.keys), len(langs)), np.float32)
        some = ~np.isnan(logp)
        self.logp[at[some], which[some]] = logp[some]
        some = ~np.isnan(bow)
        self.bow[at[some], which[some]] = bow[some]
        self.none = self.logp[self.find(np.zeros(1, np.uint64))][0]
        for n in range(1, ORDER + 1):  # where a language lacks a window: its context's weight and the shorter window
            at = np.flatnonzero(order == n)
            self.logp[at] = np.where(np.isnan(self.logp[at]), self.backed(grams[at], n), self.logp[at])

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The places of packed windows, or -1."""
        h = hashed(grams)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def backed(self, grams: np.ndarray, n: int) -> np.ndarray:
        """The log-probabilities of windows of n characters by the shorter ones."""
        if n == 1:
            return np.broadcast_to(self.none, (len(grams), len(self.langs)))
        context = self.find(grams >> np.uint64(BITS))
        weight = np.where(context[:, None] >= 0, self.bow[context], 0)
        return weight + self.of(grams & np.uint64((1 << (BITS * (n - 1))) - 1), n - 1)

    def of(self, grams: np.ndarray, n: int = ORDER) -> np.ndarray:
        """The log-probabilities (windows x languages)."""
        at = self.find(grams)
        out = self.logp[at]
        missed = np.flatnonzero((at < 0) | np.isnan(out[:, 0]))
        if len(missed):
            out[missed] = self.backed(grams[missed], n)
        return out


def hashed(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return grams * SPREAD


#: Windows that are looked up at once.
AT_ONCE = 1 << 16


def scored(models: Models) -> Callable[[list[str | None]], list[list]]:
    """From texts to the lists of FIELDS."""

    def work(texts: list[str | None]) -> list[list]:
        x, starts = codes(texts)
        w = windows(x)
        ends = np.maximum(starts[1:] - ORDER + 1, 0)
        sums = np.zeros((len(texts), len(models.langs)))
        for i in range(0, len(w), AT_ONCE):
            p = models.of(w[i : i + AT_ONCE])
            a, b = np.searchsorted(ends, i, "right"), np.searchsorted(starts[:-1], i + len(p), "left")
            for t in range(a, min(b, len(texts))):  # windows from a text's beginning to its end
                sums[t] += p[max(starts[t] - i, 0) : max(ends[t] - i, 0)].sum(0, dtype=np.float64)
        out: list[list] = [[], [], []]
        for t, s in enumerate(sums):
            n = int(ends[t] - starts[t])
            if n <= 1:  # the gap alone
                row = (UNKNOWN, 0.0, None)
            else:
                h = -s / n
                best = int(np.argmin(h))
                other = np.delete(h, best)
                row = models.langs[best], float(other.min() - h[best]) * float(np.log2(1 + n)) if len(other) else 0.0, float(h[best])
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return out

    return work


def models_of(grams: DataFrame, most: int = MOST_WINDOWS) -> dict[str, Models]:
    """The models of ``grams`` (of, lang, gram, n) by ``of``, a letter; those of several are made by the same joins."""
    named = F.concat("of", "lang").alias("lang")
    made = probabilities(cut(grams.select(named, "gram", "n")), most).toArrow()
    of = pc.utf8_slice_codeunits(made.column("lang"), 0, 1)
    made = made.set_column(made.column_names.index("lang"), "lang", pc.utf8_slice_codeunits(made.column("lang"), 1))
    parts = {x: made.filter(pc.equal(of, x)) for x in pc.unique(of).to_pylist()}
    return {x: Models(sorted(set(t.column("lang").to_pylist())), t) for x, t in parts.items()}


def predicted(rows: DataFrame, models: Models) -> DataFrame:
    """``rows`` with FIELDS. The models' arrays are broadcast; MOST_WINDOWS bounds them."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    return map_texts(rows, "text", FIELDS, DDL, lambda: scored(sent.value))


#: Steps of evidence, and the evidence of the last.
STEP, LAST = 1 / 16, 400


def calibration(rows: DataFrame) -> tuple[list[float], float]:
    """The share of right answers at each step of evidence, ascending, from rows (lang, lang_pred, evidence); and the evidence from which
    TRUST of the answers are right. A row for each step is collected."""
    step = F.least(F.floor(F.col("evidence") / STEP), F.lit(LAST)).cast("int")
    by = rows.where(F.col("lang_pred") != UNKNOWN).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    counts = {r["step"]: (r["right"], r["n"]) for r in by}
    blocks: list[list[float]] = []  # (right, all, steps), pooled until their shares ascend
    for i in range(LAST + 1):
        right, n = counts.get(i, (0, 0))
        blocks.append([right + 1e-3, n + 2e-3, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    shares = [right / n for right, n, steps in blocks for _ in range(int(steps))]
    right = n = 0
    floor = float(LAST)
    for i in range(LAST, -1, -1):
        right, n = right + counts.get(i, (0, 0))[0], n + counts.get(i, (0, 0))[1]
        if n and right >= TRUST * n:
            floor = i * STEP
    return shares, floor


def identified(docs: DataFrame, learn: Column, calibrate: Column, most: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` (text, lang, others) with lang_pred, score, accepted, evidence and entropy.

    ``learn`` says which rows may teach, ``calibrate`` which third of these fits the scores, by models that don't know them.
    """
    new = ["lang_pred", "score", "accepted", "evidence", "entropy"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    teach = docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fold = F.coalesce(calibrate, F.lit(False))
    grams = cut(counted(teach, fold))
    every = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    both = every.withColumn("of", F.lit("a")).unionByName(grams.where("NOT fold").drop("fold").withColumn("of", F.lit("f")))
    made = models_of(both, 2 * most)
    models, fewer = made.get("a"), made.get("f")
    if models is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(0.0).alias("evidence"), F.lit(None).cast("double").alias("entropy"))
    shares, floor = [0.5] * (LAST + 1), 0.0
    if fewer is not None:
        shares, floor = calibration(predicted(teach.where(fold).select("text", "lang"), fewer))
    out = predicted(docs, models)
    step = F.least(F.floor(F.col("evidence") / STEP), F.lit(LAST)).cast("int")
    known = F.col("lang_pred") != UNKNOWN
    score = F.when(known, F.round(F.element_at(F.lit([float(x) for x in shares]), step + 1), 6)).otherwise(0.0)
    return out.withColumns({"score": score, "accepted": known & (F.col("evidence") >= floor)})
