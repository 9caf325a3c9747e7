"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased; its n-grams of NGRAMS characters, hashed into 2**BITS features, count once
each. A feature's value is its log-count ratio between the classes; logistic regression with an L2
penalty weighs these values (as in Wang and Manning, 2012). Learning takes a bounded sample, at most SAMPLE
labelled documents of either label, the first by hash of the id; the intercept is then set where the
fewest of them are wrong, each label weighed by its share among all labelled documents.

Spark counts the sample's features by label; only those whose ratio says something, the most telling first until the documents hold
MOST_ENTRIES of them, and each document's list of them, go to the driver, where the weights are fitted.

Defined results: a null or empty text has no n-gram, and the score that the intercept gives. Rows
without an id are held out of learning. Labels that are null, or differ for one id, are not learnt
from; of an id that rows repeat, the text with the smallest MD5 is. Ids are compared as text. Without labels
of both kinds every score is the share of label 1 (0 without labels).
Other columns of either table are left out, whatever their names. Equal texts have equal scores; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, slices

NGRAMS, BITS = (3, 4, 5), 18
#: Labelled documents of either label that are learnt from, at most.
SAMPLE = 2_000
#: A feature must be in this many of them.
LEAST_DOCS = 5
#: Features whose log-count ratio is nearer to zero say nothing and are left out.
LEAST_RATIO = 0.6
SMOOTHING, PENALTY, STEPS = 1.0, 0.02, 100
#: Entries of the documents' lists that the driver gets, at most: beyond, the features that say least are left out.
MOST_ENTRIES = 16_000_000


def features(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the numbers of its features, each once, sorted."""
    flat = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in flat])
    hashes = []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            h = np.zeros(max(0, len(codes) - n + 1), np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            hashes.append(((h + np.uint32(n)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    mark, out, start = np.zeros(1 << BITS, bool), [], 0
    for end in ends.tolist():
        own = [h[start : max(start, end - n + 1)] for n, h in zip(NGRAMS, hashes, strict=True)]
        for x in own:
            mark[x] = True
        seen = np.flatnonzero(mark)
        mark[seen] = False
        out.append(seen)
        start = end
    return out


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(id string, y int, text) of the documents to learn from, one row of each id and 2 * size at most; how many
    each label has."""
    named = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(bucket_of(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").cast("string").alias("id"))
        .agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("y2"))
        .where("y = y2 AND y IN (0, 1)")
        .select("id", "y")
    )
    counts = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    order = [F.md5(F.col("id").cast("binary")), F.col("id")]
    first = [named.where(F.col("y") == y).orderBy(*order).limit(size) for y in (0, 1)]
    chosen = first[0].unionByName(first[1]).withColumnRenamed("id", "__id")  # 2 * size rows at most: broadcast
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("__id") == F.col("id"))
    return met.groupBy("id", "y").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text")), counts


def lists_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the lists in ``f``, one after another, and the lists' sizes."""
    lists = rows.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def featured(chosen: DataFrame) -> DataFrame:
    """(id, y, f): each document's features."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [f.astype(np.int32) for f in features(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "f"])

    return chosen.select("id", "y", "text").mapInArrow(task, "id string, y int, f array<int>")


def ratios(rows: DataFrame) -> np.ndarray:
    """The log-count ratio of every feature: 0 if it is in under LEAST_DOCS documents, or nearer to zero than LEAST_RATIO."""
    each = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg((SMOOTHING + F.sum("y")).alias("p"), (SMOOTHING + F.sum(1 - F.col("y"))).alias("q"))
    often = cut(each.where(F.col("p") + F.col("q") - 2 * SMOOTHING >= LEAST_DOCS))
    all_p, all_q = often.agg(F.sum("p"), F.sum("q")).first()
    out = np.zeros(1 << BITS)
    if all_p:
        ratio = F.log((F.col("p") / F.lit(all_p)) / (F.col("q") / F.lit(all_q)))
        entries = (F.col("p") + F.col("q") - 2 * SMOOTHING).cast("long").alias("n")
        told = often.select("f", ratio.alias("r"), entries).where(F.abs("r") >= LEAST_RATIO).toArrow()  # 2**BITS rows at most
        f, r, n = (told.column(c).to_numpy() for c in ("f", "r", "n"))
        order = np.lexsort((f, -np.abs(r)))
        kept = order[np.cumsum(n[order]) <= MOST_ENTRIES]
        out[f[kept]] = r[kept]
    return out


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of every feature (log-count ratio included) and the intercept."""
    chosen, counts = sample(docs, labels)
    zero = np.zeros(1 << BITS, np.float32)
    if not (counts.get(0) and counts.get(1)):
        n = sum(counts.values())
        p = counts.get(1, 0) / n if n else 0.0
        return zero, float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
    rows = cut(featured(chosen))
    ratio = ratios(rows)
    sent = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def told(batches):
        for batch in batches:
            found = [f[sent.value[f]] for f in batch.column(2).to_numpy(zero_copy_only=False)]
            yield batch.set_column(2, "f", pa.array(found, pa.list_(pa.int32())))

    kept = rows.mapInArrow(told, rows.schema).toArrow().sort_by([("id", "ascending")])
    if not kept.num_rows:
        return zero, 0.0
    return fitted(*lists_of(kept), kept.column("y").to_numpy().astype(np.float64), ratio, counts[1] / (counts[0] + counts[1]))


def fitted(index: np.ndarray, sizes: np.ndarray, y: np.ndarray, ratio: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights (times the ratios) and intercept from the documents' features, all with a ratio."""
    size, doc = len(ratio), np.repeat(np.arange(len(y)), sizes)
    value = ratio[index]

    def margins(w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(doc, value * w[index], len(y)) + b

    # gradient steps with momentum (Nesterov); the step from a bound on the curvature
    w = v = np.zeros(size)
    b = vb = 0.0
    norm = np.bincount(doc, value**2, len(y))
    step = 4.0 / (norm.mean() * 2 + 1 + 4 * PENALTY)
    for i in range(STEPS):
        s = 1 / (1 + np.exp(-np.clip(margins(v, vb), -30, 30)))
        err = (s - y) / len(y)
        gw = np.bincount(index, value * err[doc], size) + PENALTY * v / len(y)
        nw, nb = v - step * gw, vb - step * err.sum()
        m = i / (i + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    b = balanced(margins(w, 0.0), y, share)
    return (w * ratio).astype(np.float32), b


def balanced(margin: np.ndarray, y: np.ndarray, share: float) -> float:
    """The intercept with the fewest errors, weighed by the labels' shares among all labelled
    documents; where a range of intercepts is as good, its middle."""
    order = np.argsort(margin, kind="stable")
    m, own = margin[order], y[order]
    cost1, cost0 = share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)
    below1, above0 = np.cumsum(np.append(0, own)), np.cumsum(np.append(0, (1 - own)[::-1]))[::-1]
    errors = cost1 * below1 + cost0 * above0  # of the threshold before the i-th of the sorted margins
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    i = int(best[len(best) // 2])
    lo, hi = m[max(i - 1, 0)], m[min(i, len(m) - 1)]
    return -float(lo + hi) / 2


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` (the probability of label 1) from the texts alone."""
    weights, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def make():
        w = sent.value

        def work(texts: list) -> list[list]:
            margin = np.array([float(w[f].sum(dtype=np.float64)) for f in features(texts)]) + intercept
            return [(1 / (1 + np.exp(-np.clip(margin, -35, 35)))).tolist()]

        return work

    return map_texts(docs, "text", {"score": pa.float64()}, "score double", make)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels))
    held = F.coalesce(bucket_of(F.col("doc_id")) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
