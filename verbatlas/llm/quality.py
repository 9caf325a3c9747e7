"""Quality rules whose cutoffs adapt to the language and source of a document.

A base rule with fixed cutoffs comes first. The method's verdict then compares four ratios of a
document that passes it with fences that mergeable quantile sketches, of the documents that pass it, give for its
(lang, source). What the sketch says is the cutoff, within the width of a bucket, its resolution:

- symbols (beyond the first FREE_SYMBOLS of a text) and characters to a word: the upper quartile plus FENCE times the
  spread between the quartiles, so that up to a quarter of a source can be junk;
- words in repeated windows to all words, and repeated lines to all lines: the quantile TAIL, as an ordinary text has
  some of them.

The sketch is a log-linear histogram: a non-negative number keeps its five leading bits, so a
bucket's width is at most 1/16 of its value, and buckets with their counts are plain rows. Sketches
merge by adding counts, in any order with equal results; those of small groups fall back on the
merged sketch of the language, and then on that of the corpus.

Defined results: a null or empty text has no word, fails the base rule and is not kept. Null
languages and sources are groups of their own. Ties and repeated rows get equal verdicts; an empty
table gives an empty result. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_dimension, map_texts

#: Fewest words of a document, and the most of 100 words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: A group needs this many documents for a sketch of its own: the quantile TAIL has one of them above it.
LEAST_DOCS = 200

#: Times the spread between the quartiles; the quantile (a of b) of the other metrics; symbols that don't count.
FENCE, TAIL, FREE_SYMBOLS = 4, (995, 1000), 3
SPREAD_METRICS, TAIL_METRICS = ("symbols", "word_len"), ("repeats", "dup_lines")
METRICS = ["symbols", "repeats", "dup_lines", "word_len"]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Those, and the lines with a word.
MEASURED = [*COUNTS, "n_lines"]
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(window):
            h = (h ^ (w[i : i + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal hashes: none repeats
        return 0
    exact, size = w.astype(np.int64), len(ids)  # ranks of ever longer windows: no collision counts
    rank = exact
    for i in range(1, window):
        rank = np.unique(rank[: len(exact) - i] * size + exact[i:], return_inverse=True)[1]
    often = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(often), 1)
    np.add.at(marks, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of MEASURED for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with MEASURED as longs and ``base_failed``."""

    def make():
        return lambda texts: list(zip(*map(counts_of, texts), strict=True)) if texts else [[]] * len(MEASURED)

    out = map_texts(docs, "text", dict.fromkeys(MEASURED, pa.int64()), ", ".join(f"{c} long" for c in MEASURED), make)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    """In thousandths, rounded down: whole numbers, so that no engine rounds them differently."""
    return {
        "symbols": F.expr(f"greatest(n_symbols - {FREE_SYMBOLS}, 0) * 1000 div greatest(n_words, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "word_len": F.expr("word_chars * 1000 div greatest(n_words, 1)"),
    }


def dropped_bits(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - 5, F.lit(0))


def bucket(v: Column) -> Column:
    """The lower end of a number's bucket: its five leading bits, the rest zero."""
    drop = dropped_bits(v)
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def width(v: Column) -> Column:
    """The width of a number's bucket."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), dropped_bits(v))


def sketches(df: DataFrame, levels: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(level, keys..., metric, bucket, n): the histogram of every group at every level, merged upwards."""
    one = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])
    base = df.select(*levels, *[c.alias(m) for m, c in ratios().items()]).select(*levels, F.explode(one).alias("b"))
    own = cut(base.groupBy(*levels, "b.metric", "b.bucket").agg(F.count("*").alias("n")))
    out = own.withColumn("level", F.lit(len(levels)))
    for k in range(len(levels) - 1, -1, -1):
        up = own.groupBy(*levels[:k], "metric", "bucket").agg(F.sum("n").alias("n"))
        out = out.unionByName(up.withColumns({c: F.lit(None).cast(own.schema[c].dataType) for c in levels[k:]} | {"level": F.lit(k)}))
    return out


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, tuple[int, int]]) -> DataFrame:
    """Quantiles of each histogram: for a share a/b, the first bucket that reaches it; and ``docs``."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys)
    run = sketch.withColumns({"total": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("bucket"))})
    found = {q: F.min(F.when(F.col("upto") * b >= F.col("total") * a, F.col("bucket"))) for q, (a, b) in at.items()}
    return run.groupBy(*keys).agg(F.max("total").alias("docs"), *[c.alias(q) for q, c in found.items()])


def fences(df: DataFrame) -> DataFrame:
    """(lang, source, max_<metric>...): one row for each group of documents that pass the base rule, small
    groups by fallback."""
    at = {"q1": (1, 4), "q3": (3, 4), "tail": TAIL}
    q = cut(quantiles(sketches(df.where("NOT base_failed")), ["level", "lang", "source", "metric"], at))
    by_spread = F.col("q3") + FENCE * (F.col("q3") - F.col("q1") + width(F.col("q3")))
    q = q.withColumn("fence", F.when(F.col("metric").isin(*SPREAD_METRICS), by_spread).otherwise(F.col("tail") + width(F.col("tail"))))
    enough = q.where(F.col("docs") >= LEAST_DOCS)
    groups = q.where("level = 2").select("lang", "source", "metric")
    of_lang = enough.where("level = 1").select("lang", "metric", F.col("fence").alias("f1"))
    of_all = q.where("level = 0").select("metric", F.col("fence").alias("f0"))  # four rows at most
    of_own = enough.where("level = 2").select("lang", "source", "metric", F.col("fence").alias("f2"))
    out = join_dimension(groups, of_own, ["lang", "source", "metric"])
    out = join_dimension(out, of_lang, ["lang", "metric"])
    out = join_dimension(out, of_all, ["metric"])
    chosen = F.coalesce("f2", "f1", "f0")
    most = [F.max(F.when(F.col("metric") == m, chosen)).alias(f"max_{m}") for m in METRICS]
    return out.groupBy("lang", "source").agg(*most)


def verdicts(df: DataFrame, limits: DataFrame) -> DataFrame:
    """``df`` (from ``measured``) with ``kept``."""
    over = F.lit(False)
    for m, c in ratios().items():
        over = over | (bucket(c) > F.col(f"max_{m}"))
    out = join_dimension(df, limits, ["lang", "source"]).withColumn("kept", ~F.col("base_failed") & ~over)
    return out.drop(*[f"max_{m}" for m in METRICS])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, MEASURED, base_failed and kept of every row; the texts are read once."""
    rows = cut(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return verdicts(rows, cut(fences(rows)))


def filtered(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject. The texts are read twice and never shuffled."""
    rows = cut(measured(docs.select("lang", "source", "text")).drop("text"))
    limits = cut(fences(rows))
    inner = docs.select(*[F.col(c).alias(f"__in_{c}") for c in docs.columns], "lang", "source", "text")
    return verdicts(measured(inner), limits).where("kept").select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])
