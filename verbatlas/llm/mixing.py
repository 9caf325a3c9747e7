"""Mixing sources to target weights by iterative proportional fitting.

The tokens (words) of the documents are summed for every cell of source, language and topic. The
cells' weights are raked: scaled to the target of each source, then of each language, then of each
topic, in rounds, until no marginal is further from its target than TOLERANCE (or MOST_ROUNDS are
over; ``residual`` has the largest relative difference). A document's rate is its cell's weight over its
cell's tokens, divided by the rate that cells with FULL of all tokens don't exceed, and 1 at most; so it is
a probability, and a tiny cell that is lifted much doesn't shrink the sample of all others: it is taken whole, and
falls short of its target. A document is sampled if a number from the hash of its id is below its rate.
The expected tokens of the sample then have the target marginals, but for the cells taken whole.

A target is given as shares, or follows from the tokens' own shares raised to a power below one,
which lifts small groups. Where a table has no topics, ``topic_of`` gives a text's register.

Defined results: null sources, languages and topics are a value of their own, '(none)'. Empty and
null texts have no token: their rate is their cell's, or 1 in a cell without any token. A null id is
replaced by the text's hash. Equal rows are sampled alike; ties need no order. An empty table gives an empty result. Columns
with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hex_of, join_dimension

DIMENSIONS = ["source", "lang", "topic"]
#: The power of a dimension's token shares that gives its target shares.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: The largest relative difference of a marginal from its target, and the rounds after which raking stops at any rate.
TOLERANCE, MOST_ROUNDS = 1e-9, 60
#: Rounds between two looks at the difference.
ROUNDS = 6
#: The share of all tokens whose cells' rates are not capped, at least.
FULL = 0.99
#: Up to this many cells are raked in one task; more are shuffled by each dimension in turn.
CELLS_IN_TASK = 20_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A text's register, by its characters: tabular, symbolic, shouted, personal or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "tabular")
        .when(10 * F.regexp_count(t, F.lit("[#*$%&<>]")) > F.length(t), "symbolic")
        .when(2 * F.regexp_count(t, F.lit("[A-Z]")) > F.length(t), "shouted")
        .when(t.rlike("[0-9]"), "personal")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def dimensions(df: DataFrame, topic: Column | None = None) -> dict[str, Column]:
    topic = topic if topic is not None else topic_of(F.col("text"))
    return {"source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "topic": F.coalesce(topic, F.lit(NONE))}


def targets(cells: DataFrame, d: str, power: float) -> Column:
    """A dimension's target tokens, from the window sums over the cells: they sum up to all tokens."""
    own = F.sum("tokens").over(Window.partitionBy(d))
    return F.when(own > 0, F.pow(own.cast("double"), F.lit(power))).otherwise(0.0)


def raked(cells: DataFrame, powers: dict[str, float] | None = None, shares: dict[str, dict[str, float]] | None = None, most: int = MOST_ROUNDS) -> DataFrame:
    """``cells`` (DIMENSIONS, tokens) with ``weight``, ``rate`` and ``residual``.

    ``shares`` gives a dimension's target shares by value (missing values: none); a dimension without
    them follows ``powers``. Shares of values without a row go to the others; targets that no weights can meet leave
    a residual.
    """
    powers = POWERS | (powers or {})
    small = cells.count() <= CELLS_IN_TASK
    cells = cells.coalesce(1) if small else cells
    every = Window.partitionBy(F.lit(1)) if small else None

    def total(df: DataFrame, c: Column) -> Column:
        """The sum over all cells: in the one task, or as a number known beforehand."""
        return F.sum(c).over(every) if every is not None else F.lit(df.agg(F.sum(c)).first()[0] or 0.0)

    df = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        if shares and d in shares:
            cases = [F.when(F.col(d) == v, F.lit(float(s))) for v, s in shares[d].items()]
            df = df.withColumn(f"to_{d}", F.coalesce(*cases, F.lit(0.0)))
        else:
            df = df.withColumn(f"to_{d}", targets(df, d, powers[d]))
    if every is None:
        df = cut(df)
    for d in DIMENSIONS:  # each value once in the sum of its dimension's targets
        n = F.count("*").over(Window.partitionBy(d))
        df = df.withColumn(f"__n_{d}", n)
        df = df.withColumn(f"__sum_{d}", total(df, F.col(f"to_{d}") / F.col(f"__n_{d}")))
        df = df.withColumn(f"to_{d}", F.col(f"to_{d}") / F.greatest(F.col(f"__sum_{d}"), F.lit(1e-300))).drop(f"__n_{d}", f"__sum_{d}")
    df = df.withColumn("__all", total(df, F.col("weight")))
    residual, done = 1.0, 0
    while residual > TOLERANCE and done < most:
        for _ in range(min(ROUNDS, most - done)):
            done += 1
            for d in DIMENSIONS:
                df = df.withColumn("__own", F.sum("weight").over(Window.partitionBy(d)))
                df = df.withColumn("weight", F.when(F.col("__own") > 0, F.col("weight") * F.col(f"to_{d}") * F.col("__all") / F.col("__own")).otherwise(0.0)).drop("__own")
            if not small:
                df = cut(df)
        df = cut(df)
        off = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"to_{d}") * F.col("__all")) / F.greatest(F.col(f"to_{d}") * F.col("__all"), F.lit(1e-300)) for d in DIMENSIONS]
        now = df.select(F.greatest(*off).alias("off"), F.greatest(*[F.col(f"to_{d}") for d in DIMENSIONS]).alias("to")).where("to > 0").agg(F.max("off")).first()[0] or 0.0
        if now >= residual and done > ROUNDS:  # no weights meet the targets, or the numbers' last digits are reached
            residual = now
            break
        residual = now
    df = df.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    rate = F.round(F.coalesce(F.least(F.col("rate") / F.lit(full_rate(df)), F.lit(1.0)), F.lit(1.0)), 9)
    return df.withColumns({"rate": rate, "residual": F.lit(residual)}).drop("__all", *[f"to_{d}" for d in DIMENSIONS])


def full_rate(cells: DataFrame) -> float:
    """The rate that becomes 1: of the cells in order of it, with FULL of all tokens, the highest. The order is
    by steps of a sixteenth of its logarithm, so that it is a sum over few hundred rows."""
    step = F.floor(F.log(F.col("rate")) * 16)
    sums = cells.where("rate > 0").groupBy(step.alias("step")).agg(F.sum("tokens").alias("tokens"), F.max("rate").alias("rate")).orderBy("step").collect()
    need, upto = FULL * sum(r["tokens"] for r in sums), 0
    for r in sums:
        upto += r["tokens"]
        if upto >= need:
            return r["rate"]
    return 1.0


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` without ``text``, with DIMENSIONS (never null), n_tokens and ``__u``, the number that decides."""
    own = dimensions(docs, topic)
    new = {d: own[d] for d in DIMENSIONS} | {"n_tokens": n_tokens(F.col("text")), "__u": drawn(F.col("doc_id"), F.col("text"))}
    return docs.withColumns({f"__new_{k}": c for k, c in new.items()}).select(
        *[c for c in docs.columns if c not in (*new, "text", "rate", "sampled")], *[F.col(f"__new_{k}").alias(k) for k in new]
    )


def rates(rows: DataFrame, **raking) -> tuple[DataFrame, int]:
    """(DIMENSIONS, tokens, docs, weight, rate, residual), a row for each cell of ``measured`` rows, written; and
    how many cells."""
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    out = cut(raked(cells, **raking))
    return out, out.count()


def drawn(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the hash of the id."""
    return hex_of(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))) / F.lit(float(1 << 48))


def decided(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """``measured`` rows with ``rate`` and ``sampled``. The cells' rates are broadcast if few."""
    out = join_dimension(rows, table.select(*DIMENSIONS, "rate"), DIMENSIONS, n)
    return out.withColumn("sampled", F.col("__u") < F.col("rate")).drop("__u")


def mixed(docs: DataFrame, topic: Column | None = None, **raking) -> DataFrame:
    """``docs`` without its texts, which are read once, with topic, n_tokens, rate and sampled."""
    rows = cut(measured(docs, topic))
    return decided(rows, *rates(rows, **raking))


def sampled(docs: DataFrame, topic: Column | None = None, **raking) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns. The texts are read twice and never shuffled."""
    table, n = rates(measured(docs.select("doc_id", "text", "source", "lang"), topic), **raking)
    kept = docs.select(*[F.col(c).alias(f"__in_{c}") for c in docs.columns], "doc_id", "text", "source", "lang")
    return decided(measured(kept, topic), table, n).where("sampled").select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])
