"""Logic that follows an order inside a group: neighbours, carrying, renumbering, runs, rates.

Each is a window partitioned by its group, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def carried_to_next(df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "carried") -> DataFrame:
    """What one row yields is the next row's."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def carried_conflicts(df: DataFrame, group: list[str], order: list[str], yields: Column, own: Column) -> DataFrame:
    """Rows that have a value of their own although the row before yields another: (…, own, carried). Such rows keep their own."""
    out = carried_to_next(df.withColumn("own", own), group, order, yields)
    return out.where(F.col("carried").isNotNull() & F.col("own").isNotNull() & (F.col("carried") != F.col("own")))


def filled_forward(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Each value, where it is null, from the last row that has one."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.last(v, ignorenulls=True).over(w) for k, v in values.items()})


def context(df: DataFrame, group: list[str], order: list[str], levels: dict[str, Column]) -> DataFrame:
    """Heading levels, outermost first, filled forward; a new heading resets the deeper ones."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out, above = df, []
    for name, value in levels.items():
        part = Window.partitionBy(*group, *above).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.last(value, ignorenulls=True).over(part))
        out = out.withColumn(f"__{name}", F.count(value).over(w))
        above.append(f"__{name}")
    return out.drop(*above)


def groups_from_starts(df: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """A number for each run of rows, which a row with ``starts`` begins."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def runs(df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str = "run") -> DataFrame:
    """A number for each run of rows with the same ``value``."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__c", changed.cast("int"))
    return marked.withColumn(name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def renumbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "ordem") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def inserted(df: DataFrame, extra: DataFrame, group: list[str], anchor: str = "ordem") -> DataFrame:
    """``extra`` rows (with ``after``, a position, and ``seq``) put behind their anchors in a stable order, all renumbered."""
    base = df.withColumns({"__a": F.col(anchor), "__s": F.lit(0)})
    more = extra.withColumns({"__a": F.col("after"), "__s": F.col("seq")}).drop("after", "seq")
    both = base.unionByName(more, allowMissingColumns=True)
    return renumbered(both, group, ["__a", "__s"], anchor).drop("__a", "__s")


def unique_slugs(df: DataFrame, group: list[str], slug: str, order: list[str]) -> DataFrame:
    """The second and later rows of a slug get its number appended."""
    n = F.row_number().over(Window.partitionBy(*group, slug).orderBy(*order))
    return df.withColumn("__n", n).withColumn(slug, F.when(F.col("__n") > 1, F.concat(F.col(slug), F.lit("-"), F.col("__n"))).otherwise(F.col(slug))).drop("__n")


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_among_last(df: DataFrame, key: str, order: list[Column], last: int) -> DataFrame:
    """Of the ``last`` rows overall, the latest of each key; a key without a row there is left out."""
    return first_of(df.orderBy(*order).limit(last), [key], order)


def over_rate(df: DataFrame, key: str, at_ms: Column, most: int, window_ms: int) -> DataFrame:
    """``df`` with ``in_window`` and ``refused``: over ``most`` attempts in the time up to each one,
    refused attempts counted too.

    A key's attempts are dealt by stretches of ``window_ms``, and each attempt is also context in the next stretch, so that
    a key with a third of all attempts is spread over as many tasks as it has stretches.
    """
    out = df.withColumn("__ms", at_ms)
    stretch = F.floor(F.col("__ms") / window_ms)
    out = out.withColumn("__s", F.explode(F.array(F.struct(stretch.alias("n"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("n"), F.lit(False).alias("own")))))
    w = Window.partitionBy(key, "__s.n").orderBy("__ms").rangeBetween(-(window_ms - 1), 0)
    out = out.withColumn("in_window", F.count("*").over(w)).where("__s.own")
    return out.withColumn("refused", F.col("in_window") > most).drop("__ms", "__s")


def republished(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last publication of each key, with how many it replaced."""
    w = Window.partitionBy(*key)
    out = df.withColumn("replaced", F.count("*").over(w) - 1)
    return first_of(out, key, order)


def out_of_sequence(df: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number isn't above all before it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("highest", F.max(number).over(w)).where(F.col(number) <= F.col("highest"))


#: A caput with fewer characters is suspicious.
SHORT = 15


def anomalies(df: DataFrame, group: list[str], number: str, order: list[str], caput: str) -> DataFrame:
    """``df`` with ``problem`` and ``after``: a row for each number below the highest before it in its group ("out of order", after that one), and for each
    caput that is too short ("short caput")."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(number).over(w)
    found = F.array(
        F.when(F.col(number) < F.col("__h"), F.struct(F.lit("out of order").alias("problem"), F.col("__h").alias("after"))),
        F.when(F.length(F.trim(F.coalesce(F.col(caput), F.lit("")))) < SHORT, F.struct(F.lit("short caput").alias("problem"), F.lit(None).cast(dict(df.dtypes)[number]).alias("after"))),
    )
    out = df.withColumn("__h", highest).withColumn("__p", F.explode(F.array_compact(found)))
    return out.select(*df.columns, "__p.problem", "__p.after")


def last_turns(df: DataFrame, thread: str, turn: str, most: int, before: int | None = None) -> DataFrame:
    """The last ``most`` turns of each thread, up to a turn (exclusive) if given."""
    part = df.where(F.col(turn) < before) if before is not None else df
    w = Window.partitionBy(thread).orderBy(F.col(turn).desc())
    return part.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def inherited(df: DataFrame, thread: str, turn: str, ids: str, most: int) -> DataFrame:
    """(thread, id, rank): ids named in a thread's turns, the latest first, each once, ``most`` at most."""
    each = df.select(thread, turn, F.posexplode(ids).alias("__p", "id"))
    once = first_of(each, [thread, "id"], [F.col(turn).desc(), F.col("__p")])
    w = Window.partitionBy(thread).orderBy(F.col(turn).desc(), "__p", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(thread, "id", "rank")


def time_bucket(days: Column) -> Column:
    """How long ago, in the groups of a list: today, yesterday, a week, a month, earlier."""
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "7 days").when(days <= 30, "30 days").otherwise("earlier")
