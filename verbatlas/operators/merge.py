"""Writing increments: idempotent upserts, values gated by a hash, removals within a scope.

A table is a DataFrame; each function returns the table's next state, to be written as a new directory
and swapped in after validation. All are joins on the key, and applying one twice equals applying it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, but for the columns in ``keep``; others
    are added. Columns that ``new`` lacks keep their value (null in added rows).

    Null is a key like any other. A key that ``new``, or ``old``, has twice stops the job, as a primary key would: take
    ``last_of_key`` first. Both sides are stacked and grouped by the key: one shuffle.
    """
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    n = new.select(*keys, F.struct(*new.columns).alias("n"))
    both = o.unionByName(n, allowMissingColumns=True).groupBy(*keys).agg(
        F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n"), F.greatest(F.count("o"), F.count("n")).alias("times")
    )
    named = F.concat(F.lit("a key is there twice: "), F.to_json(F.struct(*keys)))
    both = both.where(F.when(F.col("times") > 1, F.raise_error(named).cast("boolean")).otherwise(True))
    taken, had = F.col("n").isNotNull(), F.col("o").isNotNull()
    picked = []
    for c in old.columns:
        if c in keys:
            picked.append(F.col(c))
        elif c not in new.columns:
            picked.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            picked.append(F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            picked.append(F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*picked)


def upsert_gated(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str, gated: str) -> DataFrame:
    """``new`` with the costly column ``gated`` carried over from ``old`` where the hash is unchanged and null
    where it changed: only these are computed again. Rows of ``old`` that ``new`` lacks stay."""
    before = old.select(*keys, F.col(hash_col).alias("__h"), F.col(gated).alias("__v"))
    fresh = new.drop(gated).join(before, keys, "left").withColumn(gated, F.when(F.col("__h") == F.col(hash_col), F.col("__v"))).drop("__h", "__v")
    return fresh.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*fresh.columns))


def pruned(table: DataFrame, incoming: DataFrame, key: str, scope: Column) -> DataFrame:
    """The table without the rows of a scope whose key isn't in the increment."""
    inside = table.where(scope).join(incoming.select(key), key, "left_semi")
    return inside.unionByName(table.where(~F.coalesce(scope, F.lit(False))))


def removed(table: DataFrame, incoming: DataFrame, key: str, scope: Column) -> DataFrame:
    return table.where(scope).join(incoming.select(key), key, "left_anti")


def new_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def set_from_arrays(table: DataFrame, key: str, value: str, arrays: DataFrame, ids: str, values: str) -> DataFrame:
    """Sets ``value`` of the rows named in parallel arrays; a shorter array ends both."""
    pairs = arrays.select(F.explode(F.arrays_zip(F.col(ids).alias("k"), F.col(values).alias("v"))).alias("p")).select(F.col("p.k").alias(key), F.col("p.v").alias("__v"))
    pairs = pairs.where(F.col(key).isNotNull())
    return table.join(pairs, key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def promoted(table: DataFrame, latest: DataFrame, key: str, flag: str, norm: str) -> DataFrame:
    """Pending rows get a norm, and their flag, where the latest status names one; a set flag never falls."""
    found = latest.select(key, F.col(norm).alias("__found"))
    out = table.join(found, key, "left")
    gained = ~F.col(flag) & F.col("__found").isNotNull()
    return out.withColumn(norm, F.when(gained, F.col("__found")).otherwise(F.col(norm))).withColumn(flag, F.col(flag) | gained).drop("__found")


def within_quota(calls: DataFrame, period: Column, order: list[Column], cap: int) -> DataFrame:
    """``calls`` with ``used`` and ``permitted``: in each period the first ``cap`` calls are."""
    w = Window.partitionBy("__period").orderBy(*order)
    out = calls.withColumn("__period", period).withColumn("used", F.row_number().over(w))
    return out.withColumn("permitted", F.col("used") <= cap).withColumn("period", F.col("__period")).drop("__period")


def replaced_groups(table: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """The table with the rows of every incoming group deleted and the incoming ones in their place."""
    return table.join(incoming.select(*group).distinct(), group, "left_anti").unionByName(incoming)


def embedded(table: DataFrame, key: str, text: str, vector: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 96, tries: int = 4, first_wait: float = 1.0) -> DataFrame:
    """``table`` with vectors where it had none: only those rows are embedded, in batches of ``batch`` texts, tried again
    after ever longer waits; the last failure stops the job. Rows with a vector are left as they are."""
    have, lack = table.where(F.col(vector).isNotNull()), table.where(F.col(vector).isNull())

    def task(batches):
        import time

        for df in batches:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch].copy()
                for n in range(tries):
                    try:
                        found = embed([t or "" for t in part[text]])
                        break
                    except Exception:
                        if n == tries - 1:
                            raise
                        time.sleep(first_wait * 2**n)
                if len(found) != len(part):
                    raise ValueError("another number of vectors than texts")
                part[vector] = [list(map(float, v)) for v in found]
                yield part

    return have.unionByName(lack.mapInPandas(task, lack.schema))
