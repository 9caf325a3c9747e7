"""Integrity: named rules over rows, keys, references in arrays and markers, as violations to read or raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A marker of a citation in a template.
MARKER = r"\{\{cite:([a-z0-9_-]+)\}\}"


def broken_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of rows that break a rule; a rule that is unknown (null) holds. One pass."""
    found = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(children: DataFrame, parents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Children whose reference (all columns set) has no parent."""
    on = reduce(lambda a, b: a & b, [children[c] == parents[p] for c, p in columns.items()])
    set_all = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return children.where(set_all).join(parents, on, "left_anti")


def dangling_items(df: DataFrame, key: str, items: Column, targets: DataFrame, target: str) -> DataFrame:
    """(key, item) of array elements that name nothing."""
    each = df.select(key, F.explode(items).alias("item")).distinct()
    return each.join(targets.select(F.col(target).cast("string").alias("item")), "item", "left_anti").select(key, "item")


def markers(template: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(MARKER), F.lit(1)))


def raise_if_any(df: DataFrame, what: str, shown: int = 20) -> None:
    """Stops with the first rows of a frame of violations, if it has any."""
    rows = df.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def complete_only(files: DataFrame, complete: str = "completo", items: str = "decretos") -> DataFrame:
    """Yearly files that say they are complete and aren't empty."""
    return files.where(F.col(complete).eqNullSafe(F.lit(True)) & (F.size(items) > 0))


def health(counts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row with a count for each name: of all rows, or of those that a condition holds for."""
    parts = [d.agg((F.count("*") if c is None else F.count_if(c)).alias(n)) for n, (d, c) in counts.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)
