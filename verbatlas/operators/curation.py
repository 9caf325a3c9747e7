"""Curated corrections of a corpus, each tied to the text that it was made for.

Every function returns the corrected blocks and the log of what changed: (id, rule, before, after, reason). A correction
whose text is no longer there stops the job, as does one for a block that doesn't exist: better no
corpus than one corrected at the wrong place. Curated tables are written by people, so they are small; they are
joined by id all the same, and Spark broadcasts them by their size.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.operators.integrity import raise_if_any

#: What an editor's note looks like that nobody has curated.
LEFT_OVER = r"\bNE\s*:"


def curated(spark: SparkSession, path: str, schema: str, at: str | None = None, least: int = 1) -> DataFrame:
    """Rows of a curation file (YAML, or JSON), below the key ``at`` if given, read by the driver.

    A file that is missing, that holds no list, fewer than ``least`` rows, or a key that the schema lacks stops the job.
    """
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        import yaml

        data = yaml.safe_load(raw)
    rows = data.get(at) if at and isinstance(data, dict) else data
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"{path} has no list of at least {least} rows{f' below {at}' if at else ''}")
    out = spark.createDataFrame([], schema)
    unknown = {k for r in rows for k in r} - set(out.columns)
    if unknown:
        raise ValueError(f"{path} has keys that nobody reads: {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(c) for c in out.columns) for r in rows], out.schema)


def stop_unless(ok: Column, message: Column, value: Column) -> Column:
    """``value``, if ``ok``; else the job stops with the message."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message))


def all_used(corrections: DataFrame, blocks: DataFrame, key: str = "id") -> None:
    raise_if_any(corrections.select(key).join(blocks.select(key), key, "left_anti"), "corrections of blocks that are not there")


def log(blocks: DataFrame, rule: str, before: str, after: str, reason: Column) -> DataFrame:
    return blocks.where(~F.col(before).eqNullSafe(F.col(after))).select("id", F.lit(rule).alias("rule"), F.col(before).alias("before"), F.col(after).alias("after"), reason.alias("reason"))


def without_notes(blocks: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` (id, text) without the notes (id, remove) that editors left in them, and the log.

    The note must be in the text; a mark of a note that is left afterwards stops the job too.
    """
    all_used(notes, blocks)
    met = blocks.join(notes.select("id", "remove"), "id", "left")
    cut = F.trim(F.regexp_replace(F.replace("text", F.col("remove"), F.lit("")), r"\s{2,}", " "))
    gone = stop_unless(F.contains("text", F.col("remove")), F.concat(F.lit("the note isn't in the text of "), F.col("id")), cut)
    new = F.when(F.col("remove").isNull(), F.col("text")).otherwise(gone)
    out = met.withColumn("__new", new)
    out = out.withColumn("__new", stop_unless(~F.coalesce(F.col("__new").rlike(LEFT_OVER), F.lit(False)), F.concat(F.lit("a note is left in "), F.col("id")), F.col("__new")))
    return out.withColumn("text", F.col("__new")).select(*blocks.columns), log(out, "note", "text", "__new", F.lit("editor's note"))


def merged_back(blocks: DataFrame, fixes: DataFrame, group: str = "article", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Blocks (id, article, pos, text) that are none: each goes to the end of the block before it.

    ``fixes`` (id, begins, reason): the text must begin so. One group is one article, a page or so of text.
    """
    all_used(fixes, blocks)
    met = blocks.join(fixes.select("id", "begins", "reason"), "id", "left")
    false = F.col("begins").isNotNull()
    text = F.when(false, stop_unless(F.startswith(F.ltrim("text"), F.col("begins")), F.concat(F.lit("another text begins "), F.col("id")), F.trim("text"))).otherwise(F.col("text"))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__text", text).withColumn("__run", F.sum((~false).cast("int")).over(w))
    own = Window.partitionBy(group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.array_join(F.collect_list("__text").over(own), " ")
    reason = F.array_join(F.collect_list("reason").over(own), "; ")
    met = met.withColumns({"__whole": whole, "__reason": reason}).where(~false)
    return met.withColumn("text", F.col("__whole")).select(*blocks.columns), log(met, "merge", "__text", "__whole", F.col("__reason"))


def replaced(blocks: DataFrame, rewordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` with new wordings (id, was, becomes, norms), each for exactly the text that was checked."""
    all_used(rewordings, blocks)
    met = blocks.join(rewordings.select("id", "was", "becomes", "norms"), "id", "left")
    new = stop_unless(F.col("text").eqNullSafe(F.col("was")), F.concat(F.lit("another text than was checked: "), F.col("id")), F.col("becomes"))
    met = met.withColumn("__new", F.when(F.col("becomes").isNull(), F.col("text")).otherwise(new))
    return met.withColumn("text", F.col("__new")).select(*blocks.columns), log(met, "rewording", "text", "__new", F.concat(F.lit("worded by "), F.array_join("norms", ", ")))
