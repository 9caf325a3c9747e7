"""The collector path as Structured Streaming: idempotent increments, rates and windows on events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.lineage import cut
from verbatlas.functions.text import ACCENTED, MARKS, PLAIN
from verbatlas.operators.merge import last_of_key


def stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def unique(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, by its id; the state holds ids no longer than the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling or sliding counts and sums, final once the watermark has passed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def version(path: str, n: int) -> str:
    """The folder that batch ``n`` writes: one of two, in turn."""
    return f"{path}/v{n % 2}"


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into a Parquet table of two folders under ``path``.

    Batch n reads what batch n - 1 wrote and overwrites the other folder, so a batch that is run again does the
    same: exactly one effect. Of a key's rows, stored or new, the latest by ``order`` stays; a late row
    replaces no newer one, and of equals the batch's does. ``newest`` reads the table.
    """

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("__new", F.lit(1))
        if n:
            before = batch.sparkSession.read.parquet(version(path, n - 1)).drop("__batch")
            rows = rows.unionByName(before.withColumn("__new", F.lit(0)))
        rows = last_of_key(rows, keys, F.col(order).desc_nulls_last(), F.col("__new").desc()).drop("__new")
        rows.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(version(path, n))

    return merge


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table as its latest batch left it."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/v*")
    last = rows.agg(F.max("__batch")).first()[0]
    return spark.read.parquet(version(path, last or 0)).drop("__batch")


def manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket of a table last, as the newest batch (below a number) says."""
    try:
        rows = spark.read.schema("bucket int, batch int, n int").parquet(f"{path}/manifest")
        last = (rows if below is None else rows.where(F.col("n") < below)).agg(F.max("n")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["bucket"]: r["batch"] for r in rows.where(F.col("n") == last).collect()} if last is not None else {}


def in_buckets(spark: SparkSession, path: str, written: dict[int, int]) -> DataFrame:
    """The rows of the buckets, each as the batch named wrote it."""
    return spark.read.parquet(*[f"{path}/data/n={n}/bucket={b}" for b, n in sorted(written.items())])


def upsert_buckets(path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into a Parquet table of ``buckets`` by hash of the key, and writes anew only those that the
    batch has rows of.

    A batch's buckets go to a folder of its own, then its manifest says which batch wrote each bucket last: a reader sees the table as
    before, or all of the batch. A batch that is run again begins from the manifest before it and writes the same. Of a key's rows the latest by
    ``order`` stays, of equals the batch's. Older folders stay for those who read them.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` at most
        before = manifest(spark, path, below=n)
        if not touched:
            return
        rows = rows.withColumn("__new", F.lit(1))
        if old := {b: before[b] for b in touched if b in before}:
            stored = in_buckets(spark, path, old)
            rows = rows.unionByName(stored.withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), "__new": F.lit(0)}))
        rows = last_of_key(rows, keys, F.col(order).desc_nulls_last(), F.col("__new").desc()).drop("__new")
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/n={n}")
        now = before | dict.fromkeys(touched, n)
        lines = spark.range(1).select(F.explode(F.map_from_arrays(F.lit([*now]), F.lit([*now.values()]))).alias("bucket", "batch"))
        lines.selectExpr("CAST(bucket AS INT) bucket", "CAST(batch AS INT) batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n={n}")

    return merge


def bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_buckets`` keeps, as its newest batch left it."""
    return in_buckets(spark, path, manifest(spark, path))


def in_time(left: DataFrame, right: DataFrame, on: str, at: str = "ts", other_at: str = "other_ts", within: str = "7 days", late: str = "1 day", how: str = "leftOuter") -> DataFrame:
    """The rows of one stream with those of another that have the same ``on`` and come up to ``within`` after them, such as acts and their
    details. Watermarks bound the state; with leftOuter a row without a partner comes out once no partner can come any more."""
    a = left.withWatermark(at, late)
    b = right.withColumnRenamed(on, "__on").withWatermark(other_at, late)
    when = (F.col(other_at) >= F.col(at)) & (F.col(other_at) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(on) == F.col("__on")) & when, how).drop("__on")


def run_once(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that has landed, in micro-batches, then stop: the shape of a daily job."""
    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def recent(events: DataFrame, now: Column, back: str = "7 days", at: str = "ts", cut_at: Column | None = None) -> DataFrame:
    """Rows no older than the look-back of a run at ``now``, nor than the cut: what a daily job reads again, to catch what landed late. What is
    before the cut date is in the collection already."""
    since = now - F.expr(f"INTERVAL {back}")
    return events.where(F.col(at) >= (since if cut_at is None else F.greatest(since, cut_at)))


def refusals(events: DataFrame, key: str = "user_id", at: str = "ts", most: int = 3, seconds: int = 3600, late: str | None = "1 hour") -> DataFrame:
    """(key, at, in_window, refused) of a stream: attempts beyond ``most`` in the time up to each one.

    The state of a key is its attempts of the last ``seconds``, no more. Rows of a micro-batch are taken by time; a key
    that is quiet for that long is forgotten. ``late`` is None where the stream has a watermark already.
    """
    import pandas as pd

    width = pd.Timedelta(seconds=seconds)

    def step(k, frames, state):
        past = [pd.Timestamp(x, unit="us") for x in state.get[0]] if state.exists else []
        new = pd.concat(list(frames)) if not state.hasTimedOut else None
        if new is None:
            state.remove()
            return
        out = []
        for t in sorted(new[at]):
            past = [p for p in past if p > t - width] + [t]
            out.append((k[0], t, len(past), len(past) > most))
        state.update(([int(p.value // 1000) for p in past],))
        state.setTimeoutTimestamp(max(int(past[-1].value // 1_000_000) + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, "in_window", "refused"])

    kind, rows = dict(events.dtypes)[key], events.select(key, at)
    rows = rows.withWatermark(at, late) if late else rows
    return (
        rows.groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, in_window long, refused boolean", "past array<long>", "append", "EventTimeTimeout")
    )


def register(spark: SparkSession) -> None:
    """The normal forms as SQL functions of the session: norm, norm_arr, arr_join."""
    marks = "".join(f"\\u{ord(c):04x}" for c in ACCENTED + MARKS)
    body = f"translate(lower(x), '{marks}', '{PLAIN}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm(x STRING) RETURNS STRING RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_arr(xs ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN transform(xs, x -> {body})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION arr_join(xs ARRAY<STRING>, sep STRING) RETURNS STRING RETURN coalesce(array_join(xs, sep), '')")
