"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A dimension table is broadcast up to this many rows, which are counted first.
BROADCAST_ROWS = 50_000

#: Beyond that, the rows of a key are dealt over this many salts.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that the session names.

    Only where no folder is named is one set: a temporary folder in a single local JVM, the
    shared warehouse on a cluster.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and re.match(r"local(\[|$)", sc.master):
            where = tempfile.mkdtemp(prefix="verbatlas-")
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()


def join_dimension(
    df: DataFrame, dim: DataFrame, keys: list[str], rows: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join of ``df`` with ``dim``, which has one row for each value of ``keys`` (null equals null).

    ``dim`` is broadcast if its counted rows are within ``limit``. Otherwise both sides are
    shuffled by the keys and a salt, so that a key with a third of all rows meets in many tasks.
    """
    small = (dim.count() if rows is None else rows) <= limit
    right = dim.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if small:
        right = F.broadcast(right)
    else:
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        right = right.withColumn("__to_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append(F.col("__salt") == F.col("__to_salt"))
    out = df
    out = out.join(right, on, "left")
    return out.drop("__salt", "__to_salt", *[f"__k_{k}" for k in keys])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes``; a longer text is a part of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def map_texts(
    df: DataFrame, column: str, fields: dict[str, pa.DataType], ddl: str, make: Callable[[], Callable]
) -> DataFrame:
    """``df`` with columns computed from one text column in Arrow batches, inside the scan's tasks.

    ``make`` runs once in a task and returns a function from a list of texts (None for null) to
    the lists of the new columns' values, in the order of ``fields``. ``ddl`` has their Spark
    types. Columns of ``df`` with the new names are replaced; no row moves.
    """
    keep = [c for c in df.columns if c not in fields]
    df = df.select(*keep)
    types = [f"`{c}` {t}" for c, t in df.dtypes]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                new = work(part.column(part.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, t) for v, t in zip(new, fields.values(), strict=True)]],
                    names=[*keep, *fields],
                )

    return df.mapInArrow(task, ", ".join([*types, ddl]))


def hex_of(key: Column) -> Column:
    """The first 12 hexadecimal digits of a key's MD5 as a number below 2**48."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
