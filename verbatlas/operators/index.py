"""A living inverted index: written by increments, merged, searched without reading texts.

Under the index's folder, ``s=<n>`` is a segment, made once and never changed: its postings by bucket of lexeme and, in ``docs``, the ids that it holds;
``gone`` has the ids that a later segment or a removal took from earlier ones. ``live`` has a row set for each version: the segments that count. A version
is one file, put there by a rename, so that a reader sees the old index or the new one. ``added`` makes a segment of new and changed documents,
``removed`` of deletions alone, ``merged`` one of all that is left, without their texts.

A posting row is a lexeme in a block of documents: their ids, weights and positions, and the highest weight. A document's block follows
from its length and the hash of its id, so long documents, whose weights are high, share blocks. A search for the first ``cap`` reads the
highest weights alone, bounds every block by them, looks into the best blocks, and then only into those whose bound is not below
the score of the last row that these give; the rows are those of a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import lexemes
from verbatlas.operators import search as s
from verbatlas.operators.stems import stem_of_word, stems_of

#: Segments beyond which an increment has them merged.
MOST_SEGMENTS = 8
#: Blocks that a search looks into first.
FIRST_BLOCKS = 24
#: Places of words in a file, the letters that a place takes up in a text, and the files of a bucket that a lexeme is spread over.
PLACES_A_FILE, LETTERS, SPREAD = 1_000_000, 6, 8
#: Words of documents that a task counts at once.
WORDS_AT_ONCE = 2_000_000


class State(NamedTuple):
    version: int
    last: int  # the highest number of a segment so far
    segments: list[int]
    id_type: str


@dataclass(frozen=True)
class Index:
    """Where an index is and how it is written. ``blocks`` is the number of blocks for each class of lengths: documents by class over 100 to 200 is
    about right; it is fixed when the index is made. ``stemmed`` keeps stems without the words that say nothing, instead of words."""

    spark: SparkSession
    path: str
    buckets: int = 16
    blocks: int = 16
    stemmed: bool = False
    title: str | None = "title"
    body: str = "text"

    def state(self) -> State:
        """What the newest version says; the first, without a segment, where nothing was written. A few numbers for each version are read."""
        try:
            rows = self.spark.read.schema("segment int, version int, id_type string").parquet(f"{self.path}/live").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            return State(0, 0, [], "")
        version = max(r["version"] for r in rows)
        return State(version, max(r["segment"] for r in rows), sorted(r["segment"] for r in rows if r["version"] == version), rows[0]["id_type"])

    def segments(self) -> list[int]:
        """The segments that count, oldest first."""
        return self.state().segments

    def publish(self, version: int, segments: list[int], kind: str) -> None:
        rows = self.spark.range(1).select(F.explode(F.lit(segments).cast("array<int>")).alias("segment"), F.lit(version).alias("version"), F.lit(kind).alias("id_type"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/live")

    def read(self, what: str, segments: list[int], schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/s={x}/{what}").withColumn("segment", F.lit(x)) for x in segments]
        return reduce(DataFrame.unionByName, parts)

    def gone(self, segments: list[int], id_type: str) -> DataFrame:
        """(id, before): the id counts no longer in segments below ``before``."""
        return self.read("gone", segments, f"id {id_type}").select("id", F.col("segment").alias("before"))


def postings_of(index: Index, docs: DataFrame, packed: bool = False) -> DataFrame:
    """(lexeme, block, top, postings): of each document's lexemes how often they are in the title and the body, and where, titles first. Documents are
    counted where they are read, some together: their places are sorted by word and block in their task, so that nothing is shuffled. ``packed``, as they are shuffled."""
    some = lambda c: lexemes(F.coalesce(F.col(c), F.lit("")) if c else F.lit(""))  # noqa: E731  null is empty
    words = docs.select("id", some(index.title).alias("t"), some(index.body).alias("b"))
    words = words.select("id", F.size("t").alias("n"), F.concat("t", "b").alias("w")).withColumn("block", block_of(index, F.size("w")))
    kind = dict(docs.dtypes)["id"]
    return words.mapInArrow(partial(counted, stemmed=index.stemmed, packed=packed), packed_schema(kind) if packed else rows_schema(kind))


def block_of(index: Index, size: Column) -> Column:
    return F.floor(F.log2(size + 1)).cast("long") * 65536 + F.pmod(F.xxhash64("id"), F.lit(index.blocks))


def counted(batches: Iterator[pa.RecordBatch], stemmed: bool, packed: bool) -> Iterator[pa.RecordBatch]:
    """Documents (id, n, w, block), the first n of whose words are the title's, as posting rows, by words or by the stems of the words that say something."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            # documents with so many words that a step's arrays stay small, one at least
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WORDS_AT_ONCE, "right")), i + 1)
            rows = of_documents(batch.slice(i, j - i), stemmed)
            yield pack(rows) if packed else rows
            i = j


def of_documents(batch: pa.RecordBatch, stemmed: bool) -> pa.RecordBatch:
    size = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    coded = batch.column("w").flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if stemmed:  # a word is stemmed once, however many documents have it
        own = pa.array([None if w in s.STOP else stem_of_word(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
        words, code = own.dictionary, own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        has = code >= 0
        code, doc, at = code[has], doc[has], at[has]
    blocks, own = np.unique(batch.column("block").to_numpy(zero_copy_only=False), return_inverse=True)
    row = code * max(len(blocks), 1) + own[doc]
    order = np.sort(row * len(row) + np.arange(len(row))) % max(len(row), 1)  # by rows, then as they stand: by documents and places
    row, at, doc = row[order], at[order].astype(np.int32), doc[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))  # where a document's places of a word begin
    ends = np.append(first, len(row)).astype(np.int32)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    t = np.add.reduceat((at < n[doc]).astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
    b = np.diff(ends) - t
    doc, row = doc[first], row[first]
    start = np.flatnonzero(np.diff(row, prepend=-1))  # where a word's documents of a block begin
    top = np.maximum.reduceat(s.TITLE * t + s.BODY * b, start) if len(start) else np.zeros(0)
    row = row[start]
    each = [
        batch.column("id").take(pa.array(doc)), pa.array(size[doc], pa.int32()), pa.array(t, pa.int32()), pa.array(b, pa.int32()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(at, pa.int32())),
    ]
    postings = pa.StructArray.from_arrays(each, names=["id", "size", "t", "b", "at"])
    columns = [
        words.take(pa.array(row // max(len(blocks), 1))), pa.array(blocks[row % max(len(blocks), 1)], pa.int64()), pa.array(top, pa.float64()),
        pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), postings),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "block", "top", "postings"])


def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Posting rows with their numbers as bytes, three of each posting and its places, as many rows of nested values take long to shuffle. Their highest
    weight follows from these and isn't shuffled."""
    lists = rows.column("postings")
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    postings = lists.flatten()
    size, t, b, at = (postings.field(c) for c in ("size", "t", "b", "at"))
    counts = np.column_stack([c.to_numpy(zero_copy_only=False) for c in (size, t, b)]).astype(np.int32)
    places = np.append(0, np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False)))[ends]
    columns = [
        rows.column("lexeme"), rows.column("block"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings.field("id")),
        as_bytes(counts, 12 * ends), as_bytes(at.flatten().to_numpy(zero_copy_only=False).astype(np.int32), 4 * places),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "block", "ids", "counts", "places"])


def as_bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def numbers_of(column: pa.Array) -> np.ndarray:
    """The numbers of all rows, one after another."""
    _, ends, data = column.buffers()
    first, last = np.frombuffer(ends, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.int32, (last - first) // 4, first) if last > first else np.zeros(0, np.int32)


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows packed, neighbours of one lexeme and block as one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = starts_of(batch)
        lists = batch.column("postings")
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends[start], ends[-1]), pa.int32()), lists.flatten())
        lexeme, block = (batch.column(c).take(pa.array(start)) for c in ("lexeme", "block"))
        yield pack(pa.RecordBatch.from_arrays([lexeme, block, lists], names=["lexeme", "block", "postings"]))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows that are sorted by lexeme and block, as posting rows, one of each lexeme and block. One is held back until another comes, which may be
    batches later."""
    held: list[pa.RecordBatch] = []  # rows of one lexeme and block
    for batch in batches:
        if not batch.num_rows:
            continue
        start = starts_of(batch)
        if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("lexeme", "block")):
            yield one_a_row(held)
            held = []
        if len(start) > 1:
            yield one_a_row([*held, batch.slice(0, start[-1])])
            held = []
        held.append(batch.slice(start[-1]))
    if held:
        yield one_a_row(held)


def starts_of(batch: pa.RecordBatch) -> np.ndarray:
    """Where the rows of a lexeme and block begin."""
    new = [pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False) for c in ("lexeme", "block")]
    return np.flatnonzero(np.append(True, new[0] | new[1]))


def one_a_row(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Packed rows as posting rows, those of a lexeme and block as one: what they hold stands side by side already."""
    batch = batches[0] if len(batches) == 1 else pa.concat_batches(batches)
    start = starts_of(batch)
    ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)))
    size, t, b = np.ascontiguousarray(numbers_of(batch.column("counts")).reshape(-1, 3).T)
    at = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(t + b)), pa.int32()), pa.array(numbers_of(batch.column("places"))))
    postings = pa.StructArray.from_arrays([batch.column("ids").flatten(), pa.array(size), pa.array(t), pa.array(b), at], names=["id", "size", "t", "b", "at"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(ends[start], ends[-1]), pa.int32()), postings)
    top = np.maximum.reduceat(s.TITLE * t + s.BODY * b, ends[start])
    lexeme, block, bucket = (batch.column(c).take(pa.array(start)) for c in ("lexeme", "block", "bucket"))
    return pa.RecordBatch.from_arrays([lexeme, block, pa.array(top), lists, bucket], names=["lexeme", "block", "top", "postings", "bucket"])


def rows_schema(kind: str) -> str:
    return f"lexeme string, block long, top double, postings array<struct<id:{kind},size:int,t:int,b:int,at:array<int>>>"


def packed_schema(kind: str) -> str:
    return f"lexeme string, block long, ids array<{kind}>, counts binary, places binary"


def write(index: Index, number: int, each: DataFrame, docs: DataFrame, gone: DataFrame, places: int = 0) -> None:
    """A segment of ``each`` (as from ``postings_of``, packed), the ids ``docs`` and those ``gone``. Of about so many ``places`` a bucket gets a file for every
    PLACES_A_FILE, so that no task's share grows with the documents; a lexeme is in SPREAD of a bucket's files at most."""
    at = f"{index.path}/s={number}"
    files = max(1, -(-places // (index.buckets * PLACES_A_FILE)))
    bucket = (F.crc32(F.col("lexeme").cast("binary")) % index.buckets).cast("int")
    file = bucket * files + F.pmod(F.xxhash64("lexeme", F.col("block") % SPREAD), F.lit(files)).cast("int")
    # a file is a partition by its number: dealt by a hash of it, some tasks get several files and some none; the bucket is known after the sort
    rows = each.repartitionById(index.buckets * files, file).sortWithinPartitions("lexeme", "block").withColumn("bucket", bucket)
    kind = dict(docs.dtypes)["id"]
    with as_they_come(index.spark):
        rows.mapInArrow(together, schema_of(kind)).write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{at}/postings")
    docs.select("id").write.mode("overwrite").parquet(f"{at}/docs")
    gone.select("id").write.mode("overwrite").parquet(f"{at}/gone")


@contextmanager
def as_they_come(spark: SparkSession) -> Iterator[None]:
    """Within, a write by folders of a column doesn't sort rows by that column first, which would hold a task's rows once more. A task that meets another
    folder sorts what is left, as tasks do without this, so it only saves where a task's rows are of one folder."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    with setting(spark, key, str(max(int(spark.conf.get(key)), 2))):  # a task sorts once it opens as many files
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def live_docs(index: Index) -> DataFrame:
    """(id, segment) of the documents that count."""
    _, _, segments, kind = index.state()
    return without_gone(index, index.read("docs", segments, f"id {kind}"), segments, kind)


def without_gone(index: Index, rows: DataFrame, segments: list[int], kind: str) -> DataFrame:
    if len(segments) < 2:
        return rows
    gone = index.gone(segments[1:], kind).groupBy("id").agg(F.max("before").alias("before"))
    return rows.join(gone.withColumnRenamed("id", "__id"), (F.col("id") == F.col("__id")) & (F.col("segment") < F.col("before")), "left_anti")


def added(index: Index, docs: DataFrame, most: int = MOST_SEGMENTS) -> None:
    """Takes in documents (id, title, text) with one row for each id; those whose id the index has replace them."""
    version, number, segments, _ = index.state()
    texts = reduce(lambda x, y: x + y, [F.coalesce(F.length(c), F.lit(0)) for c in (index.title, index.body) if c])
    places = (docs.agg(F.sum(texts)).first()[0] or 0) // LETTERS
    ids = docs.select("id")
    gone = live_docs(index).select("id").join(ids, "id", "left_semi") if segments else ids.limit(0)
    write(index, number + 1, postings_of(index, docs, packed=True), ids, gone, places)
    index.publish(version + 1, [*segments, number + 1], dict(docs.dtypes)["id"])
    if len(segments) + 1 > most:
        merged(index)


def removed(index: Index, ids: DataFrame) -> None:
    """Takes out the documents with these ids."""
    version, number, segments, kind = index.state()
    none = index.spark.createDataFrame([], packed_schema(kind))
    write(index, number + 1, none, index.spark.createDataFrame([], f"id {kind}"), ids.select(F.col("id").cast(kind)).distinct())
    index.publish(version + 1, [*segments, number + 1], kind)


def merged(index: Index) -> None:
    """One segment of all that counts; the older ones stay for those who read them."""
    version, number, segments, kind = index.state()
    if len(segments) < 2:
        return
    rows = occurrences(index, segments, kind)
    left = without_gone(index, rows, segments, kind)
    each = left.select("lexeme", block_of(index, F.col("size")).alias("block"), F.array(F.struct("id", "size", "t", "b", "at")).alias("postings")).mapInArrow(packed_rows, packed_schema(kind))
    places = rows.agg(F.sum(F.col("t") + F.col("b"))).first()[0] or 0
    # ids that have gone, if too many to be broadcast, are hashed by partition: a sort would hold all postings, which are many times as many
    with setting(index.spark, "spark.sql.join.preferSortMergeJoin", "false"):
        write(index, number + 1, each, live_docs(index), live_docs(index).limit(0), places)
    index.publish(version + 1, [number + 1], kind)


def schema_of(kind: str) -> str:
    return f"{rows_schema(kind)}, bucket int"


def rows_of(index: Index, segments: list[int], kind: str, words: list[str] | None = None) -> DataFrame:
    """Posting rows of the given lexemes: their buckets alone are listed, and of their files the row groups that may hold them."""
    rows = index.read("postings", segments, schema_of(kind))
    if words is None:
        return rows
    mine = sorted({crc32(w.encode()) % index.buckets for w in words})
    return rows.where(F.col("bucket").isin(mine) & F.col("lexeme").isin(words))


def counts(index: Index, segments: list[int], kind: str) -> DataFrame:
    """(lexeme, t, b) of every lexeme and document. Where nothing has gone, ids and places aren't read."""
    if len(segments) > 1:
        return without_gone(index, occurrences(index, segments, kind), segments, kind).select("lexeme", "t", "b")
    rows = index.read("postings", segments, "lexeme string, postings array<struct<t:int,b:int>>")
    return rows.select("lexeme", F.inline("postings"))


def occurrences(index: Index, segments: list[int], kind: str, words: list[str] | None = None, blocks: DataFrame | list[int] | None = None) -> DataFrame:
    """(lexeme, block, segment, id, size, t, b, at)."""
    rows = rows_of(index, segments, kind, words)
    if isinstance(blocks, list):
        rows = rows.where(F.col("block").isin(blocks))
    elif blocks is not None:
        rows = rows.join(blocks.select("block"), "block", "left_semi")
    return rows.select("lexeme", "block", "segment", F.explode("postings").alias("p")).select("lexeme", "block", "segment", "p.*")


def lexical(index: Index, query: str, query_id: int = 1, cap: int | None = s.CAP, only: DataFrame | None = None, density: bool = False) -> DataFrame:
    """(query_id, id, lex, pos) as ``search.lexical_leg`` gives it of the same documents, from the index; ``only`` narrows it to its ids before it
    is ranked. With ``density`` also (..., density, ...): ranked by cover density first."""
    parsed = s.parse_query(query)
    if index.stemmed:
        own = lambda words: stems_of(index.spark, words, s.STOP)
        parsed = {k: own(v) for k, v in parsed.items() if k in ("must", "not")} | {k: [x for x in map(own, parsed[k]) if x] for k in ("phrases", "any")}
    _, _, segments, kind = index.state()
    if not segments:
        raise ValueError(f"no index at {index.path}")
    wanted = list(dict.fromkeys([*parsed["must"], *(w for g in parsed["any"] for w in g)]))
    if not wanted:
        return without_words(index, parsed, segments, kind, query_id, cap, only)
    if cap is None or only is not None or density:
        return s.ranked(scored(index, parsed, segments, kind, None, only, density).withColumn("query_id", F.lit(query_id)), *order(density), cap=cap).select("query_id", "id", *(["density"] if density else []), "lex", "pos")
    bounds = bounded(index, parsed, segments, kind, wanted)
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    found = scored(index, parsed, segments, kind, first, None, False)
    if len(first) == FIRST_BLOCKS:  # there may be more
        n, least = found.orderBy(F.desc("lex")).limit(cap).agg(F.count("*"), F.min("lex")).first()
        found = scored(index, parsed, segments, kind, bounds.where(F.round("bound", 6) >= (least if n >= cap else 0.0)), None, False)
    return s.ranked(found.withColumn("query_id", F.lit(query_id)), *order(False), cap=cap).select("query_id", "id", "lex", "pos")


def order(density: bool) -> list[Column]:
    return [*([F.col("density").desc()] if density else []), F.col("lex").desc(), F.col("id")]


def bounded(index: Index, parsed: dict, segments: list[int], kind: str, wanted: list[str]) -> DataFrame:
    """(block, bound): blocks that may hold hits, and what a hit in them weighs at most. Reads lexemes, blocks and highest weights alone."""
    tops = rows_of(index, segments, kind, wanted).groupBy("block", "lexeme").agg(F.max("top").alias("top"))
    has = lambda words: F.count_if(F.col("lexeme").isin(words))
    tests = [(has(parsed["must"]) == len(set(parsed["must"]))).alias("__must"), *[(has(g) > 0).alias(f"__any{i}") for i, g in enumerate(parsed["any"])]]
    names = ["__must", *[f"__any{i}" for i in range(len(parsed["any"]))]]
    return tops.groupBy("block").agg(F.sum("top").alias("bound"), *tests).where(reduce(lambda a, b: a & b, map(F.col, names))).select("block", "bound")


def scored(index: Index, parsed: dict, segments: list[int], kind: str, blocks: DataFrame | list[int] | None, only: DataFrame | None, density: bool) -> DataFrame:
    """(id, lex) of the hits in ``blocks`` (all), as a scan scores them."""
    must, some = parsed["must"], [w for g in parsed["any"] for w in g]
    wanted = list(dict.fromkeys([*must, *some]))
    phrased = list(dict.fromkeys(w for p in parsed["phrases"] for w in p))
    each = occurrences(index, segments, kind, list(dict.fromkeys([*wanted, *parsed["not"], *phrased])), blocks)
    if only is not None:
        each = each.join(only.select("id"), "id", "left_semi")
    each = without_gone(index, each, segments, kind)
    has = lambda words: F.count_if(F.col("lexeme").isin(words))
    tests = [(has(must) == len(must))] if must else []
    tests += [has(g) > 0 for g in parsed["any"]] + ([has(parsed["not"]) == 0] if parsed["not"] else [])
    own = F.col("lexeme").isin(wanted)
    t, b = (F.sum(F.when(own, F.col(c)).otherwise(0)) for c in ("t", "b"))
    lists = phrased if not density else list(dict.fromkeys([*phrased, *must]))
    places = [F.flatten(F.collect_list(F.when(F.col("lexeme") == w, F.col("at")))).alias(f"__at{i}") for i, w in enumerate(lists)]
    out = each.groupBy("id").agg(F.round(s.TITLE * t + s.BODY * b, 6).alias("lex"), reduce(lambda x, y: x & y, tests).alias("__hit"), *places).where("__hit")

    def at(word: str) -> Column:
        return F.col(f"__at{lists.index(word)}")

    def begins(phrase: list[str]) -> Callable[[Column], Column]:
        return lambda place: reduce(lambda a, c: a & c, [F.array_contains(at(w), place + i) for i, w in enumerate(phrase)])

    for p in parsed["phrases"]:
        out = out.where(F.exists(at(p[0]), begins(p)))
    if density:
        out = out.withColumn("density", F.round(s.cover_density(F.array(*map(at, must))), 6) if must else F.lit(0.0))
    return out.select("id", "lex", *(["density"] if density else []))


def without_words(index: Index, parsed: dict, segments: list[int], kind: str, query_id: int, cap: int | None, only: DataFrame | None) -> DataFrame:
    """Hits of a query that only says what is not wanted; none if it says nothing."""
    ids = live_docs(index).select("id")
    if only is not None:
        ids = ids.join(only.select("id"), "id", "left_semi")
    if parsed["not"]:
        with_word = without_gone(index, occurrences(index, segments, kind, parsed["not"]), segments, kind).select("id")
        ids = ids.join(with_word, "id", "left_anti")
    else:
        ids = ids.limit(0)
    out = s.ranked(ids.select(F.lit(query_id).alias("query_id"), "id", F.lit(0.0).alias("lex")), F.col("id"), cap=cap)
    return out.select("query_id", "id", "lex", "pos")
