"""A vector index: coarse cells, residual product quantisation, and exact re-ranking.

A vector of unit length is its cell's centre plus a residual, whose parts are each replaced by the nearest of 256 code words: one byte a
part. Centres and code words come from a bounded sample; every row is indexed. As a dot product is a sum over parts, a query's products with all
code words, made once, give its approximate products with all rows by look-ups. The best ``candidates`` of each query, and they alone, are
compared exactly, with the vectors themselves.

Rows are written by cell. Where vectors cluster, a query may ``probe`` its nearest cells only; without clusters (the default) all codes are
looked up, a sixteenth of the vectors' bytes.

Defined results: null vectors, and those of length zero, are in no result. Equal distances are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.search import blocks_of, dot, normed, ranked

#: Vectors that are learnt from, the cells, the parts of a vector, and rounds of k-means.
SAMPLE, CELLS, PARTS, ROUNDS = 8_000, 16, 16, 8
#: Code words of a part: a byte names one.
WORDS = 256
#: Query vectors looked up at once.
AT_ONCE = 500


class Codebook(NamedTuple):
    centres: np.ndarray  # cells x dimensions
    words: np.ndarray  # parts x WORDS x dimensions of a part


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres, or all points if there are fewer; deterministic."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def learnt(vectors: DataFrame, cells: int = CELLS, parts: int = PARTS, sample: int = SAMPLE) -> Codebook | None:
    """The codebook of ``sample`` vectors at most, the first by hash of the id; None without a vector."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], np.float64)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    if not len(x):
        return None
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions are no multiple of {parts} parts")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = k_means(x, cells)
    residual = x - centres[((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)]
    each = residual.reshape(len(x), parts, -1).transpose(1, 0, 2)
    return Codebook(centres, np.stack([np.pad(w := k_means(p, WORDS), ((0, WORDS - len(w)), (0, 0)), mode="edge") for p in each]))


def encoded(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The cells and codes of unit vectors."""
    cell = ((book.centres**2).sum(1)[None] - 2 * x @ book.centres.T).argmin(1)
    residual = (x - book.centres[cell]).reshape(len(x), len(book.words), -1)
    codes = [((w**2).sum(1)[None] - 2 * residual[:, i] @ w.T).argmin(1) for i, w in enumerate(book.words)]
    return cell, np.stack(codes, 1).astype(np.uint8)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def indexed(vectors: DataFrame, book: Codebook) -> DataFrame:
    """(id, cell, code) of every vector, to be written by cell."""
    sent = vectors.sparkSession.sparkContext.broadcast(book)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                cell, code = encoded(x / np.linalg.norm(x, axis=1, keepdims=True), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

    rows = normed(vectors).where("vector IS NOT NULL AND norm > 0").select("id", "vector")
    return rows.mapInArrow(task, f"id {dict(vectors.dtypes)['id']}, cell int, code binary")


def write(rows: DataFrame, path: str) -> None:
    rows.repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def candidates_of(index: DataFrame, queries: DataFrame, book: Codebook, candidates: int, probes: int | None = None) -> DataFrame:
    """(query_id, id): of each query the ``candidates`` rows whose codes promise most, of ``probes`` cells or all.

    Queries go to the tasks in counted blocks; each task hands on the best of a query in each of its batches.
    """
    types = dict(queries.dtypes)["query_id"], dict(index.dtypes)["id"]
    out = []
    for block in blocks_of(queries, AT_ONCE):
        rows = block.select("query_id", "vector").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        q = matrix(rows.column("vector").combine_chunks())
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        near, looked = q @ book.centres.T, index
        if probes is not None:
            near = np.where(near >= np.sort(near, 1)[:, [-min(probes, near.shape[1])]], near, -np.inf)
            looked = index.where(F.col("cell").isin([int(c) for c in np.flatnonzero(np.isfinite(near).any(0))]))
        table = np.einsum("qpd,pwd->pqw", q.reshape(len(q), len(book.words), -1), book.words).astype(np.float32)
        sent = index.sparkSession.sparkContext.broadcast((rows.column("query_id").combine_chunks(), near.astype(np.float32), table))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, near, table = sent.value
            for b in batches:
                for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    like = near[:, part.column(1).to_numpy()]
                    for p, words in enumerate(table):
                        like = like + words[:, code[:, p]]
                    n = min(candidates, part.num_rows)
                    best = np.argpartition(-like, n - 1, 1)[:, :n]
                    score = np.take_along_axis(like, best, 1).ravel()
                    keep = np.isfinite(score)
                    which = np.repeat(np.arange(len(ids)), n)[keep]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), part.column(0).take(pa.array(best.ravel()[keep])), pa.array(score[keep], pa.float32())], names=["query_id", "id", "like"])

        found = looked.select("id", "cell", "code").mapInArrow(task, f"query_id {types[0]}, id {types[1]}, like float")
        out.append(ranked(found, F.col("like").desc(), F.col("id"), cap=candidates).select("query_id", "id"))
    return reduce(DataFrame.unionByName, out) if out else index.select(F.lit(None).cast(types[0]).alias("query_id"), "id").limit(0)


def nearest(index: DataFrame, vectors: DataFrame, queries: DataFrame, book: Codebook, cap: int, candidates: int = 100, probes: int | None = None) -> DataFrame:
    """(query_id, id, dist, pos) like ``search.vector_leg``, of the candidates compared exactly. Their vectors are met by id; a query's are
    with its candidates, so that no query is sent anywhere."""
    asked = normed(queries.where("vector IS NOT NULL")).where("norm > 0")
    found = candidates_of(index, asked, book, candidates, probes)
    rows = normed(vectors).select("id", "vector", "norm")
    met = found.join(rows, "id").join(asked.select("query_id", F.col("vector").alias("__q"), F.col("norm").alias("__n")), "query_id")
    dist = F.round(1 - dot(F.col("vector"), F.col("__q")) / (F.col("norm") * F.col("__n")), 6)
    return ranked(met.select("query_id", "id", dist.alias("dist")), F.col("dist"), F.col("id"), cap=cap)
