"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Defined results: a null or empty text has no word and the fingerprint zero, and links like any
other. Rows with equal texts share a fingerprint, so ties and repeated rows fall in one
component. A null ``doc_id`` is never a component's name unless the component has no other; an
empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

#: Hash seed of a shingle.
SEED = 42

#: Blocks of 16 bits; two fingerprints with at most two differing bits agree in two of the four.
BLOCKS = [(a, b) for a in range(4) for b in range(a + 1, 4)]

#: A block key with more fingerprints than this is linked through midpoints, without pairs.
MOST_IN_BLOCK = 64


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules for both
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    flat = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)][k - 1 :]
    counts, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        some = [flat[i:j] for i, j in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)]
        raw = b"".join(map(xxhash.xxh64_digest, some, repeat(SEED)))
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp`` long, the fingerprint's bits as a signed number."""

    def make():
        def work(texts: list) -> list[list]:
            return [[x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, words_in_shingle) for t in texts)]]

        return work

    return map_texts(docs, "text", {"fp": pa.int64()}, "fp long", make)


def links(fps: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """Edges (a, b), a < b, that connect exactly the fingerprints within two differing bits.

    ``fps``: distinct fingerprints in ``fp``. Fingerprints sharing a block key are paired and
    verified where the key has at most ``most`` of them. Those of larger keys are linked without
    pairs: each is sent to itself and its 64 neighbours at one bit, and all that meet at such a
    midpoint are within two bits of each other, so each links to the smallest there. Two
    fingerprints within two bits always meet at a midpoint, so no link is lost.
    """
    keys = F.array(*[
        F.struct(
            F.lit(i).cast("byte").alias("no"),
            ((F.shiftrightunsigned("fp", 16 * a).bitwiseAND(0xFFFF)) * 65536 + F.shiftrightunsigned("fp", 16 * b).bitwiseAND(0xFFFF)).alias("key"),
        )
        for i, (a, b) in enumerate(BLOCKS)
    ])
    blocks = fps.select("fp", F.explode(keys).alias("k")).select("k.no", "k.key", "fp")
    # written, so that the join below has a plain exchange on each side and a hot key can be split
    shared = cut(blocks.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(blocks.join(shared, ["no", "key"]))
    few = members.where(F.col("n") <= most).select("no", "key", "fp")
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    near = a.join(b, ["no", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    hot = members.where(F.col("n") > most).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    met = hot.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    least = met.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = met.join(least, "mid").where("a < fp").select("a", F.col("fp").alias("b"))
    return near.select("a", "b").unionByName(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, root the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregation and a join of the edges, and
    checkpoints every round, until the edges stand still. Nothing is collected but two numbers.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: link every larger neighbour of u to the least of u's neighbourhood; small: every smaller one and u
        from_u = e.select(F.col("a").alias("u"), F.col("b").alias("v")), e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = from_u[0].unionByName(from_u[1]) if large else from_u[1]
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # as above
        met = both.join(least, "u")
        out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(met.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    e = cut(edges)
    now = state(e)
    while True:
        e = cut(star(star(e, True), False))
        was, now = now, state(e)
        if was == now:
            break
    roots = e.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every row; th is a hash of the text, 0 if null.

    Equal fingerprints are one class; links and components are found between classes only, and a
    class with a third of all rows is pre-aggregated to one row.
    """
    seen = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    rows = cut(fingerprints(seen, words_in_shingle).select("doc_id", "th", "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select("fp")))
    rooted = cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # written, so that the join has a plain exchange on each side and a giant component can be split
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = cut(rooted.join(named, "root").select("fp", "root", "component_id"))
    return rows.join(of_class, "fp").select("doc_id", "th", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest ``doc_id``, once.

    Of rows that repeat this id in one component, the row with the smallest text hash stays; a
    component without any id keeps such a row too.
    """
    rows = near_duplicates(docs, words_in_shingle)
    chosen = cut(
        rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "doc_id")
        .agg(F.min("th").alias("th"), F.count("*").alias("n"))
        .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), (F.col("n") > 1).alias("__more"))
    )
    th = F.coalesce(F.xxhash64("text"), F.lit(0))
    kept = docs.withColumn("__h", th).join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")))
    kept = kept.select(*docs.columns, "__more")
    if chosen.where("__more").isEmpty():
        return kept.drop("__more")
    again = kept.where("__more").dropDuplicates(["doc_id", "text"])
    return kept.where("NOT __more").unionByName(again).drop("__more")
