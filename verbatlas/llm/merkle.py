"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows are hashed in the scan's tasks, and only their hashes go on. These are sorted by ranges of group and key, so that a partition has a
stretch of the one order of all rows; a group may reach over any number of partitions. What the driver learns is one row for each
partition: the rows of its first and last group, and its number of groups. From these counts follow the offset of the
first group's rows and the number of rows that the last group still has elsewhere. So every task knows the coordinates (tree,
level, index) of its nodes and builds by itself all subtrees that lie whole in its partition. The ragged nodes that are left,
two on each level at most, are shuffled by the coordinate of an ancestor some levels up, where all that is below
that ancestor meets; this is repeated until the roots are reached, so that no task gets the nodes of many partitions, however
large a group is. Last, each partition's rows meet the paths of its ragged nodes, and each row gets its proof.

A node is the SHA-256 of its two children's hexadecimal digests; the last of a level may have one child. A single row is its
tree's root.

Defined results: a null field is ``-``, another its UTF-8 length, ``:`` and itself. Null groups are a group of their own, the first;
then groups follow bytewise. Null keys are a group's first rows. Rows that repeat a key are ordered by their hash, equal rows
anyhow: they have equal hashes, but proofs by their places. Empty and long texts are hashed like any other. An empty table gives
an empty result. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a digest.
WIDE = 32
#: How many levels ragged nodes are carried up at once: what up to 2**STEP partitions of usual size have left meets in a task.
STEP = 4
#: Rows that a task hands on at once.
BATCH = 8192

NODE = pa.schema([("tree", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("node", pa.binary()), ("__pid", pa.int32())])
NODE_DDL = "tree long, total long, level int, at long, node binary, __pid int"
CLIMBED = pa.schema([*NODE, ("path", pa.binary()), ("up", pa.int64()), ("top", pa.binary())])
CLIMBED_DDL = f"{NODE_DDL}, path binary, up long, top binary"
#: What a row gets: its place in its group's tree, the tree's rows, the tree's place among all trees, their number, and binary digests.
NEW = {"position": "long", "total": "long", "tree": "long", "trees": "long", "proof": "binary", "subroot": "binary", "root": "binary"}


def leaf(*fields: Column) -> Column:
    """The binary digest of a row's fields."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def parent(children: bytes) -> bytes:
    """The digest over one or two digests."""
    return sha256(children.hex().encode()).digest()


def height(total: int) -> int:
    return max(total - 1, 0).bit_length()


#: The same of the column ``total``.
HEIGHT = "IF(total > 1, length(conv(total - 1, 10, 2)), 0)"


def levels(leaves: bytes, lo: int, total: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(index of the first node, nodes, from, to) for each level that the leaves ``lo``, ``lo + 1``, ... of ``total`` give by themselves;
    nodes outside the range from ``from`` to ``to`` have no parent among them."""
    here, n = leaves, total
    while here:
        hi = lo + len(here) // WIDE
        if n == 1:
            yield lo, here, lo, lo
            return
        a, b = lo + (lo & 1), hi if hi == n else hi & ~1
        yield lo, here, min(a, hi), max(b, a)
        here = b"".join(parent(here[WIDE * (i - lo) : WIDE * (min(i + 2, b) - lo)]) for i in range(a, b, 2))
        lo, n = a >> 1, (n + 1) >> 1


def ragged(leaves: bytes, lo: int, total: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, node) of the nodes without a parent in this partition."""
    for level, (first, nodes, a, b) in enumerate(levels(leaves, lo, total)):
        for i in range(first, first + len(nodes) // WIDE):
            if not a <= i < b:
                yield level, i, nodes[WIDE * (i - first) : WIDE * (i - first + 1)]


def offsets(rows: DataFrame, group: str) -> tuple[dict[int, tuple[int, int, int]], int]:
    """For each partition: rows of its first group in earlier partitions, rows of its last group in later ones, and the place of its first
    group among all; and how many groups there are. One row for each partition is collected."""
    key = F.struct(F.col(group).isNotNull().alias("some"), F.col(group).alias("value"))
    counts = rows.groupBy("__pid", group).agg(F.count("*").alias("n"))
    ends = counts.groupBy("__pid").agg(F.min(F.struct(key.alias("k"), "n")).alias("first"), F.max(F.struct(key.alias("k"), "n")).alias("last"), F.count("*").alias("groups")).orderBy("__pid").collect()
    before, after, place = {}, {}, {}
    at, last, groups = 0, None, 0
    for r in ends:
        same = last is not None and last["k"] == r["first"]["k"]
        before[r["__pid"]] = at if same else 0
        place[r["__pid"]] = groups - same
        groups += r["groups"] - same
        at, last = r["last"]["n"] + (before[r["__pid"]] if r["groups"] == 1 else 0), r["last"]
    at, first = 0, None
    for r in reversed(ends):
        after[r["__pid"]] = at if first is not None and first["k"] == r["last"]["k"] else 0
        at, first = r["first"]["n"] + (after[r["__pid"]] if r["groups"] == 1 else 0), r["first"]
    return {p: (before[p], after[p], place[p]) for p in before}, groups


def stretches(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[int, list[pa.RecordBatch], bool]]:
    """(partition, batches of a run of rows of one group in it, whether it is the partition's last) in order."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        keys = list(zip(batch.column("__pid").to_pylist(), batch.column(group).to_pylist(), strict=True))
        at = 0
        for key, run in itertools.groupby(keys):
            n = len(list(run))
            if now is not None and key != now:
                yield now[0], held, key[0] != now[0]
                held = []
            now = key
            held.append(batch.slice(at, n))
            at += n
    if now is not None:
        yield now[0], held, True


def joined(batches: list[pa.RecordBatch], column: str) -> bytes:
    return b"".join(itertools.chain.from_iterable(b.column(column).to_pylist() for b in batches))


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (of NODE, covering their trees' leaves without overlap) with ``path``, the siblings from the node to its root, and ``top``, the root."""
    most = nodes.agg(F.max("level").alias("level"), F.max("total").alias("total")).first()
    to = (most["level"] or 0) + STEP

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)
        for _, run in itertools.groupby(rows, key=lambda r: (r[0], r[6])):
            below = list(run)
            n, up = below[0][1], below[0][6]
            known = {(r[2], r[3]): r[4] for r in below}
            lowest, end = min(r[2] for r in below), min(to, height(n))
            for level in range(lowest, end):
                for i in sorted({i >> 1 for at, i in known if at == level}):
                    known[level + 1, i] = parent(known[level, 2 * i] + known.get((level, 2 * i + 1), b""))
            made = []
            for r in below:
                path = b"".join(known.get((level, (r[3] >> (level - r[2])) ^ 1), b"") for level in range(r[2], end))
                made.append((*r[:6], path, up, known[end, r[3] >> (end - r[2])]))
            yield table_of(made, CLIMBED)

    up = F.expr(f"shiftright(at, {to} - level)")
    dealt = nodes.withColumn("up", up).repartition("tree", "up").sortWithinPartitions("tree", "up", "level", "at")
    out = dealt.mapInArrow(task, CLIMBED_DDL)
    if height(most["total"] or 0) <= to:
        return out.drop("up")
    out = cut(out)
    over = climbed(cut(out.select("tree", "total", F.expr(f"CAST(least({to}, {HEIGHT}) AS INT)").alias("level"), F.col("up").alias("at"), F.col("top").alias("node"), F.lit(0).alias("__pid")).distinct()))
    over = over.select(F.col("tree").alias("__tree"), F.col("at").alias("__up"), F.col("path").alias("__path"), F.col("top").alias("__top"))
    met = out.join(over, (F.col("tree") == F.col("__tree")) & (F.col("up") == F.col("__up")))
    return met.select(*[c for c in nodes.columns], F.concat("path", "__path").alias("path"), F.col("__top").alias("top"))


def manifest(rows: DataFrame, group: str, key: str, digest: str = "leaf") -> DataFrame:
    """``rows`` with the columns of NEW: every row's place and proof in the tree of its group and in that over all groups.

    ``rows`` should be narrow: what they hold beside ``digest`` (binary) is shuffled twice.
    """
    rows = rows.select(*[c for c in rows.columns if c not in NEW], F.monotonically_increasing_id().alias("__tie"))
    rows = cut(rows)
    order = [F.col(c).asc_nulls_first() for c in (group, key, digest, "__tie")]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    in_order = cut(in_order.withColumns({"__tie": F.monotonically_increasing_id(), "__pid": F.spark_partition_id()}))
    known, trees = offsets(in_order, group)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, tree, lo = None, 0, 0
        for p, run, last in stretches(batches, group):
            lo, tree = (known[p][0], known[p][2]) if p != pid else (0, tree + 1)
            pid = p
            leaves = joined(run, digest)
            total = lo + len(leaves) // WIDE + (known[p][1] if last else 0)
            if made := [(tree, total, level, i, node, p) for level, i, node in ragged(leaves, lo, total)]:
                yield table_of(made, NODE)

    nodes = cut(in_order.select("__pid", group, digest).mapInArrow(first, NODE_DDL))
    whole = F.expr(f"level = {HEIGHT}")
    none = F.lit(b"").alias("path")
    paths = nodes.where(whole).select("*", none, F.col("node").alias("top")).unionByName(climbed(cut(nodes.where(~whole))))
    paths = cut(paths)
    roots = cut(paths.groupBy("tree").agg(F.first("top").alias("node")).select("tree", F.lit(trees).cast("long").alias("total"), F.lit(0).alias("level"), F.col("tree").alias("at"), "node", F.lit(0).alias("__pid")))
    over = climbed(roots.withColumn("tree", F.lit(0).cast("long"))).select(F.col("at").alias("__tree"), F.col("path").alias("__over"), F.col("top").alias("root"))
    paths = paths.join(over, F.col("tree") == F.col("__tree")).select("__pid", "tree", "total", "level", "at", "path", "__over", F.col("top").alias("subroot"), "root")

    given = [c for c in in_order.columns if c not in ("__pid", "__tie")]
    both = in_order.select("__pid", "__tie", *given).unionByName(paths.withColumn("__tie", F.lit(-1).cast("long")), allowMissingColumns=True)
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes if c in given], *[f"{c} {t}" for c, t in NEW.items()]])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, lo, tops = None, 0, {}
        for p, run, told, last in parted(batches, group):
            if p != pid:
                pid, tops = p, {}
                for t in told:
                    tops.setdefault(t[0], {})[t[2], t[3]] = t
                tree, lo = known[p][2], known[p][0]
            else:
                tree, lo = tree + 1, 0
            leaves = joined(run, digest)
            total = lo + len(leaves) // WIDE + (known[p][1] if last else 0)
            built = [(x[0], x[1]) for x in levels(leaves, lo, total)]
            own, at = tops[tree], lo
            for part in itertools.chain.from_iterable(cut_up(b) for b in run):
                made = [proof_of(i, total, built, own) for i in range(at, at + part.num_rows)]
                at += part.num_rows
                cols = [range(at - part.num_rows, at), [total] * len(made), [tree] * len(made), [trees] * len(made), *[[m[k] for m in made] for k in range(3)]]
                kinds = [pa.int64()] * 4 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in given], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*given, *NEW])

    return both.repartition("__pid").sortWithinPartitions("__pid", "__tie").mapInArrow(second, ddl)


def cut_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH):
        yield batch.slice(i, BATCH)


def parted(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[int, list, list, bool]]:
    """Like ``stretches``, with a partition's paths (rows with __tie -1, which come first)."""
    told: dict[int, list] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_path = pc.less(b.column("__tie"), 0)
            for r in b.filter(is_path).select(["__pid", "tree", "total", "level", "at", "path", "__over", "subroot", "root"]).to_pylist():
                told.setdefault(r["__pid"], []).append(tuple(r.values())[1:])
            if (b := b.filter(pc.invert(is_path))).num_rows:
                yield b

    pid = None
    for p, run, last in stretches(rows(), group):
        yield p, run, told.pop(p, []) if p != pid else [], last
        pid = p


def proof_of(i: int, total: int, built: list, own: dict) -> tuple[bytes, bytes, bytes]:
    """(proof, subroot, root) of leaf ``i``: the siblings in this partition, then those on the path of the ragged node above."""
    proof, level = [], 0
    while (level, i) not in own:
        first, nodes = built[level]
        k = WIDE * ((i ^ 1) - first)
        proof.append(nodes[k : k + WIDE] if 0 <= k else b"")
        i >>= 1
        level += 1
    top = own[level, i]
    return b"".join([*proof, top[4], top[5]]), top[6], top[7]


def folded(start: bytes, places: list[tuple[int, int]], proof: bytes) -> bytes:
    """The root that follows from a leaf and its siblings; ``places``: (index, number of leaves) in each tree on the way."""
    at, now = 0, start
    for i, n in places:
        while n > 1:
            if i & 1:
                now, at = parent(proof[at : at + WIDE] + now), at + WIDE
            elif i + 1 < n:
                now, at = parent(now + proof[at : at + WIDE]), at + WIDE
            else:
                now = parent(now)
            i, n = i >> 1, (n + 1) >> 1
    return now


def refolded(rows: DataFrame, claimed: str) -> DataFrame:
    """Rows of a manifest with ``folded_root``: the root that follows from the digest in ``claimed`` and the row's proof."""
    keep = [c for c in rows.columns if c != "folded_root"]
    used = [claimed, "position", "total", "tree", "trees", "proof"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*[b.column(keep.index(c)).to_pylist() for c in used], strict=True)
            roots = [folded(x, [(i, n), (t, m)], proof) for x, i, n, t, m, proof in each]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], names=[*keep, "folded_root"])

    return rows.select(*keep).mapInArrow(task, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes if c in keep], "folded_root binary"]))
