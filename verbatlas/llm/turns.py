"""Repair of conversations: the cheapest edits after which their turns alternate, by lazy weighted determinisation.

A grammar, ``(s?(ua)+)?`` over the initials of the roles, says what a sound conversation is; edits have costs. Keep is free, Rerole (to user
or assistant) costs 1, Delete 2, Insert (a turn without text) 5, and to leave a truncated turn undeleted costs 5 more. Blank turns and
those that repeat an earlier one must be deleted.

Grammar and edits are a small nondeterministic automaton with costs. It is determinised while it runs: the costs of completing
a conversation from each grammar state, less the least of them, are a state of the deterministic one, and what (state, turn) leads to is computed
when first met and kept in a table. As the differences of these costs are bounded, the table is small. A conversation is
scanned from its last turn to its first, one look-up a turn; then the arcs that attain the costs (the tight ones) are followed the
other way, from the first turn on, and of several the least letter is taken. So the edits found are the cheapest and, of those, the
ASCII-least. What a tight arc does is kept with the table too.

Rows are sorted by ranges of conversation and turn, so that a conversation may reach over any number of partitions: what such
a stretch does to costs is a 4 x 4 matrix of path costs (four scans), and what it does to the state in which it is entered is four
numbers. Both go to the driver for the last conversation of each partition and the first, the only ones that can reach over its ends.

Defined results: a null role or text is one space. Null conversations are one conversation. Null turns come first; turns with equal numbers
are ordered by role, then by the hash of role and text. An empty role is of no kind. A turn repeats an earlier one if role and text are equal;
a blank turn is only blank. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_dimension
from .merkle import stretches

RERATE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: ASCII white space.
SPACES = " \t\n\x0b\x0c\r"
#: Grammar states: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's. Where the next initial leads.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, NAMES = range(4), {"u": "user", "a": "assistant"}
#: The role that may stand in a state besides a system's.
WANTS = {0: "u", 1: "u", 2: "a", 3: "u"}
INF = 1 << 40
#: The costs of ending in a state, by inserting what is missing.
END = (0, 2 * INSERT, INSERT, 0)
KINDS = "sua"
#: Rows that a task hands on at once.
BATCH = 4096

EDITS_DDL = "conv_id {}, __pid int, __seq long, edit string, role string, text string, turn {}, fault string, was string, cost long"


def closed(costs: list[int]) -> list[int]:
    """The costs of states, where turns may be inserted first."""
    costs[2] = min(costs[2], INSERT + costs[3])
    for q in (0, 1, 3):
        costs[q] = min(costs[q], INSERT + costs[2])
    return costs


class Automaton:
    """The deterministic automaton, as far as it has been met. A turn's symbol is 0 if it must be deleted, else 1 + 2 * (place of its
    initial in KINDS, or 3) + (1 if it is truncated)."""

    def __init__(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.tight: dict[tuple[int, int, int], tuple[str, str, int, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The state of these costs, and what was taken off them."""
        least = min(costs)
        normal = tuple(c - least if c < INF else INF for c in costs)
        if normal not in self.number:
            self.number[normal] = len(self.states)
            self.states.append(normal)
        return self.number[normal], least

    def arcs(self, symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of what may be done to a turn, letters ascending."""
        out = [("D", DELETE, q)]
        if symbol:
            kind, extra = KINDS[(symbol - 1) // 2 : (symbol - 1) // 2 + 1], TRUNCATED * ((symbol - 1) % 2)
            if (q, kind) in NEXT:
                out.append(("K", extra, NEXT[q, kind]))
            out.append(("R", RERATE + extra, NEXT[q, WANTS[q]]))
        return out

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """The state before a turn, from that after it; and the costs taken off."""
        if (after, symbol) not in self.table:
            b = self.states[after]
            raw = [min(c + b[t] for _, c, t in self.arcs(symbol, q)) for q in STATES]
            self.table[after, symbol] = self.state(tuple(min(c, INF) for c in closed(raw)))
        return self.table[after, symbol]

    def act(self, after: int, symbol: int, q: int) -> tuple[str, str, int, int]:
        """(letters, inserted initials, next state, cost) of the least tight arcs from ``q`` before a turn until the turn is done."""
        if (after, symbol, q) not in self.tight:
            before, off = self.step(after, symbol)
            now, b = self.states[before], self.states[after]
            letter, cost, to = next((a for a in self.arcs(symbol, q) if a[1] + b[a[2]] == now[q] + off), ("~", 0, q))
            ins = NEXT[q, WANTS[q]]
            if letter > "I" and INSERT + now[ins] == now[q]:
                letters, inserted, to, cost = self.act(after, symbol, ins)
                self.tight[after, symbol, q] = "I" + letters, WANTS[q] + inserted, to, cost + INSERT
            else:
                self.tight[after, symbol, q] = letter, "", to, cost
        return self.tight[after, symbol, q]

    def scan(self, symbols: bytes, end: tuple[int, ...]) -> tuple[list[int], int]:
        """The state after each turn and before the first, in that order from the last; and the costs taken off."""
        now, total = self.state(end)
        out, table = [now], self.table
        for x in reversed(symbols):
            now, off = table.get((now, x)) or self.step(now, x)
            total += off
            out.append(now)
        return out, total

    def trace(self, symbols: bytes, states: list[int], q: int) -> Iterator[tuple[str, str, int, int]]:
        n = len(symbols)
        for i, x in enumerate(symbols):
            got = self.tight.get((states[n - 1 - i], x, q)) or self.act(states[n - 1 - i], x, q)
            yield got
            q = got[2]

    def matrix(self, symbols: bytes) -> list[int]:
        """The least costs from each state (rows) to each."""
        cols = []
        for j in STATES:
            states, total = self.scan(symbols, tuple(0 if i == j else INF for i in STATES))
            cols.append([min(c + total, INF) if c < INF else INF for c in self.states[states[-1]]])
        return [cols[j][i] for i in STATES for j in STATES]


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, __d, fault, __symbol, __tie), written. A turn repeats an earlier one if it isn't the first with its role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    d = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    out = cut(rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), d.alias("__d"), F.monotonically_increasing_id().alias("__tie")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"), F.col("__tie").alias("tie"))
    firsts = cut(out.groupBy("conv_id", "__d").agg(F.min(place).alias("__first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = join_dimension(out, firsts, ["conv_id", "__d"])
    body = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(body == "", "blank")
        .when(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(place), "duplicate")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    )
    out = out.withColumn("fault", fault).drop("__first")
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    return out.withColumn("__symbol", F.when(must, 0).otherwise(1 + 2 * kind + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int")).cast("tinyint"))


def symbols_of(run: list[pa.RecordBatch]) -> bytes:
    return b"".join(bytes(b.column("__symbol").to_pylist()) for b in run)


def ends(rows: DataFrame) -> list:
    """(partition, whether it is the last and the first conversation in it, conversation, matrix) of partitions' ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, seen = Automaton(), None
        for pid, run, last in stretches(batches, "conv_id"):
            if last or pid != seen:
                made = auto.matrix(symbols_of(run))
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([pid != seen]), pa.array([last]), run[0].column("conv_id").slice(0, 1), pa.array([made], pa.list_(pa.int64()))], names=["pid", "first", "last", "conv_id", "matrix"])
            seen = pid

    kind = dict(rows.dtypes)["conv_id"]
    return rows.select("__pid", "conv_id", "__symbol").mapInArrow(task, f"pid int, first boolean, last boolean, conv_id {kind}, matrix array<bigint>").collect()


def continued(found: list) -> dict[int, tuple[int, ...]]:
    """For each partition whose last conversation goes on, the costs of completing it from what follows."""
    firsts = {r["pid"]: r for r in found if r["first"]}
    lasts = {r["pid"]: r for r in found if r["last"]}
    out, after = {}, None  # after: (conversation, costs before its stretch in the next partition)
    for pid in sorted(firsts, reverse=True):
        end = END
        if after is not None and after[0] == lasts[pid]["conv_id"]:
            out[pid] = end = after[1]
        first = firsts[pid]
        last, m = (end if first["last"] else END), first["matrix"]
        after = first["conv_id"], tuple(min(INF, *(m[4 * i + j] + last[j] for j in STATES)) for i in STATES)
    return out


def entered(rows: DataFrame, after: dict[int, tuple[int, ...]]) -> dict[int, int]:
    """For each partition whose first conversation goes on from the one before: the state in which it is entered."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, seen = Automaton(), None
        for pid, run, last in stretches(batches, "conv_id"):
            if last and pid in after:
                symbols, to = symbols_of(run), []
                states, _ = auto.scan(symbols, after[pid])
                for q in STATES if pid != seen else (0,):
                    for _, _, q, _ in auto.trace(symbols, states, q):
                        pass
                    to.append(q)
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([to], pa.list_(pa.int32()))], names=["pid", "to"])
            seen = pid

    to = {r["pid"]: r["to"] for r in rows.select("__pid", "conv_id", "__symbol").mapInArrow(task, "pid int, to array<int>").collect()} if after else {}
    out: dict[int, int] = {}
    pids = sorted(r[0] for r in rows.select("__pid").distinct().collect()) if after else []
    for pid, following in zip(pids, pids[1:]):
        if pid in to:
            out[following] = to[pid][out.get(pid, 0) if len(to[pid]) > 1 else 0]
    return out


def edits(rows: DataFrame) -> DataFrame:
    """The edits of all conversations (conv_id, turn, role, text) in order of ``__pid``, ``__seq``: a row for each turn and each inserted one.

    ``edit`` is its letter (K, R, D, I), ``role`` and ``text`` are those after it (of a deleted turn: before), ``fault`` is blank, duplicate,
    truncated or null, ``was`` the role before it (null: inserted).
    """
    ready = turns_of(rows)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "__d", "__tie")]
    ready = ready.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("__pid"), "conv_id", "turn", "role", "text", "fault", "__symbol")
    ready = cut(ready)
    after = continued(ends(ready))
    before = entered(ready, after)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, seen, made, seq = Automaton(), None, [], 0
        for pid, run, last in stretches(batches, "conv_id"):
            symbols = symbols_of(run)
            goes_on = last and pid in after
            states, _ = auto.scan(symbols, after[pid] if goes_on else END)
            q = before.get(pid, 0) if pid != seen else 0
            seq, seen = 0 if pid != seen else seq, pid
            steps = auto.trace(symbols, states, q)
            for b in run:
                conv = b.column("conv_id").to_pylist()
                for c, turn, role, text, fault, (letters, inserted, q, cost) in zip(conv, *[b.column(x).to_pylist() for x in ("turn", "role", "text", "fault")], steps):  # noqa: B905
                    for x in inserted:
                        made.append((c, pid, seq, "I", NAMES[x], "", None, None, None, INSERT))
                        seq += 1
                    new = ("user" if q == 2 else "assistant") if letters[-1] == "R" else role
                    made.append((c, pid, seq, letters[-1], new, text, turn, fault, role, cost - INSERT * len(inserted)))
                    seq += 1
                if len(made) >= BATCH:
                    yield batch_of(made)
                    made = []
            if not goes_on:
                for x in {1: "ua", 2: "a"}.get(q, ""):
                    made.append((c, pid, seq, "I", NAMES[x], "", None, None, None, INSERT))
                    seq += 1
        if made:
            yield batch_of(made)

    kinds = dict(rows.dtypes)
    turn_type, conv_type = (pa.string() if kinds[x] == "string" else pa.int32() if kinds[x] == "int" else pa.int64() for x in ("turn", "conv_id"))
    types = [conv_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), turn_type, pa.string(), pa.string(), pa.int64()]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        cols = zip(*made, strict=True)
        names = ["conv_id", "__pid", "__seq", "edit", "role", "text", "turn", "fault", "was", "cost"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return ready.mapInArrow(task, EDITS_DDL.format(kinds["conv_id"], kinds["turn"]))


FAULTS = ("blank", "duplicate", "truncated")


def summary(made: DataFrame) -> DataFrame:
    """A row for each conversation of ``edits``: its faults, the cost, the letters, and the SHA-256 of the repaired turns.

    A hash over a whole conversation can't be split, so here all its rows pass through one task; they are streamed, and nothing but
    the letters is kept of them.
    """
    kind = dict(made.dtypes)["conv_id"]
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = ..., None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv_id"] != now:
                    if s is not None:
                        out.append(s.row())
                    now, s = r["conv_id"], Summed(r["conv_id"])
                s.add(r)
            if out:
                yield batch_of(out)
        if s is not None:
            yield batch_of([s.row()])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"])

    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "__pid", "__seq")
    return ordered.mapInArrow(task, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Summed:
    """What is counted of a conversation while its edits pass by."""

    def __init__(self, conv: object) -> None:
        self.conv, self.first, self.last, self.distinct, self.cost, self.illegal = conv, None, None, 0, 0, 0
        self.faults, self.letters, self.hash, self.lines, self.initial = dict.fromkeys(FAULTS, 0), [], sha256(), 0, None

    def add(self, r: dict) -> None:
        self.letters.append(r["edit"])
        self.cost += r["cost"]
        if r["fault"]:
            self.faults[r["fault"]] += 1
        if r["edit"] != "D":
            self.hash.update(("\n" * (self.lines > 0) + f"{r['role']}:{r['text']}").encode())
            self.lines += 1
        if r["edit"] == "I":
            return
        if self.initial is not None and self.initial + r["was"][:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = r["was"][:1]
        if r["turn"] is not None and r["turn"] != self.last:
            self.first = r["turn"] if self.first is None else self.first
            self.last = r["turn"]
            self.distinct += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space there and in roles and texts."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code: Column = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    out = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), code.alias("__code")).where("__code <> 0")
    return out.select("conv_id", "turn", "role", "text", F.explode(F.expr("IF(__code = 3, array(0, 1), array(0))")).alias("__copy")).drop("__copy")
