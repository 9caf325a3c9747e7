"""Arbitrary state of streams: monthly quotas, and texts that are read while their JSON still comes in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The state of these operators is kept in RocksDB, on disk and in the checkpoint, so that it may outgrow the memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def frame(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    """Rows as columns of plain Python strings, whatever kind of strings pandas prefers."""
    cols = zip(names, zip(*rows, strict=True), strict=True)
    return pd.DataFrame({n: pd.Series(v, dtype=object if isinstance(v[0], str) else None) for n, v in cols})


# --- quotas --------------------------------------------------------------------------------------


class Quota(StatefulProcessor):
    """Counts what a key was allowed in each month, up to ``most``; a month is forgotten when the watermark has passed its end."""

    def __init__(self, key: str, at: str, most: int) -> None:
        self.key, self.at, self.most = key, at, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "month string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        out = []
        for t in pd.concat(list(rows))[self.at].sort_values():
            month = f"{t:%Y-%m}"
            known = self.used.containsKey((month,))
            n = self.used.getValue((month,))[0] if known else 0
            if not known:
                self.handle.registerTimer(int((t.to_period("M").end_time.value // 1_000_000) + 1))
            allowed = n < self.most
            if allowed or not known:
                self.used.updateValue((month,), (n + allowed,))
            out.append((key[0], t, month, allowed, n + allowed))
        yield frame([self.key, self.at, "month", "allowed", "used"], out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        over = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - 1, unit="ms")
        month = f"{over:%Y-%m}"
        if self.used.containsKey((month,)):
            self.used.removeKey((month,))
        yield from ()

    def close(self) -> None:
        pass


def quota(events: DataFrame, key: str = "user_id", at: str = "ts", most: int = 3, late: str = "1 hour") -> DataFrame:
    """(key, at, month, allowed, used) of a stream of attempts: the first ``most`` of a key in a calendar month (UTC) are allowed, in order
    of time within a micro-batch and of micro-batches. A refused attempt uses nothing. A restart goes on from the checkpoint."""
    kind = dict(events.dtypes)[key]
    rows = events.select(key, at).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(
        Quota(key, at, most), outputStructType=f"{key} {kind}, {at} timestamp, month string, allowed boolean, used long", outputMode="append", timeMode="EventTime"
    )


# --- texts in JSON that is still coming in --------------------------------------------------------


KEY = '"text"'
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: What stands between two texts, and for half of a pair of surrogates or four digits that are none.
BETWEEN, BROKEN = "\n\n", "�"
OUTSIDE, NAMED, COLON, INSIDE, ESCAPED, CODE = range(6)


class Reader(NamedTuple):
    """How far a reader has come: its mode, the characters of the key that it has met, the digits of a code, and the first half of a pair."""

    mode: int = OUTSIDE
    met: int = 0
    digits: str = ""
    high: int = 0


def fed(reader: Reader, piece: str) -> tuple[Reader, str]:
    """The reader after a further piece of JSON, and what this adds to the texts (the strings under KEY, in order, each followed by
    BETWEEN). However the JSON is cut, the additions make the same whole."""
    mode, met, digits, high = reader
    out: list[str] = []

    def add(code: int) -> None:
        nonlocal high
        if high and 0xDC00 <= code < 0xE000:
            out.append(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00))
            high = 0
            return
        if high:
            out.append(BROKEN)
            high = 0
        if 0xD800 <= code < 0xDC00:
            high = code
        else:
            out.append(BROKEN if 0xDC00 <= code < 0xE000 else chr(code))

    for c in piece:
        if mode == INSIDE:
            if c == "\\":
                mode = ESCAPED
            elif c == '"':
                if high:
                    out.append(BROKEN)
                    high = 0
                out.append(BETWEEN)
                mode, met = OUTSIDE, 0
            else:
                add(ord(c))
        elif mode == ESCAPED:
            mode, digits = (CODE, "") if c == "u" else (INSIDE, "")
            if c != "u":
                add(ord(ESCAPES.get(c, c)))
        elif mode == CODE:
            digits += c
            if len(digits) == 4:
                add(int(digits, 16) if all(x in "0123456789abcdefABCDEF" for x in digits) else ord(BROKEN))
                mode, digits = INSIDE, ""
        elif mode == OUTSIDE:
            met = met + 1 if c == KEY[met] else int(c == KEY[0])
            if met == len(KEY):
                mode = NAMED
        elif not c.isspace():
            if mode == NAMED and c == ":":
                mode = COLON
            elif mode == COLON and c == '"':
                mode = INSIDE
            else:
                mode, met = OUTSIDE, int(c == KEY[0])
    return Reader(mode, met, digits, high), "".join(out)


class Texts(StatefulProcessor):
    """Feeds each key's pieces to its reader, in order; pieces that come before their turn wait in the state."""

    def __init__(self, key: str, seq: str, piece: str) -> None:
        self.key, self.seq, self.piece = key, seq, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reader = handle.getValueState("reader", "mode int, met int, digits string, high int, next long")
        self.waiting = handle.getMapState("waiting", "seq long", "piece string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        *fields, at = self.reader.get() if self.reader.exists() else (*Reader(), 0)
        reader, first, text = Reader(*fields), at, []
        new = {int(n): p or "" for frame in rows for n, p in zip(frame[self.seq], frame[self.piece], strict=True) if n >= at}
        while at in new or self.waiting.containsKey((at,)):
            if at in new:
                piece = new.pop(at)
            else:
                piece = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
            reader, more = fed(reader, piece)
            text.append(more)
            at += 1
        for n, p in new.items():
            self.waiting.updateValue((n,), (p,))
        self.reader.update((*reader, at))
        if at > first:
            yield frame([self.key, "upto", "text"], [(key[0], at, "".join(text))])

    def close(self) -> None:
        pass


def texts(pieces: DataFrame, key: str = "id", seq: str = "seq", piece: str = "piece") -> DataFrame:
    """(key, upto, text) of a stream of pieces numbered from 0: what the pieces before ``upto`` add to the text read so far."""
    kind = dict(pieces.dtypes)[key]
    return pieces.select(key, seq, piece).groupBy(key).transformWithStateInPandas(
        Texts(key, seq, piece), outputStructType=f"{key} {kind}, upto long, text string", outputMode="append", timeMode="None"
    )
