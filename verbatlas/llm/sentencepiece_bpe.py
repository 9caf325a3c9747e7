"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is escaped (a space becomes the mark U+2581, with one mark before the text) and cut where no
piece of the vocabulary can reach across: before a run of marks and around line feeds, which is
checked on the vocabulary. In each part an agenda of adjacent symbol pairs, ordered by the score
of the merged piece and then from the left, is worked off until no pair is in the vocabulary.
Symbols without a piece are spelled in byte pieces. A part that a task meets for the first time in
an Arrow batch is encoded by the sentencepiece library too, and a difference stops the job.

Defined results: a null text counts as empty, and an empty text has the begin and end ids alone.
Parts over MOST_CACHED characters are encoded each time; a text of any length is one row. Repeated
rows repeat; an empty table gives an empty result; columns with the new names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import pairwise
from operator import add
from sys import getsizeof

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_texts

MARK = "▁"
#: Bytes of the parts kept in a Python worker's memory, in each of two generations; and the characters of a part that is kept, at most.
KEPT_BYTES, MOST_CACHED = 56 << 20, 48
#: What a part's place in a dictionary takes, besides itself and its ids.
PLACE_BYTES = 100
#: Characters whose texts are encoded and checked together.
ROUND = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Kept:
    """Ids of parts, in two generations bounded by bytes. When the younger one is full it becomes the older, whose parts are forgotten
    unless they were met since; nothing is copied."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, part: str, ids: bytes) -> None:
        if len(part) <= MOST_CACHED:
            self.young[part] = ids
            self.size += getsizeof(part) + getsizeof(ids) + PLACE_BYTES
            if self.size > KEPT_BYTES:
                self.young, self.old, self.size = {}, self.young, 0

    def met(self, parts: set[str]) -> dict[str, bytes]:
        """Those of the parts that are known, which stay known."""
        young, old = self.young, self.old
        out = {p: young[p] for p in parts if p in young}
        again = {p: old[p] for p in parts if p not in out and p in old}
        for p, ids in again.items():
            self.put(p, ids)
        out.update(again)
        return out


class Encoder:
    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.order = {names[i]: -sp.get_score(i) for i in plain}  # the highest score first
        self.raw = {p: np.uint32(i).tobytes() for p, i in self.ids.items()}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.begin, self.end = (np.uint32(i).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        if any(a != MARK and b == MARK for p in self.ids for a, b in pairwise(p)) or any("\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("a piece of this vocabulary reaches over a cut")
        if len(self.bytes) != 256:
            raise ValueError("this vocabulary has no byte pieces")
        # a further cut: between a letter and a mark of punctuation that no piece has after a letter
        letters = {p for p in self.ids if len(p) == 1 and p.isalpha()}
        joined = {b for p in self.ids for a, b in pairwise(p) if a in letters}
        w, stops = (re.escape("".join(sorted(x))) for x in (letters, set(",.;:!?") - joined))
        self.cuts = re.compile(f"{MARK}+[{w}]++(?=[{MARK}\n{stops}]|\\Z)|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        self.kept = Kept()

    def merged(self, part: str) -> list[str]:
        """The symbols of a part, when no adjacent pair is in the vocabulary any more."""
        order, symbols = self.order, list(part)
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda = [(order[pair], i, i + 1, pair) for i, pair in enumerate(map(add, symbols, symbols[1:])) if pair in order]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if after[i] != j or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged with another since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            after[j] = -2
            if k >= 0:
                before[k] = i
                new = pair + symbols[k]
                if new in order:
                    heapq.heappush(agenda, (order[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in order:
                    heapq.heappush(agenda, (order[new], h, i, new))
        return [s for s in symbols if s]

    def part_ids(self, part: str) -> bytes:
        """The ids of a part's symbols; one without a piece is spelled in bytes."""
        raw = self.raw
        return b"".join([raw[s] if s in raw else b"".join([np.uint32(self.bytes[b]).tobytes() for b in s.encode()]) for s in self.merged(part)])

    def checked(self, parts: list[str], ids: list[bytes]) -> None:
        """Compares the parts' ids with the library's for all of them, set between line feeds."""
        theirs = np.array(self.sp.encode("".join(["\n" + p.replace(MARK, " ") for p in parts]))[1:], np.uint32)
        feed = np.array([self.bytes[10]], np.uint32).tobytes()
        if theirs.tobytes() != b"".join([feed + i for i in ids]):
            raise ValueError(f"the agenda and the library differ on one of {parts[:3]!r}...")

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Encodes parts that are not kept yet, has them checked, and keeps them."""
        new = {p: self.part_ids(p) for p in fresh}
        self.checked([*new], [*new.values()])
        for p, ids in new.items():
            self.kept.put(p, ids)
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids with begin and end, as little-endian unsigned 32-bit numbers."""
        parts = [self.cuts(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*parts)
        ids = self.kept.met(every)
        if len(ids) < len(every):
            ids |= self.learn([p for p in every if p not in ids])
        return [b"".join([self.begin, *map(ids.__getitem__, p), self.end]) for p in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(i, np.uint32).tolist() for i in ids])


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    """One for a process: Spark's Python workers serve many tasks, which share the kept parts."""
    return Encoder(model_file)


def rounds(texts: list[str | None]) -> list[list[str | None]]:
    out: list[list] = []
    size = 0
    for t in texts:
        if not out or size + len(t or "") > ROUND:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t or "")
    return out


def encoded(docs: DataFrame, model_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` with ids array<int> (if asked), n_tokens, ids_sha256, decoded_sha256."""
    model_file = model_file or default_model()

    def make():
        own = encoder(model_file)

        def work(texts: list) -> list[list]:
            raw, back = [], []
            for some in rounds(texts):
                raw += (ids := own.encode(some))
                back += [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in own.decode(ids)]
            return [*([[np.frombuffer(i, np.uint32) for i in raw]] if with_ids else []), [len(i) // 4 for i in raw], [hashlib.sha256(i).hexdigest() for i in raw], back]

        return work

    fields = ({"ids": pa.list_(pa.int32())} if with_ids else {}) | {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return map_texts(docs, "text", fields, "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
