"""Personal data: pattern spans, and terms that disclose a protected entity by co-occurrence.

Four kinds are found by pattern (email, ip, card, phone). What is protected are classes of them: the exact
value, its group (an e-mail's domain, the first two parts of an ip, a card's issuer digits, a phone's area), its
kind, and personal data of any kind. Over all documents, n(c), n(t) and n(t, c) count those that hold the class c,
those that hold the term t, and those that hold t with c: within WINDOW words of it for values and groups, anywhere
in the document for kinds. The term's pointwise mutual information with the class, log(n(t, c) N / (n(t) n(c))), is
compared with the class's information log(N / n(c)): a term that gives ALPHA of it or more discloses the
class. Both must meet in LEAST_SUPPORT different surroundings, so that one sentence, copied however often, proves
nothing. Every occurrence of such a term in a document that holds the class, near it or not and also as a part of a
compound, is a further span (kind ``term``); sanitised texts have a general name for a name or number, and
nothing for another word.

Defined results: a null or empty text has no span (and stays null or empty). Spans are in code
points, end exclusive, ordered by start, then kind. Repeated rows repeat, and rows without
``doc_id`` are handled like others. Only doc_id and the text are read; columns with the names of new ones can't clash. A class that every document holds is disclosed by no term. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_dimension, slices

KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
PART = re.compile(r"[^\W_]+")

#: Words on either side of an entity that count as near it; the share of a class's information
#: that a term may give; and the different surroundings that a term and a class must share.
WINDOW, ALPHA, LEAST_SUPPORT = 12, 0.7, 3
#: The class of all personal data.
ANY = "any"
#: Bits of the bitmap of candidate terms that is sent to the tasks that count documents.
BITMAP = 1 << 24
#: Up to this many disclosing pairs are sent to the tasks that mark occurrences.
TERMS_SENT = 100_000

#: Meetings handed on at once, and pairs of term and surrounding after which a task forgets which it has handed on.
NEAR_AT_ONCE, SEEN = 8192, 50_000

#: What stands for a span in a sanitised text.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of EMAIL, leftmost first; matching starts only in runs of characters before an @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four kinds, in order; a match that fails its test is dropped."""
    if not text:
        return []
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def parsed(spans: str) -> list[tuple[int, str, int]]:
    return [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in spans.split(","))] if spans else []


def classes_of(kind: str, value: str) -> list[str]:
    """The value and its group, as short keys: the kind and a hash, without case and separators."""
    plain = value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    group = {"email": plain.rpartition("@")[2], "ip": ".".join(plain.split(".")[:2]), "card": plain[:6], "phone": plain[:-7] or plain}[kind]
    return [f"{kind}{level}:{hashlib.sha256(x.encode()).hexdigest()[:20]}" for level, x in (("", plain), ("-group", group))]


def held_by(text: str, spans: list[tuple[int, str, int]]) -> list[str]:
    """The classes that a text holds."""
    own = {c for a, k, b in spans for c in classes_of(k, text[a:b])}
    return sorted(own | {k for _, k, _ in spans} | ({ANY} if spans else set()))


def merged(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What the ordered spans cover, as intervals that do not touch."""
    reach: list[tuple[int, int]] = []
    for a, _, b in spans:
        if reach and a <= reach[-1][1]:
            reach[-1] = (reach[-1][0], max(b, reach[-1][1]))
        else:
            reach.append((a, b))
    return reach


def words_before(text: str, start: int) -> list[re.Match]:
    """The last WINDOW words before a place, from ever earlier beginnings until there are enough."""
    step = 16 * WINDOW
    while True:
        lo = max(0, start - step)
        words = [*TERM.finditer(text, lo, start)]
        if lo == 0:
            return words[-WINDOW:]
        if len(words) > WINDOW:  # the first may have lost its beginning
            return words[-WINDOW:]
        step *= 2


def gaps(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """The stretches of a text outside its base spans."""
    return [(lo, hi) for (_, lo), (hi, _) in pairwise([(0, 0), *merged(spans), (len(text), len(text))]) if lo < hi]


def meetings(text: str, spans: list[tuple[int, str, int]]) -> tuple[Iterator[tuple[str, str, int, bool]], list[str], int]:
    """What a text says of its classes, outside all base spans: (class, term, surrounding, whether first in this
    text) near each value, class by class; the distinct terms of the whole text; and the surrounding of its first value."""
    reach = merged(spans)

    def free(m: re.Match) -> bool:
        i = bisect_left(reach, (m.end(), 0)) - 1  # the last that begins before the word's end
        return i < 0 or reach[i][1] <= m.start()

    def near(start: int, end: int) -> tuple[list[str], int]:
        words = [m[0].lower() for m in (*words_before(text, start), *islice(TERM.finditer(text, end), WINDOW)) if free(m)]
        return words, xxhash.xxh64_intdigest(" ".join(words)) >> 1

    def met() -> Iterator[tuple[str, str, int, bool]]:
        by_class: dict[str, list[int]] = {}
        for i, (start, kind, end) in enumerate(spans):
            for c in classes_of(kind, text[start:end]):
                by_class.setdefault(c, []).append(i)
        for c, own in by_class.items():
            seen, told = set(), set()
            for i in own:
                words, around = near(spans[i][0], spans[i][2])
                for t in words:
                    if len(t) > 1 and (t, around) not in told:
                        yield c, t, around, t not in seen
                        seen.add(t)
                        told.add((t, around))
                if len(told) > SEEN:  # what is said again is summed up by Spark
                    told.clear()

    said = {m.lower() for lo, hi in gaps(text, spans) for m in TERM.findall(text, lo, hi) if len(m) > 1} if spans else set()
    return met(), sorted(said), near(spans[0][0], spans[0][2])[1] if spans else 0


def runs(text: str, m: re.Match, most: int) -> list[list[tuple[int, int, str]]]:
    """For each part of a compound, where the runs of up to ``most`` parts from it on stand, and their words."""
    parts = [x.span() for x in PART.finditer(text, *m.span())]
    if len(parts) < 2:
        return []
    return [[(a, b, text[a:b].lower()) for _, b in parts[i : i + most]] for i, (a, _) in enumerate(parts)]


def n_parts(term: str) -> int:
    return len(PART.findall(term))


def occurrences(text: str, spans: list[tuple[int, str, int]], terms: set[str]) -> list[tuple[int, str, int]]:
    """Spans of the ``terms`` in the whole text outside the base spans; in a compound, of its longest parts that are terms."""
    out, most = [], max(map(n_parts, terms), default=0)
    for lo, hi in gaps(text, spans):
        for m in TERM.finditer(text, lo, hi):
            if m[0].lower() in terms:
                out.append((m.start(), "term", m.end()))
                continue
            done = 0
            for own in runs(text, m, most):
                hit = [(a, b) for a, b, w in own if a >= done and w in terms]
                if hit:
                    out.append((hit[-1][0], "term", hit[-1][1]))
                    done = hit[-1][1]
    return out


def found(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text, th): ``base`` (the spans, joined), the classes ``held``, its terms ``said`` and its ``around``; and
    a row for each of its ``meetings``: ``c``, ``t``, ``around``, ``first``. A text with very many values is many rows, not one."""
    lists, kind = pa.list_(pa.string()), dict(docs.dtypes)["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text")):
            ids = part.schema.field("doc_id").type
            types = {"doc_id": ids, "th": pa.int64(), "base": pa.string(), "held": lists, "said": lists, "around": pa.int64(), "c": pa.string(), "t": pa.string(), "first": pa.bool_()}

            def batch(n: int, **cols: list | pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([cols[x] if isinstance(cols.get(x), pa.Array) else pa.array(cols[x], t) if x in cols else pa.nulls(n, t) for x, t in types.items()], names=[*types])  # noqa: B023

            rows: list[tuple] = []
            near: list[tuple] = []
            for t in part.column("text").to_pylist():
                spans = base_spans(t)
                met, said, around = meetings(t, spans) if spans else ((), [], 0)
                rows.append((joined(spans), held_by(t, spans) if spans else [], said, around))
                for m in met:
                    near.append(m)
                    if len(near) == NEAR_AT_ONCE:
                        c, word, at, first = zip(*near, strict=True)
                        yield batch(len(near), c=c, t=word, around=at, first=first)
                        near = []
            base, held, said, around = zip(*rows, strict=True)
            yield batch(len(rows), doc_id=part.column("doc_id"), th=part.column("th"), base=base, held=held, said=said, around=around)
            if near:
                c, word, at, first = zip(*near, strict=True)
                yield batch(len(near), c=c, t=word, around=at, first=first)

    return docs.select("doc_id", "text", "th").mapInArrow(task, f"doc_id {kind}, th long, base string, held array<string>, said array<string>, around long, c string, t string, first boolean")


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """BITMAP bits in bytes, set at the hashes of the ``terms``; Spark makes it in pieces of 4 KB."""
    h = F.pmod(F.xxhash64("t"), F.lit(BITMAP))
    pieces = terms.groupBy((h / 32768).cast("int").alias("no")).agg(F.bitmap_construct_agg(h % 32768).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for no, bits in pieces:
        out[no * 4096 : (no + 1) * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n_t): over all documents, how many hold each of the candidate ``terms``, and a few others.

    Tasks have a bitmap of the candidates' hashes, of one size whatever their number, and leave out what can be none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(terms))

    def count(batches):
        for part in (p for b in batches for p in slices(b, "text", 16 << 20)):
            n: Counter = Counter()
            for t in part.column(0):
                if t.is_valid:
                    n.update({x.lower() for x in set(TERM.findall(t.as_py()))})
            h = np.array([xxhash.xxh64_intdigest(t, 42) % BITMAP for t in n], np.int64)
            can = sent.value[h >> 3] >> (h & 7) & 1
            n = {t: k for (t, k), on in zip(n.items(), can.tolist(), strict=True) if on}
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], names=["t", "n"])

    return docs.select("text").mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def together(rows: DataFrame, support: int = LEAST_SUPPORT) -> DataFrame:
    """(c, t, n_tc) of the classes and terms that meet in ``support`` different surroundings or more."""
    near = rows.where("c IS NOT NULL").groupBy("c", "t", "around").agg(F.count_if("first").alias("n"))
    rows = rows.where("base <> ''")
    near = near.groupBy("c", "t").agg(F.sum("n").alias("n_tc"), F.count("*").alias("k"))
    # kinds: a row for each term of a document, with a mark for each kind that it holds
    kinds = [ANY, *KINDS[:4]]
    said = rows.select(F.explode("said").alias("t"), "around", *[F.array_contains("held", k).cast("long").alias(k) for k in kinds])
    said = said.groupBy("t", "around").agg(*[F.sum(k).alias(k) for k in kinds])
    said = said.groupBy("t").agg(*[F.sum(k).alias(k) for k in kinds], *[F.count_if(F.col(k) > 0).alias(f"k_{k}") for k in kinds])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(k).alias("n_tc"), F.col(f"k_{k}").alias("k")) for k in kinds]))
    of_kind = said.where(f"k_{ANY} >= {int(support)}").select("t", each.alias("x")).select("x.c", "t", "x.n_tc", "x.k")
    return near.unionByName(of_kind).where(F.col("k") >= support).drop("k")


def disclosing(docs: DataFrame, rows: DataFrame, alpha: float = ALPHA, support: int = LEAST_SUPPORT) -> DataFrame:
    """(c, t, pmi, share) of the terms that disclose a class. ``rows``: from ``found``, without text."""
    pairs = cut(together(rows, support))
    if pairs.isEmpty():
        return pairs.select("c", "t", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("share"))
    n_c = cut(rows.where("base <> ''").select(F.explode("held").alias("c")).groupBy("c").agg(F.count("*").alias("n_c")))
    n_t = cut(documents_with(docs, pairs.select("t")))  # written, so that a term that many classes meet can be split below
    total = F.lit(float(rows.where("c IS NULL").count()))
    scored = join_dimension(pairs, n_c, ["c"]).join(n_t, "t").select(
        "c", "t", F.log(F.col("n_tc") * total / (F.col("n_t") * F.col("n_c"))).alias("pmi"), F.log(total / F.col("n_c")).alias("ic")
    )
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic"))).select("c", "t", "pmi", (F.col("pmi") / F.col("ic")).alias("share"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th): with a hash of the text, as ids may be missing or repeated."""
    return docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))


def told_in(docs: DataFrame, alpha: float = ALPHA, support: int = LEAST_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, th, base, held), and (c, t) of the terms that disclose a class."""
    rows = cut(found(keyed(docs)))
    return rows.where("c IS NULL").select("doc_id", "th", "base", "held"), cut(disclosing(docs, rows, alpha, support).select("c", "t"))


def said_in(df: DataFrame, most: int) -> DataFrame:
    """(doc_id, th, t): the terms of each document that holds personal data, and its compounds' runs of up to ``most`` parts."""

    def task(batches):
        for batch in batches:
            for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans, own = base_spans(t), set()
                if not spans:
                    continue
                for lo, hi in gaps(t, spans):
                    for m in TERM.finditer(t, lo, hi):
                        own.add(m[0].lower())
                        own.update(w for x in runs(t, m, most) for _, _, w in x)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), batch.schema.field(0).type), pa.array([h] * len(own), pa.int64()), pa.array(sorted(own), pa.string())], names=["doc_id", "th", "t"])

    return df.select("doc_id", "th", "text").mapInArrow(task, f"doc_id {dict(df.dtypes)['doc_id']}, th long, t string")


def marked(df: DataFrame, rows: DataFrame, told: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` (doc_id, th, text, ...) with ``base`` and ``terms``, every occurrence of the terms told for its classes; with
    ``clean`` instead with its texts cleaned of both, in the same task.

    Up to TERMS_SENT pairs go to the tasks. Beyond that, the documents' own terms are joined with the pairs, and
    those kept whose class the document holds: rows in proportion to the documents that hold personal data.
    """
    sent = told.limit(TERMS_SENT + 1).collect()
    by_class = None
    if len(sent) <= TERMS_SENT:
        by_class = defaultdict(set)
        for c, t in sent:
            by_class[c].add(t)
        by_class = dict(by_class)
    else:
        size = F.size(F.filter(F.split("t", "[-'’]"), lambda x: x != ""))
        own = said_in(df, told.agg(F.max(size)).first()[0] or 1).distinct()
        held = rows.where("base <> ''").select("doc_id", "th", F.explode("held").alias("c")).distinct()
        met = own.join(told, "t").join(held.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("c").alias("__c")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (F.col("c") == F.col("__c")))
        df = with_terms(df, cut(met.groupBy("doc_id", "th").agg(F.collect_set("t").alias("terms"))))
    keep = [c for c in df.columns if c not in ("base", "terms")]

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                own = part.column("terms").to_pylist() if by_class is None else [None] * len(texts)
                found = []
                for t, mine in zip(texts, own, strict=True):
                    spans = base_spans(t)
                    mine = set(mine or ()).union(*[by_class.get(c, ()) for c in held_by(t, spans)] if by_class and spans else [])
                    found.append((spans, occurrences(t, spans, mine) if mine else []))
                if clean:
                    new = [cleaned(t, a + b) if a or b else t for t, (a, b) in zip(texts, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else part.column(c) for c in keep], names=keep)
                    continue
                columns = [*[part.column(c) for c in keep], pa.array([joined(a) for a, _ in found], pa.string()), pa.array([joined(b) or None for _, b in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "base", "terms"])

    types = dict(df.dtypes)
    return df.mapInArrow(task, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *([] if clean else ["base string, terms string"])]))


def with_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """``df`` (doc_id, th, ...) with ``terms``; few are broadcast, more are joined by shuffling."""
    n = terms.count()
    if not n:
        return df.withColumn("terms", F.lit(None).cast("string"))
    right = terms.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "terms")
    right = F.broadcast(right) if n <= 50_000 else right
    return df.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").drop("__id", "__th")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, base, terms) of every row."""
    return marked(keyed(docs), *told_in(docs)).select("doc_id", "base", "terms")


def cleaned(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced; of overlapping spans the first, longest one names the whole."""
    out, at = [], 0
    for a, kind, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if b <= at:
            continue
        if a >= at:
            word = text[a:b]
            general = GENERAL.get(kind) or ("[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "")
            out += [text[at:a], general]
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without personal data and ``n_chars`` its new length; no other row changes."""
    columns = docs.columns
    rows, told = told_in(docs)
    th = F.coalesce(F.xxhash64("text"), F.lit(0))
    others = [c for c in columns if c not in ("text", "n_chars")]
    plain = docs.select(*[F.col(c).alias(f"__in_{c}") for c in others], "doc_id", th.alias("th"), "text")
    out = marked(plain, rows, told, clean=True)
    kept = {c: F.col(f"__in_{c}") for c in others} | {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[kept[c].alias(c) for c in columns])
