"""Stems of Portuguese words by regions, as column expressions over words in normal form, and as a function of one word.

The rules are those of the published Portuguese stemmer of the Snowball project. As the words have lost their accents before,
its endings with accents meet no word, and are not listed. R1 is what follows the first consonant behind a vowel, R2 the same within
R1; RV begins behind the third letter, or behind the vowel or consonant that follows two like first letters. An ending
goes only if it lies in the region that its rule names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import col, once

# The endings of the stemmer's rules.
NOMINAL = "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes".split()
LOGIA, AMENTE, MENTE, IDADE, IVO, IRA = ["logia", "logias"], ["amente"], ["mente"], ["idade", "idades"], ["iva", "ivo", "ivas", "ivos"], ["ira", "iras"]
VERBAL = (
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem"
    " ado ido ando endo indo ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes"
    " is ais eis areis ereis ireis ados idos emos aremos eremos iremos imos armos ermos irmos iu eu ou"
).split()
RESIDUAL = ["os", "a", "i", "o"]

R1 = "^[^aeiou]*[aeiou]+[^aeiou]"
R2 = R1 + R1[1:]
RV = "^(?:[aeiou][^aeiou]+[aeiou]|[aeiou]{2,}[^aeiou]|[^aeiou]{2,}[aeiou]|[^aeiou][aeiou].)"


def start(word: Column, region: str) -> Column:
    """How many letters stand before a region; all if it is empty."""
    head = F.regexp_extract(word, region, 0)
    return F.when(head == "", F.length(word)).otherwise(F.length(head))


def ending(word: Column, endings: list[str]) -> Column:
    """The longest of the endings that a word has, or ''."""
    return F.regexp_extract(word, f"(?:{'|'.join(endings)})$", 0)


def without(word: Column, end: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(end))


def shorter(word: Column, endings: list[str], least: Column) -> Column:
    """A word without the longest of ``endings`` if that begins behind the first ``least`` letters."""

    def rule(x: Column) -> Column:
        end = ending(x["w"], endings)
        return F.when((end != "") & (F.length(x["w"]) - F.length(end) >= x["n"]), without(x["w"], end)).otherwise(x["w"])

    return once(F.struct(word.alias("w"), least.alias("n")), rule)


def standard(word: Column, r1: Column, r2: Column, rv: Column) -> Column:
    """The word after the rules for nominal endings; itself if none applies."""
    end = ending(word, NOMINAL + LOGIA + AMENTE + MENTE + IDADE + IVO + IRA)
    left = without(word, end)
    n = F.length(left)
    amente = shorter(left, ["iv", "os", "ic", "ad"], r2)
    amente = F.when(left.endswith("iv") & (amente != left), shorter(amente, ["at"], r2)).otherwise(amente)
    return (
        F.when(end.isin(NOMINAL) & (n >= r2), left)
        .when(end.isin(LOGIA) & (n >= r2), F.concat(left, F.lit("log")))
        .when(end.isin(AMENTE) & (n >= r1), amente)
        .when(end.isin(MENTE) & (n >= r2), shorter(left, ["ante", "avel"], r2))
        .when(end.isin(IDADE) & (n >= r2), shorter(left, ["abil", "ic", "iv"], r2))
        .when(end.isin(IVO) & (n >= r2), shorter(left, ["at"], r2))
        .when(end.isin(IRA) & (n >= rv) & left.endswith("e"), F.concat(left, F.lit("ir")))
        .otherwise(word)
    )


def stem(word: Column | str) -> Column:
    """The stem of a word of letters a-z and digits."""
    word = col(word)
    marked = F.struct(word.alias("w"), start(word, R1).alias("r1"), start(word, R2).alias("r2"), start(word, RV).alias("rv"))

    def first(x: Column) -> Column:
        return F.struct(x["w"].alias("w"), x["rv"].alias("rv"), standard(x["w"], x["r1"], x["r2"], x["rv"]).alias("now"))

    def verbs(x: Column) -> Column:
        region = F.substring(x["w"], x["rv"] + 1, F.length(x["w"]))
        return F.struct(x["w"].alias("w"), x["rv"].alias("rv"), F.when(x["now"] != x["w"], x["now"]).otherwise(without(x["w"], ending(region, VERBAL))).alias("now"))

    def rest(x: Column) -> Column:
        w, now, rv = x["w"], x["now"], x["rv"]
        ci = now.endswith("ci") & (F.length(now) - 1 >= rv)
        changed = F.when(ci, without(now, F.lit("i"))).otherwise(now)
        return F.struct(rv.alias("rv"), F.when(now != w, changed).otherwise(shorter(w, RESIDUAL, rv)).alias("now"))

    def final(x: Column) -> Column:
        now, rv = x["now"], x["rv"]
        left = without(now, F.lit("e"))
        again = (left.endswith("gu") | left.endswith("ci")) & (F.length(left) - 1 >= rv)
        return F.when(now.endswith("e") & (F.length(left) >= rv), F.when(again, without(left, F.lit("i"))).otherwise(left)).otherwise(now)

    return once(once(once(once(marked, first), verbs), rest), final)


FIRST, SECOND, VERB = re.compile(R1), re.compile(R2), re.compile(RV)
#: By the ending, what it may leave behind; by an ending's kind, the endings that go as well.
ENDINGS = {e: kind for kind in (NOMINAL, LOGIA, AMENTE, MENTE, IDADE, IVO, IRA) for e in kind}
ALSO = {"mente": ["ante", "avel"]} | dict.fromkeys(IDADE, ["abil", "ic", "iv"]) | dict.fromkeys(IVO, ["at"])
VERBS, REST = dict.fromkeys(VERBAL), dict.fromkeys(RESIDUAL)
LAST = frozenset(e[-1] for e in [*ENDINGS, *VERBS, *REST, "e"])


def longest(word: str, endings: dict, start: int = 0) -> str:
    """The longest of the endings, of seven letters at most, that a word has behind its first ``start`` letters, or ''."""
    for i in range(max(start, len(word) - 7), len(word)):
        if word[i:] in endings:
            return word[i:]
    return ""


def less(word: str, endings: list[str], least: int) -> str:
    """``shorter`` of one word."""
    end = max((e for e in endings if word.endswith(e)), key=len, default="")
    return word[: len(word) - len(end)] if end and len(word) - len(end) >= least else word


def stem_of_word(word: str) -> str:
    """``stem`` of one word; where the words of many documents are counted together, each is worked off once."""
    if word[-1:] not in LAST:
        return word
    size = len(word)
    rv = m.end() if (m := VERB.match(word)) else size
    end = longest(word, ENDINGS)
    now = without_nominal(word, end, rv) if end else word
    if now == word:
        now = word[: size - len(longest(word, VERBS, rv))]
    if now == word:
        now = word[: size - len(longest(word, REST, rv))]
    elif now.endswith("ci") and len(now) - 1 >= rv:
        now = now[:-1]
    if now.endswith("e") and len(now) - 1 >= rv:
        now = now[:-1]
        if now.endswith(("gu", "ci")) and len(now) - 1 >= rv:
            now = now[:-1]
    return now


def without_nominal(word: str, end: str, rv: int) -> str:
    """``standard`` of one word with the nominal ending ``end``."""
    left, kind = word[: -len(end)], ENDINGS[end]
    if kind is IRA:
        return f"{left}ir" if len(left) >= rv and left.endswith("e") else word
    region = lambda r: m.end() if (m := r.match(word)) else len(word)
    r2 = region(SECOND)
    if len(left) < (region(FIRST) if kind is AMENTE else r2):
        return word
    if kind is LOGIA:
        return f"{left}log"
    if kind is AMENTE:
        now = less(left, ["iv", "os", "ic", "ad"], r2)
        return less(now, ["at"], r2) if now != left and left.endswith("iv") else now
    return less(left, ALSO.get(end, []), r2)


def stems_of(spark: SparkSession, words: list[str], left_out: frozenset[str] = frozenset()) -> list[str]:
    """The stems of a query's few words, without those left out, each once, by the same expressions."""
    words = [w for w in dict.fromkeys(words) if w not in left_out]
    if not words:
        return []
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", stem("w").alias("s")).orderBy("i").collect()
    return list(dict.fromkeys(r["s"] for r in rows))
