"""The three-phase calculation of a sentence, and facts read from a question, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatlas.functions.text import col, norm, once

# For each crime its months and fine days, least and most, whether the ninth vector
# counts (twice), and the causes that it admits.
CRIMES = {
    "lei_11343_2006_art33": (60, 180, 500, 1500, True, ["privilegiado", "proximidade", "tentativa"]),
    "lei_11343_2006_art34": (36, 120, 1200, 2000, True, ["proximidade", "tentativa"]),
    "lei_11343_2006_art35": (36, 120, 700, 1200, True, ["proximidade", "tentativa"]),
    "lei_11343_2006_art36": (96, 240, 1500, 4000, True, ["proximidade", "tentativa"]),
    "lei_11343_2006_art37": (24, 72, 300, 700, True, ["proximidade", "tentativa"]),
    "dl_2848_1940_art155": (12, 72, 10, 360, False, ["repousoNoturno", "furtoPrivilegiado", "tentativa"]),
    "dl_2848_1940_art157": (72, 120, 10, 360, False, ["concurso", "armaDeFogo", "tentativa"]),
    "dl_2848_1940_art217-a": (120, 216, 10, 360, False, ["tentativa"]),
}
# Factors of the causes; increases are applied before decreases.
INCREASES = {"proximidade": (7, 6), "concurso": (4, 3), "armaDeFogo": (5, 3), "repousoNoturno": (3, 2)}
DECREASES = {"privilegiado": (1, 3), "furtoPrivilegiado": (1, 3), "tentativa": (2, 3)}
CLOSED, SEMI_OPEN, NINTH = 96, 48, 8


def of_crime(crime: Column | str, field: int) -> Column:
    return F.coalesce(*[F.when(col(crime) == k, F.lit(v[field])) for k, v in CRIMES.items()])


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5 + 1e-9).cast("int")


def sentence(crime: Column | str, vectors: Column | str, aggravating: Column | str, causes: Column | str) -> Column:
    """struct of the phases. ``vectors``: array of 'fav', 'neutra' or 'desf'; ``aggravating`` and ``causes``:
    arrays of the names that hold. Only unfavourable vectors count; mitigation stops at the least
    sentence, causes of decrease don't; what a crime doesn't admit is ignored."""
    low, high = of_crime(crime, 0).cast("double"), of_crime(crime, 1).cast("double")
    fine_low, fine_high, ninth = of_crime(crime, 2), of_crime(crime, 3), of_crime(crime, 4)
    weight_at = lambda i: F.when(i != NINTH, 1).when(ninth, 2).otherwise(0)
    counted = F.filter(F.transform(col(vectors), lambda v, i: F.when(v == "desf", weight_at(i)).otherwise(0)), lambda n: n > 0)
    weight = F.aggregate(counted, F.lit(0), lambda s, n: s + n)
    base = F.least(high, low + weight * (high - low) / 8)
    has = lambda name: F.array_contains(col(aggravating), name)
    # each step names the one before once: an expression that names it twice would double at every step
    second = base * F.when(has("reincidencia"), 7.0).otherwise(6.0) / 6
    for name in ("menoridade", "confissao"):
        second = F.greatest(F.when(has(name), low).otherwise(0.0), second * F.when(has(name), 5.0).otherwise(6.0) / 6)
    second = F.least(high, second)
    third = second
    for name, (up, down) in (INCREASES | DECREASES).items():
        admits = col(crime).isin([k for k, v in CRIMES.items() if name in v[5]])
        third = third * F.when(admits & F.array_contains(col(causes), name), float(up)).otherwise(float(down)) / down
    months = rounded(third)
    regime = F.when(months > CLOSED, "fechado").when(months > SEMI_OPEN, "semiaberto").otherwise("aberto")
    fine = rounded(F.least(fine_high, fine_low + weight * (fine_high - fine_low) / 8))
    return F.struct(
        F.size(counted).alias("negativos"), weight.alias("peso"), F.round(base, 6).alias("base"), F.round(second, 6).alias("provisoria"),
        months.alias("definitiva"), fine.alias("multa"), (months < low).alias("abaixo"), regime.alias("regime"),
    )


def months_text(months: Column) -> Column:
    """'5 anos e 2 meses'."""
    y, m = F.floor(months / 12).cast("int"), (months % 12).cast("int")
    part = lambda n, one, many: F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))
    text = F.concat_ws(" e ", part(y, "ano", "anos"), part(m, "mês", "meses"))
    return F.when(text == "", "0 meses").otherwise(text)


def memorial(citation: Column, s: Column) -> Column:
    return F.format_string(
        "%s: pena-base %s; provisória %s; definitiva %s, %d dias-multa, regime %s.",
        citation, months_text(F.round(s["base"])), months_text(F.round(s["provisoria"])), months_text(s["definitiva"]), s["multa"], s["regime"],
    )


# --- facts in a question -----------------------------------------------------------------------

#: A word of negation in this many characters before a term takes it away.
NEAR = 40
NEGATED = "\\b(nao|nem|sem|nunca|jamais|tampouco)\\b[^.;]*$"
# What names a crime, the first that matches decides; no id: not one of these.
CRIME_WORDS = [
    ("latrocinio|roubo seguido de morte", ""),
    ("estupro de vulner|vulneravel|217[- ]?a\\b|menor de 14|menor de catorze", "dl_2848_1940_art217-a"),
    ("\\broubo|roubar|roubad|assalt", "dl_2848_1940_art157"),
    ("\\bfurto|furtar|furtad", "dl_2848_1940_art155"),
    ("\\bassociac|associar-se|art\\.? ?35\\b", "lei_11343_2006_art35"),
    ("financia|custei|art\\.? ?36\\b", "lei_11343_2006_art36"),
    ("informante|olheiro|fogueteir|art\\.? ?37\\b", "lei_11343_2006_art37"),
    ("maquinari|petrech|apetrech|art\\.? ?34\\b", "lei_11343_2006_art34"),
    ("\\btrafic|traficant|entorpecent|\\bdrogas?\\b|11\\.? ?343|maconha|cocaina|\\bcrack\\b|33,? ?§ ?4|\\bprivilegiad|minorante|\\bkg\\b|\\bquilos?\\b|\\bgramas?\\b|porc(ao|oes)|trouxinha", "lei_11343_2006_art33"),
]
FACT_WORDS = [
    ("privilegiado", "\\bprivilegiad|33,? ?§ ?4|minorante"), ("reincidencia", "\\breincid"), ("confissao", "\\bconfess|confiss"),
    ("menoridade", "menor de 21|menoridade"), ("proximidade", "perto de escola|proxim\\w+ (a|de|da) escola|estabelecimento de ensino"),
    ("tentativa", "\\btentativa|\\btentou|\\btentad"), ("concurso", "concurso de (agentes|pessoas)|comparsa|dois agentes"),
    ("armaDeFogo", "arma de fogo|\\brevolver|\\bpistola"), ("repousoNoturno", "repouso noturno|de madrugada"),
]
EXPRESSIVE = 1000


def stated(q: Column, pattern: str) -> Column:
    """A term stands in a normalised question and isn't negated just before."""
    at = F.regexp_instr(q, F.lit(pattern))
    before = F.substring(q, F.greatest(at - NEAR, F.lit(1)), F.least(at - 1, F.lit(NEAR)))
    return (at > 0) & ~F.coalesce(before.rlike(NEGATED), F.lit(False))


def crime_in(question: Column | str) -> Column:
    """The crime a question is about; null for none, for consumption, and for crimes that aren't computed."""
    return once(norm(question), crime_of)


def crime_of(q: Column) -> Column:
    """``crime_in`` of a question in normal form."""
    found = F.coalesce(*[F.when(stated(q, p), F.lit(k)) for p, k in CRIME_WORDS])
    consumption = q.rlike("consumo pessoal|uso proprio|porte para consumo|art\\.? ?28\\b") & ~q.rlike("\\btrafic")
    return F.when(~consumption, once(found, lambda x: F.nullif(x, F.lit(""))))


def grams_in(question: Column | str) -> Column:
    """The largest quantity that a text states, in grams; null without any."""
    pattern = "([0-9]+(?:[.,][0-9]+)?)\\s*(kg\\b|quilos?\\b|gramas?\\b|g\\b)"
    found = F.regexp_extract_all(F.lower(col(question)), F.lit(pattern), F.lit(0))
    number = lambda x: F.replace(F.regexp_extract(x, pattern, 1), F.lit(","), F.lit(".")).cast("double")
    return F.array_max(F.transform(found, lambda x: number(x) * F.when(F.regexp_extract(x, pattern, 2).rlike("^(kg|quilo)"), 1000).otherwise(1)))


def facts_in(question: Column | str) -> Column:
    """The facts a question states, sorted; causes that its crime doesn't admit are left out, and no
    one is both a repeat offender and privileged."""
    return read_from(question)["facts"]


def read_from(question: Column | str) -> Column:
    """struct(crime, facts, grams) as ``crime_in``, ``facts_in`` and ``grams_in`` give them. What several of them need is computed once for a question."""
    text = F.struct(norm(question).alias("q"), grams_in(question).alias("grams"))
    crime = lambda x: F.struct(x["q"].alias("q"), x["grams"].alias("grams"), crime_of(x["q"]).alias("crime"))
    return once(once(text, crime), lambda x: F.struct(x["crime"].alias("crime"), facts_of(x["q"], F.coalesce(x["crime"], F.lit(next(iter(CRIMES)))), x["grams"]).alias("facts"), x["grams"].alias("grams")))


def facts_of(q: Column, crime: Column, grams: Column) -> Column:
    """The facts of a question in normal form, for a crime and a quantity."""
    found = []
    for name, pattern in FACT_WORDS:
        ok = stated(q, pattern)
        if name in INCREASES or name in DECREASES:
            ok = crime.isin([k for k, v in CRIMES.items() if name in v[5]]) & ok
        if name == "privilegiado":
            ok = ok & ~stated(q, dict(FACT_WORDS)["reincidencia"])
        found.append(F.when(ok, F.lit(name)))
    drugs = crime.isin([k for k, v in CRIMES.items() if v[4]])
    found.append(F.when(drugs & (F.coalesce(grams, F.lit(0.0)) >= EXPRESSIVE), F.lit("quantidade expressiva")))
    return F.array_sort(F.array_compact(F.array(*found)))
