"""What a question asks for: rules over its normal form, in order; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatlas.functions.text import col, norm

# Words that mark a question as one on doctrine or on procedure, and names of laws.
DOCTRINE = ["doutrina", "doutrinari", "nucci", "greco", "bitencourt", "masson", "segundo o autor"]
PROCEDURE = ["resposta a acusacao", "defesa previa", "absolvicao sumaria", "audiencia de instrucao", "alegacoes finais", "nulidade", "citacao",
             "recebimento da denuncia", "rejeicao da denuncia", "busca e apreensao", "flagrante", "prazo para", "rito"]
LAWS = [
    ("\\b11\\.?343\\b|\\blei de drogas\\b|\\blei antidrogas\\b", "lei_11343_2006"),
    ("\\bc\\.?\\s?p\\.?\\b|\\bcodigo penal\\b|\\b2\\.?848\\b", "dl_2848_1940"),
    ("\\bcpp\\b|\\bcodigo de processo penal\\b|\\b3\\.?689\\b", "dl_3689_1941"),
]
ARTICLE = "\\bart(?:igo)?s?\\.?\\s*([0-9]+(?:\\s*-\\s*[a-z])?)"
STATE = ["parana", "legislacao estadual", "norma estadual", "decreto estadual", "governo do estado", "casa civil", "executivo estadual"]
UNIFORM = "\\b(decretos?|estaduais?|estadual|parana|paranaense|governo do estado|casa civil|executivo estadual|legislacao|norma)\\b"
# How a summary begins, and the kind of act that it names.
SPECIES = [
    ("^regulamenta", "Regulamenta"), ("^(institui|cria|fica instituido)", "Institui"),
    ("^(altera|introduz altera|acrescenta|atualiza|reajusta|prorroga)", "Altera"), ("^aprova", "Aprova"), ("^revoga", "Revoga"),
    ("^homologa situacao", "Emergência"), ("^declara", "Declara"),
]


def any_of(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def first_case(x: Column, cases: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first pattern that matches."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(v)) for p, v in cases], F.lit(otherwise))


def classified(question: Column | str, exact_term: Column | None = None) -> Column:
    """struct(kind, article, law): doctrine, an article's address, procedure or open; an exact hit on a curated term
    makes it a theme, except for doctrine."""
    q = norm(F.trim(col(question)))
    article = F.nullif(F.upper(F.regexp_replace(F.regexp_extract(q, ARTICLE, 1), "\\s+", "")), F.lit(""))
    kind = (
        F.when(any_of(q, DOCTRINE), "doutrina").when(article.isNotNull(), "dispositivo")
        .when(any_of(q, PROCEDURE) | q.rlike("\\bcpp\\b"), "processual").otherwise("aberta")
    )
    if exact_term is not None:
        kind = F.when(exact_term.isNotNull() & (kind != "doutrina"), "tema").otherwise(kind)
    law = first_case(q, LAWS)
    asked = kind == "dispositivo"
    return F.struct(kind.alias("kind"), F.when(asked, article).alias("article"), F.when(asked, law).alias("law"))


def wants_state_acts(question: Column | str) -> Column:
    q = norm(F.trim(col(question)))
    return q.rlike("\\bdecretos?\\b(?!\\s*-?\\s*lei)") | any_of(q, STATE)


def act_query(question: Column | str) -> Column:
    """The question without words that every act of that collection has; whole if too little is left."""
    q = norm(question)
    left = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(q, UNIFORM, " "), "[?!.,;:]", " "), "\\s+", " "))
    return F.when(F.length(left) >= 6, left).otherwise(F.trim(q))


def species(summary: Column | str) -> Column:
    return first_case(norm(summary), SPECIES, "Dispõe")
