"""Text functions as pure column expressions: normal forms, cleaning with counts, identifiers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The small letters from U+00DF to U+017F whose canonical decomposition begins with a letter a-z, and those letters; behind
#: them the combining marks U+0300 to U+036F, which become nothing. Letters that don't decompose (ł, ø, ß) stay.
ACCENTED = "".join(c for c in map(chr, range(0xDF, 0x180)) if c.islower() and unicodedata.decomposition(c) and unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz")
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
MARKS = "".join(map(chr, range(0x300, 0x370)))

# Kinds of legal acts that announce a number.
ACTS = "Lei|Leis|Decreto|Decreto-Lei|Decreto-lei|Súmula|Portaria|Resolução|Emenda|Ato|Projeto|Provimento|Medida Provisória"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(x: Column | str) -> Column:
    """Lower case without accents, for comparing; ligatures and ordinal signs stay."""
    small = F.lower(col(x))
    plain_already = F.octet_length(small) == F.length(small)  # one byte for each character: nothing to look up
    return F.when(plain_already, small).otherwise(F.translate(small, ACCENTED + MARKS, PLAIN))


def plain(x: str) -> str:
    """The same for a Python string, such as a query."""
    return x.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))


def norm_all(xs: Column | str) -> Column:
    """Every element in normal form, as an index over an array needs it."""
    return F.transform(col(xs), norm)


def joined(xs: Column | str, sep: str = " ") -> Column:
    """The elements in one text, '' for none."""
    return F.coalesce(F.array_join(col(xs), sep), F.lit(""))


def lexemes(x: Column | str) -> Column:
    """The words of a text, in order: runs of letters a-z and digits of its normal form."""
    return F.filter(F.split(norm(x), "[^a-z0-9]+"), lambda w: w != "")


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(norm(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sha256(x: Column | str) -> Column:
    return F.sha2(col(x).cast("binary"), 256)


#: White space that isn't a single space.
SPACES = " [ \\t\\r\\n\\x0B\\f\\u00A0]+|[\\t\\r\\n\\x0B\\f\\u00A0][ \\t\\r\\n\\x0B\\f\\u00A0]*"


def collapsed(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), SPACES, " "))


# --- cleaning: each step gives the new text and how many places it changed ------------------------

# The sign of an ordinal behind its digits; an o is one only if it is glued to them and begins no word.
SIGN = "(?:\\s*[º°]|o(?!\\p{Ll}))?"
# Where a small o, or a degree sign, stands for an ordinal sign.
ORDINAL_STEPS = [
    ("([0-9])[o°](?![a-zà-ÿ])", "$1º"),
    (f"(?U)\\b({ACTS})(\\s+)n[o°](?=\\s*[0-9])", "$1$2nº"),
    ("(?U)\\bn[o°](?=\\s+[0-9]{1,3}(?:\\.[0-9]{3}){1,2}(?!\\.?[0-9]))", "nº"),
]


def ordinals(x: Column | str) -> tuple[Column, Column]:
    """Ordinal signs where a letter o stands for one: after a digit, after the name of an act and
    before a number, and before a number with one or two thousands points; four groups of digits are an address."""
    text, n = col(x), F.lit(0)
    for pattern, to in ORDINAL_STEPS:
        n = n + F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        text = F.regexp_replace(text, pattern, to)
    return text, n


# A footnote's number behind the last mark; the title, or the division in capitals, behind the last sentence.
FOOTNOTE = "([a-zà-ÿA-ZÀ-Ý)\\]\"'»])([.;:!?])([0-9]{1,2})$"


def without_footnote(x: Column | str) -> tuple[Column, Column]:
    """A footnote mark, one or two digits glued to the last punctuation, goes."""
    t = F.rtrim(col(x))
    end = F.substring(t, -5, 5)  # longer than any that the pattern meets
    has = end.rlike(FOOTNOTE)
    without = F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(end)), F.regexp_replace(end, FOOTNOTE, "$1$2"))
    return F.when(has, without).otherwise(col(x)), has.cast("int")


TRAILING_TITLE = "(?<=[.;:!?)»”\"'][0-9]{0,2})\\s+([A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ][^.;:!?]{2,130})$"
TRAILING_DIVISION = "(?<=[.;:!?)»”\"'])\\s+([A-ZÀ-Ý][A-ZÀ-Ý\\s]{4,44})$"


def title_objections(title: Column) -> Column:
    """Why a fragment is no title: the names of all reasons, in alphabetical order."""
    reasons = {
        "capitals": title == F.upper(title),
        "cut short": title.rlike("[,;:]$"),
        "note": title.rlike("[(\\[]"),
        "reference": title.rlike("(?i)(?<![\\p{L}\\p{N}_])(arts?|incs?)\\s*\\.?\\s*[0-9]|§|\\bn[ºo]\\s*[0-9]|[0-9]{3,}"),
        "sanction": title.rlike("\\bPena\\s*[–—-]"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))


def marginal_title(x: Column | str) -> tuple[Column, Column, Column]:
    """(text without it, title, objections): a capitalised fragment after the last sentence is the next block's
    title, unless something speaks against it; then the text stays whole."""
    t = F.rtrim(col(x))
    found = F.nullif(F.trim(F.regexp_extract(t, TRAILING_TITLE, 1)), F.lit(""))
    against = F.coalesce(title_objections(found), F.array().cast("array<string>"))
    taken = found.isNotNull() & (F.size(against) == 0)
    return F.when(taken, F.rtrim(F.regexp_replace(t, TRAILING_TITLE, ""))).otherwise(col(x)), F.when(taken, found), against


def trailing_division(x: Column | str) -> tuple[Column, Column]:
    """(text without it, fragment): an all-capitals division name that leaked into the text's end."""
    t = F.rtrim(col(x))
    found = F.trim(F.regexp_extract(t, TRAILING_DIVISION, 1))
    return F.when(found == "", col(x)).otherwise(F.rtrim(F.regexp_replace(t, TRAILING_DIVISION, ""))), F.nullif(found, F.lit(""))


def is_revoked(x: Column | str) -> Column:
    return col(x).rlike("(?i)^\\(?\\s*\\(?\\s*(revogad|vetad)")


def suspicions(x: Column | str) -> Column:
    """Which doubts a block raises: it begins in lower case, or ends without punctuation."""
    t = F.trim(col(x))
    return F.array_compact(F.array(F.when(t.rlike("^[a-zà-ÿ]"), "lower-case start"), F.when(~t.rlike("[.;:!?)»”\"']\\z"), "no final mark")))


# How a division is announced, and the words (in normal form) that a title in capitals leaves small.
HEADING = "^(TÍTULO|CAPÍTULO|SEÇÃO|SUBSEÇÃO)\\s+([IVXLC]+(?:-[A-Z])?|[0-9]+)\\s*[–—-]\\s*(.+)$"
CONNECTIVES = "de da do das dos e ou a o as os ao aos em no na nos nas num numa contra para por pelo pela pelos pelas sobre com sem entre que se ante desde perante sob".split()
LONGEST_TITLE = 140


def heading_split(x: Column | str) -> Column:
    """struct(heading, title, rule): a division's name and the title of its first block, run together.

    Only 'DIVISION numeral – name' is cut. A name has capitals but in connectives, so the first other small word
    belongs to the title, which begins at the last capital before it (rule ``sentence-case``). A name that
    repeats one of its words at its end has that word as title (``repetition``). All else is left whole,
    ``uncut``, for a person to look at.
    """
    whole = col(x)
    form = F.trim(whole).rlike(HEADING)
    head = F.concat(F.regexp_extract(F.trim(whole), HEADING, 1), F.lit(" "), F.regexp_extract(F.trim(whole), HEADING, 2), F.lit(" – "))
    words = F.split(F.regexp_extract(F.trim(whole), HEADING, 3), "\\s+")
    each = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.rlike("^[A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ]").alias("capital"), norm(F.regexp_replace(w, "[^\\p{L}]", "")).isin(CONNECTIVES).alias("small")))
    first = F.array_min(F.transform(F.filter(each, lambda w: (w["i"] > 0) & ~w["capital"] & ~w["small"]), lambda w: w["i"]))
    begin = F.array_max(F.transform(F.filter(each, lambda w: (w["i"] < first) & ~w["small"]), lambda w: w["i"]))
    from_word = lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), " ")
    by_case = F.coalesce(form & (begin > 0) & (F.length(from_word(F.coalesce(begin, F.lit(0)))) <= LONGEST_TITLE), F.lit(False))
    last = F.element_at(each, -1)
    earlier = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), norm)
    again = form & (F.size(words) > 1) & last["capital"] & ~last["small"] & F.array_contains(earlier, norm(F.element_at(words, -1)))
    at = F.when(by_case, begin).when(again, F.size(words) - 1)
    cut = F.struct(
        F.concat(head, F.array_join(F.slice(words, F.lit(1), at), " ")).alias("heading"), from_word(at).alias("title"), F.when(by_case, "sentence-case").otherwise("repetition").alias("rule")
    )
    return F.when(at.isNotNull(), cut).otherwise(F.struct(whole.alias("heading"), F.lit(None).cast("string").alias("title"), F.lit("uncut").alias("rule")))


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(x: Column | str) -> Column:
    """The number that a Roman numeral writes; null where a letter isn't one."""
    pairs = [y for k, v in ROMAN.items() for y in (F.lit(k), F.lit(v))]
    values = F.transform(F.filter(F.split(F.upper(F.trim(col(x))), ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*pairs), c))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, v: F.struct((s["sum"] + v - F.when(v > s["last"], 2 * s["last"]).otherwise(0)).alias("sum"), v.alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.exists(values, lambda v: v.isNull()) | (F.size(values) == 0), None).otherwise(total)


def article_number(x: Column | str) -> Column:
    """struct(base, suffix) of '7', '7-A' or '359-M-B'; null where the form is another."""
    t = F.trim(col(x))
    ok = t.rlike("^[0-9]+(-[A-Za-z]+)*$")
    base = F.regexp_extract(t, "^([0-9]+)", 1).try_cast("int")
    return F.when(ok, F.struct(base.alias("base"), F.upper(F.nullif(F.regexp_extract(t, "^[0-9]+-(.+)$", 1), F.lit(""))).alias("suffix")))


def article_of(x: Column | str) -> Column:
    """The id of the article that a block's id stands under: up to _artN or _artN-a."""
    found = F.regexp_extract(col(x), "(?i)^(.*_art[0-9]+(?:-[a-z])?)", 1)
    return F.when(found == "", col(x)).otherwise(found)


def paragraph(x: Column | str) -> Column:
    """struct(number, suffix, label) of '§ 1º' or 'Parágrafo único'."""
    only = norm(x).rlike("paragrafo unico|§ unico")
    n = F.regexp_extract(col(x), "§\\s*([0-9]+)", 1)
    tail = F.regexp_extract(col(x), "§\\s*[0-9]+\\s*[ºo°]?\\s*(-[A-Z])", 1)
    number = F.when(only, "único").otherwise(F.concat(n, tail))
    suffix = F.when(only, "pu").otherwise(F.concat(F.lit("p"), F.lower(F.concat(n, tail))))
    label = F.when(only, "Parágrafo único").otherwise(F.concat(F.lit("§ "), n, F.when(n.try_cast("int") < 10, "º").otherwise(""), tail))
    return F.when(only | (n != ""), F.struct(number.alias("number"), suffix.alias("suffix"), label.alias("label")))


def without_marker(x: Column | str, kind: Column | str) -> Column:
    """A block's text without the sign that its kind begins with."""
    t, k = F.trim(col(x)), col(kind)
    return (
        F.when(k == "paragrafo", F.regexp_replace(t, f"^(§\\s*[0-9]+{SIGN}(-[A-Z])?\\.?|Parágrafo único\\.?)\\s*[-–—]?\\s*", ""))
        .when(k == "inciso", F.regexp_replace(t, "^[IVXLCDM]+\\s*[-–—]\\s*", ""))
        .when(k == "alinea", F.regexp_replace(t, "^[a-z]\\)\\s*", ""))
        .otherwise(F.regexp_replace(t, f"^Art\\.?\\s*[0-9]+{SIGN}(-[A-Z])?\\.?\\s*[-–—]?\\s*", ""))
    )


def ordinal(number: Column | str) -> Column:
    """Articles from one to nine have an ordinal, with or without a letter; other forms stay."""
    t = col(number).cast("string")
    return F.when(t.rlike("^[1-9](-[A-Za-z])?$"), F.regexp_replace(t, "^([1-9])", "$1º")).otherwise(t)


def citation(number: Column | str, chain: Column, law: Column | str) -> Column:
    """'art. 33, § 4º, I, a, da Lei nº 11.343/2006'; without a chain 'art. 33 da Lei nº 11.343/2006'."""
    head = F.concat(F.lit("art. "), ordinal(number))
    parts = F.filter(F.coalesce(chain, F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    return F.when(F.size(parts) > 0, F.concat_ws(", ", F.concat(F.array(head), parts, F.array(col(law))))).otherwise(F.concat_ws(" ", head, col(law)))


def embedding_text(heading: Column, title: Column, caput: Column, text: Column) -> Column:
    """What is embedded and hashed: the most specific heading, the title, the caput and the text, a line each. A
    model's limit is the embedder's matter, so that a change anywhere changes the hash."""
    return F.concat_ws("\n", heading, title, caput, text)


def difference(a: Column | str, b: Column | str) -> Column:
    """struct(prefix, old, new, suffix): the longest common beginning and end of two texts, and what
    stands between them. The texts' bytes are halved and compared, so that no character has a value of its own."""

    def parts(x: Column) -> Column:
        head = F.length(F.substring(x["p"], F.lit(1), whole(x["p"], shared(x["p"], x["q"], False))).cast("string"))
        tail = F.length(behind(x["p"], shared(x["p"], x["q"], True)).cast("string"))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), head.alias("head"), F.least(tail, F.least(F.length(x["a"]), F.length(x["b"])) - head).alias("tail"))

    def cut(x: Column) -> Column:
        a, b, head, tail = (x[c] for c in ("a", "b", "head", "tail"))
        return F.struct(
            F.substring(a, F.lit(1), head).alias("prefix"),
            F.substring(a, head + 1, F.length(a) - head - tail).alias("old"),
            F.substring(b, head + 1, F.length(b) - head - tail).alias("new"),
            F.substring(a, F.length(a) - tail + 1, tail).alias("suffix"),
        )

    both = F.struct(col(a).alias("a"), col(b).alias("b"))
    return once(once(once(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(x["b"].isNotNull(), x["a"].cast("binary")).alias("p"), x["b"].cast("binary").alias("q"))), parts), cut)


def shared(p: Column, q: Column, back: bool) -> Column:
    """How many bytes two binaries have in common from their start, or ``back`` from their end: what is held to be equal grows by halves of what may be."""
    size = lambda x: F.octet_length(x)
    at = lambda x, n, step: F.substring(x, size(x) - n - step + 1 if back else n + 1, step)
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    longer = lambda n, step: F.when((step <= F.least(size(p), size(q)) - n) & (at(p, n, step) == at(q, n, step)), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), longer)


def whole(p: Column, n: Column) -> Column:
    """The bytes that the whole characters among the first ``n`` take up."""
    inside = lambda i: F.hex(F.substring(p, i + 1, F.lit(1))).between("80", "BF")  # noqa: E731  a byte that continues a character
    return once(n, lambda n: F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3))


def behind(p: Column, n: Column) -> Column:
    """The whole characters among the last ``n`` bytes."""
    last = once(n, lambda n: F.substring(p, F.octet_length(p) - n + 1, n))
    inside = lambda x, i: F.hex(F.substring(x, i, 1)).between("80", "BF")
    rest = lambda x, i: F.substring(x, F.lit(i), F.octet_length(x))
    return once(last, lambda x: F.when(~inside(x, 1), x).when(~inside(x, 2), rest(x, 2)).when(~inside(x, 3), rest(x, 3)).otherwise(rest(x, 4)))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` where ``x`` is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Every letter with one combining mark U+0300 to U+036F that has a character of its own, and that character.
PAIRS = {d: c for c in map(chr, range(0xC0, 0x2000)) if len(d := "".join(chr(int(h, 16)) for h in unicodedata.decomposition(c).split() if "<" not in h)) == 2 and d[1] in MARKS and unicodedata.normalize("NFC", d) == c}
#: Marks on one letter that are composed, at most.
MOST_MARKS = 3


def composed(x: Column | str) -> Column:
    """A text whose letters with combining marks are single characters, where there are such (as in Unicode's form C). Texts without
    a mark, nearly all, are only looked through."""
    table = F.map_from_arrays(F.lit([*PAIRS]), F.lit([*PAIRS.values()]))
    marks = f"[{MARKS[0]}-{MARKS[-1]}]"

    def compose(piece: Column) -> Column:
        for _ in range(MOST_MARKS):  # the letter before the first mark, and that mark

            def step(p: Column) -> Column:
                at = F.regexp_instr(p, F.lit(marks))
                to = F.element_at(table, F.substring(p, at - 1, F.lit(2)))
                return F.when((at > 1) & to.isNotNull(), F.concat(F.substring(p, F.lit(1), at - 2), to, F.substring(p, at + 1, F.length(p)))).otherwise(p)

            piece = once(piece, step)
        return piece

    t = col(x)
    pieces = F.split(t, f"(?<={marks})(?!{marks})")
    return F.when(t.rlike(marks), F.array_join(F.transform(pieces, compose), "")).otherwise(t)


# Characters that a source and its copy write differently.
SIGNS, ONE_SIGN = "–—‒−“”„«»‘’´`", "-" * 4 + '"' * 5 + "'" * 4


def canonical(x: Column | str) -> Column:
    """A text as it is compared with its source: composed letters, one form of dashes, quotes, ordinals and spaces, no
    footnote, one word for blocks that are vetoed or revoked. What a step uses more than once is computed once before it."""
    t = F.translate(composed(x), SIGNS, ONE_SIGN)
    for pattern, to in ORDINAL_STEPS:
        t = F.regexp_replace(t, pattern, to)
    t = once(t, lambda y: without_footnote(y)[0])
    t = F.translate(t, "°", "º")
    t = once(t, lambda y: F.when(y.rlike("(?i)^\\(?\\s*vetado"), "(vetado)").when(y.rlike("(?i)^\\(?\\s*revogad"), "(revogado)").otherwise(y))
    return F.lower(collapsed(t))


# --- identifiers of people -------------------------------------------------------------------


def digits(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "[^0-9]", "")


def cpf_valid(x: Column | str) -> Column:
    """Eleven digits, not all the same, whose last two check the others."""
    d = digits(x)

    def check(n: int) -> Column:
        total = sum(F.substring(d, i + 1, 1).try_cast("int") * (n + 1 - i) for i in range(n))
        rest = (total * 10) % 11
        return F.when(rest == 10, 0).otherwise(rest) == F.substring(d, n + 1, 1).try_cast("int")

    return F.coalesce((F.length(d) == 11) & ~d.rlike("^(.)\\1{10}$") & check(9) & check(10), F.lit(False))


def cpf_masked(x: Column | str) -> Column:
    return F.regexp_replace(F.substring(digits(x), 1, 11), "^([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})$", "$1.$2.$3-$4")


def initials(x: Column | str) -> Column:
    """First letters of the first and last word."""
    w = F.filter(F.split(F.trim(col(x)), "\\s+"), lambda s: s != "")
    one = lambda s: F.upper(F.substring(s, 1, 1))
    return F.when(F.size(w) == 0, "").when(F.size(w) == 1, one(F.get(w, F.lit(0)))).otherwise(F.concat(one(F.get(w, F.lit(0))), one(F.try_element_at(w, F.lit(-1)))))


def short_title(x: Column | str, most: int = 60) -> Column:
    """A title of at most ``most`` characters, cut at a word's end if that keeps three fifths of it."""
    t = collapsed(x)
    head = F.substring(t, 1, most)
    at_word = F.regexp_replace(head, "\\s+\\S*$", "")
    cut = F.when(F.length(at_word) >= int(most * 0.6), at_word).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))
