"""How values are shown, and which drafts may be saved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, cpf_valid, digits

# Statuses of a precedent that need a second look, and the feminine of a version's name.
CARE = "(?i)^(cancelad|sobrestad|suspens|revisad|em julgamento|afetad)"
FEMININE = {"compilado": "compilada", "alterado": "alterada"}
MISSING = "—"


def date_br(x: Column | str) -> Column:
    """dd/mm/yyyy; a dash for none."""
    return F.coalesce(F.date_format(F.try_to_date(F.substring(col(x).cast("string"), 1, 10), "yyyy-MM-dd"), "dd/MM/yyyy"), F.lit(MISSING))


def number_br(x: Column | str) -> Column:
    """Whole thousands by points, three decimals at most behind a comma; a dash for none."""
    plain = F.regexp_replace(F.format_number(col(x).cast("double"), 3), "\\.?0+$", "")
    return F.coalesce(F.when(col(x).isNotNull() & ~F.isnan(col(x).cast("double")), F.translate(plain, ",.", ".,")), F.lit(MISSING))


def article_title(number: Column | str) -> Column:
    """'Art. 33', 'Art. 7º-A'."""
    base = F.regexp_extract(col(number), "^([0-9]+)", 1).try_cast("int")
    return F.concat(F.lit("Art. "), F.when(base.between(1, 9), F.regexp_replace(col(number), "^([0-9])", "$1º")).otherwise(col(number)))


def published(day: Column | str, year: Column | str) -> Column:
    """struct(text, differs): the day as the source gives it, and whether its year isn't the act's."""
    return F.struct(date_br(day).alias("text"), (F.substring(col(day).cast("string"), 1, 4).try_cast("int") != col(year)).alias("differs"))


def version_name(x: Column | str) -> Column:
    return F.coalesce(*[F.when(col(x) == a, F.lit(b)) for a, b in FEMININE.items()], col(x))


def needs_care(status: Column | str) -> Column:
    return F.coalesce(F.ltrim(col(status)).rlike(CARE), F.lit(False))


def first_objection(name: str = "name", cpf: str = "cpf", phone: str = "phone", email: str = "email", note: str = "note") -> Column:
    """struct(field, message) of the first field of a draft that can't be saved; null if it can."""
    text = lambda c: F.coalesce(F.trim(col(c)), F.lit(""))
    number = digits(F.coalesce(col(cpf), F.lit("")))
    rules = [
        (name, text(name) == "", "the name is missing"),
        (name, F.length(text(name)) > 120, "the name has over 120 characters"),
        (cpf, (number != "") & (F.length(number) != 11), "the number must have 11 digits"),
        (cpf, (number != "") & ~cpf_valid(number), "the check digits don't fit"),
        (phone, (text(phone) != "") & ~F.length(text(phone)).between(8, 24), "the phone number must have 8 to 24 characters"),
        (email, (text(email) != "") & ~text(email).rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), "this is no e-mail address"),
        (note, F.length(F.coalesce(col(note), F.lit(""))) > 2000, "the note has over 2000 characters"),
    ]
    return F.coalesce(*[F.when(broken, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, broken, m in rules])
