"""Readers of landed files, all with declared schemas, and what flattens them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.functions.blocks import block
from verbatlas.functions.text import roman_value
from verbatlas.operators.integrity import complete_only
from verbatlas.operators.ordered import groups_from_starts

# The fields of a law's file and of a year's file.
LAW = (
    "lei string, nome string, fonte string, total_artigos int, artigos array<struct<id:string, artigo:string, contexto:struct<titulo:string, capitulo:string, secao:string>, caput:string,"
    " paragrafos:array<struct<numero:string, texto:string, incisos:array<struct<numero:string, texto:string, alineas:array<string>>>>>, incisos:array<struct<numero:string, texto:string, alineas:array<string>>>>>"
)
YEAR = "ano int, completo boolean, decretos array<struct<id:string, numero:string, epigrafe:string, sumula:string, publicado_em:date, blocos:array<struct<id:string, ordem:int, rotulo:string, texto:string>>>>"


def laws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAW).option("multiLine", True).option("mode", "FAILFAST").json(path)


def flattened(law: DataFrame) -> DataFrame:
    """(lei, id, artigo_id, pai_id, tipo, numero, texto, ordem): every caput, paragraph, item and letter, in the law's
    document order; ids are their parent's with a suffix.

    A paragraph's number is the one its text begins with, as '§ 4º-A' lands with the number 4; an id that comes out
    twice stops the job. An article's own items stand before its paragraphs. A law is one group.
    """
    a = law.select("lei", F.posexplode("artigos").alias("i", "a"))
    base = a.select("lei", F.col("a.id").alias("artigo_id"), "i", "a")
    zero, none = F.lit(0), F.lit(None).cast("string")
    caput = base.select("lei", "artigo_id", F.col("artigo_id").alias("id"), none.alias("pai_id"), F.lit("caput").alias("tipo"), none.alias("numero"), F.col("a.caput").alias("texto"), F.array("i", zero, zero, zero, zero).alias("k"))
    p = base.select("lei", "artigo_id", "i", F.posexplode("a.paragrafos").alias("j", "p"))
    own = block("p.texto")
    landed = F.concat(F.lit("_p"), F.when(F.col("p.numero").rlike("(?i)[uú]nico"), "u").otherwise(F.regexp_extract("p.numero", "([0-9]+)", 1)))
    p = p.withColumn("pid", F.concat("artigo_id", F.when(own["kind"] == "paragrafo", own["key"]).otherwise(landed)))
    par = p.select("lei", "artigo_id", F.col("pid").alias("id"), F.col("artigo_id").alias("pai_id"), F.lit("paragrafo").alias("tipo"), F.col("p.numero").alias("numero"), F.col("p.texto").alias("texto"), F.array("i", F.lit(2), F.col("j") + 1, zero, zero).alias("k"))
    of_article = base.select("lei", "artigo_id", F.col("artigo_id").alias("up"), F.array("i", F.lit(1), zero).alias("k0"), F.posexplode("a.incisos").alias("m", "x"))
    of_par = p.select("lei", "artigo_id", F.col("pid").alias("up"), F.array("i", F.lit(2), F.col("j") + 1).alias("k0"), F.posexplode("p.incisos").alias("m", "x"))
    inc = of_article.unionByName(of_par).withColumn("iid", F.concat(F.col("up"), F.lit("_inc"), F.coalesce(roman_value("x.numero").cast("string"), F.lower("x.numero"))))
    items = inc.select("lei", "artigo_id", F.col("iid").alias("id"), F.col("up").alias("pai_id"), F.lit("inciso").alias("tipo"), F.col("x.numero").alias("numero"), F.col("x.texto").alias("texto"), F.concat("k0", F.array(F.col("m") + 1, zero)).alias("k"))
    let = inc.select("lei", "artigo_id", "iid", "k0", "m", F.posexplode("x.alineas").alias("n", "t"))
    letter = F.char(F.col("n") + 97)
    letters = let.select("lei", "artigo_id", F.concat("iid", F.lit("_al"), letter).alias("id"), F.col("iid").alias("pai_id"), F.lit("alinea").alias("tipo"), letter.alias("numero"), F.col("t").alias("texto"), F.concat("k0", F.array(F.col("m") + 1, F.col("n") + 1)).alias("k"))
    rows = caput.unionByName(par).unionByName(items).unionByName(letters)
    twice = F.count("*").over(Window.partitionBy("lei", "id"))
    once = F.when(twice > 1, F.raise_error(F.concat(F.lit("an id comes out twice: "), F.col("id")))).otherwise(F.col("id"))
    out = rows.withColumn("ordem", F.row_number().over(Window.partitionBy("lei").orderBy("k"))).withColumn("id", once)
    return out.select("lei", "id", "artigo_id", "pai_id", "tipo", "numero", "texto", "ordem")


def yearly(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Decrees of the yearly files (YYYY.json) that are complete and not empty."""
    name = str(year) if year else "[0-9][0-9][0-9][0-9]"
    files = spark.read.schema(YEAR).option("multiLine", True).json(f"{folder}/{name}.json")
    return complete_only(files).select("ano", F.explode("decretos").alias("d")).select("ano", "d.*")


def listing(pages: DataFrame, row: str, fields: dict[str, int], html: str = "html") -> DataFrame:
    """One row for each match of a pattern in a page, its groups as columns."""
    groups = [F.regexp_extract_all(html, F.lit(row), F.lit(g)).alias(n) for n, g in fields.items()]
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(F.arrays_zip(*groups)).alias("pos", "r")).select(*keep, (F.col("pos") + 1).alias("pos"), *[F.col(f"r.{n}").alias(n) for n in fields])


def landed_json(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """REST responses as they landed, one item for each key."""
    return spark.read.schema(schema).option("multiLine", True).json(path).dropDuplicates(key)


def until_stop(pages: DataFrame, listing: str, page: str, items: str, full: int | None = None) -> DataFrame:
    """The landed pages of each listing up to its end: the first page that is empty, missing, or, where ``full`` is
    given, has fewer items than that (which still counts). What lies behind it belongs to another harvest."""
    w = Window.partitionBy(listing).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.size(items), F.lit(0))
    ended = (n <= 0) if full is None else (n < full)
    gap = F.col(page) != F.lag(page, 1).over(Window.partitionBy(listing).orderBy(page)) + 1
    out = pages.withColumns({"__end": F.max(ended).over(w), "__gap": F.max(F.coalesce(gap, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where(~F.coalesce(F.col("__end"), F.lit(False)) & ~F.col("__gap") & (n > 0)).drop("__end", "__gap")


def precedents_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV in UTF-8 with a mark, quoted line ends and a header."""
    out = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    first = out.columns[0]
    return out.withColumn(first, F.regexp_replace(first, "^﻿", "")) if dict(out.dtypes)[first] == "string" else out


def server_events(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """(…, pos, event): the events of a stream's text, split at blank lines; what isn't JSON, the end mark
    and an unfinished tail are left out."""
    keep = [c for c in df.columns if c != raw]
    whole = F.regexp_replace(raw, "\r\n", "\n")
    parts = F.split(F.regexp_extract(whole, "(?s)^(.*)\n\n", 1), "\n\n")
    each = df.select(*keep, F.posexplode(parts).alias("pos", "chunk"))
    data = F.array_join(F.filter(F.split("chunk", "\n"), lambda x: x.startswith("data:")), "\n")
    each = each.withColumn("data", F.trim(F.regexp_replace(data, "(?m)^data: ?", ""))).where("data NOT IN ('', '[DONE]')")
    return each.withColumn("event", F.from_json("data", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where(F.try_parse_json("data").isNotNull()).select(*keep, "pos", "event")


def xml_fields(x: Column | str, paths: dict[str, str]) -> list[Column]:
    """Strings at XPaths of an XML text."""
    return [F.xpath_string(x, F.lit(p)).alias(n) for n, p in paths.items()]


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, problem) of the entries of ZIP files, unpacked in the tasks that read them. A file that is no
    archive, or breaks off, gives a row with its problem."""

    def unpack(batches):
        import io
        import zipfile
        import zlib

        import pandas as pd

        for df in batches:
            for p, data in zip(df["path"], df["content"], strict=True):
                name = None
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in sorted(z.namelist()):
                            if not name.endswith("/"):
                                yield pd.DataFrame({"path": [p], "name": [name], "text": [decoded(z.read(name))], "problem": [None]})
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                    yield pd.DataFrame({"path": [p], "name": [name], "text": [None], "problem": [str(e)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, name string, text string, problem string")


def decoded(data: bytes) -> str:
    """UTF-8, else Windows-1252, else with replacements."""
    for code in ("utf-8", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def cache_key(url: Column | str, body: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(F.col(url) if isinstance(url, str) else url, F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))), 256), 1, 24)


def template_literals(df: DataFrame, name: str, text: str = "value") -> DataFrame:
    """The template literals assigned to ``name`` in source files."""
    return df.withColumn("literal", F.regexp_extract(text, f"(?s){re.escape(name)}\\s*[:=]\\s*`(.*?)`", 1)).where("literal <> ''")


# --- words on pages ----------------------------------------------------------------------------


#: Words whose tops differ by less share a line; fewer lines side by side are no columns.
LINE_HEIGHT, LEAST_LINES = 3.0, 3


def empty_bands(boxes: list[tuple[float, float]], gap: float) -> list[float]:
    """The middles of the empty bands, at least ``gap`` wide, between intervals."""
    out, reach = [], None
    for x0, x1 in sorted(boxes):
        if reach is not None and x0 - reach >= gap:
            out.append((x0 + reach) / 2)
        reach = x1 if reach is None else max(reach, x1)
    return out


def reading_order(words: list[tuple[float, float, float]], gap: float) -> list[list[int]]:
    """The numbers of the words (x0, x1, top) of each region of a page, in reading order.

    A region with empty bands from top to bottom is cut there into columns, which are read from left to right, each cut further in the same way. One without is
    cut into stretches of lines, the longest that have a band of their own, such as columns under a title; what is between them is read line by line.
    """

    def lines(own: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in sorted(own, key=lambda i: words[i][2]):
            if not out or words[i][2] - words[out[-1][-1]][2] > LINE_HEIGHT:
                out.append([])
            out[-1].append(i)
        return out

    def bands(own: list[int]) -> list[float]:
        return empty_bands([words[i][:2] for i in own], gap)

    def regions(own: list[int]) -> list[list[int]]:
        rows = lines(own)
        if len(rows) >= LEAST_LINES and (cuts := bands(own)):
            edges = [float("-inf"), *cuts, float("inf")]
            columns = [[i for i in own if a <= words[i][0] < b] for a, b in zip(edges, edges[1:])]
            return [r for c in columns for r in regions(c)]
        out: list[list[int]] = []
        plain: list[int] = []
        k = 0
        while k < len(rows):
            n, run = 0, []
            for row in rows[k:]:
                if not bands(run + row):
                    break
                run, n = run + row, n + 1
            if n >= LEAST_LINES and n < len(rows):
                out += [plain] * bool(plain) + regions(run)
                plain, k = [], k + n
            else:
                plain, k = plain + rows[k], k + 1
        return out + [plain] * bool(plain)

    return regions([*range(len(words))])


def lines_of_words(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """(doc, page, col, line, text): word boxes (doc, page, x0, x1, top, text) to lines in reading order, of any number of columns; ``col`` numbers
    a page's regions. One group is one page."""

    def page(pdf):
        import pandas as pd

        pdf = pdf.reset_index(drop=True)
        of = {i: k for k, own in enumerate(reading_order(list(zip(pdf["x0"], pdf["x1"], pdf["top"], strict=True)), gap)) for i in own}
        pdf = pdf.assign(col=[of[i] for i in range(len(pdf))]).sort_values(["col", "top", "x0"])
        new = (pdf["col"].diff().fillna(1) != 0) | (pdf["top"].diff().abs().fillna(99) > LINE_HEIGHT)
        pdf["line"] = new.cumsum()
        out = pdf.sort_values(["line", "x0"]).groupby(["doc", "page", "col", "line"], as_index=False)["text"].agg(" ".join)
        return pd.DataFrame(out)[["doc", "page", "col", "line", "text"]]

    return words.groupBy("doc", "page").applyInPandas(page, "doc string, page long, col long, line long, text string")


def paragraphs_of_lines(lines: DataFrame, starts: str = "^(Art\\.|§|Parágrafo único|[IVXLCDM]+ ?[-–—]|[a-z]\\)|TÍTULO|CAPÍTULO|SEÇÃO)") -> DataFrame:
    """(doc, block, text): logical paragraphs; a line that begins a block starts one, words broken by a
    hyphen at a line's end are joined."""
    order = ["page", "col", "line"]
    marked = groups_from_starts(lines, ["doc"], order, F.col("text").rlike(starts), "block")
    rows = marked.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["text"]), "\n")
    return rows.select("doc", "block", F.regexp_replace(F.regexp_replace(text, "([a-zà-ÿ])-\n([a-zà-ÿ])", "$1$2"), "\n", " ").alias("text"))
