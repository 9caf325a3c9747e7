"""Relating collections: facets, overlaps, first matches, facts, ordered lookups, nested children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.lineage import cut
from verbatlas.functions.text import norm


def faceted(df: DataFrame, chosen: dict[str, list], text: str = "", fields: list[str] | None = None) -> DataFrame:
    """Rows that have one of the chosen values in every facet with any, and the text in their fields."""
    tests = [F.col(c).isin(v) for c, v in chosen.items() if v]
    if text.strip():
        tests.append(F.contains(norm(F.concat_ws(" ", *(fields or []))), norm(F.lit(text.strip()))))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def listed(df: DataFrame, text: str, fields: list[str], curated: Column | None = None) -> DataFrame:
    """Rows whose fields, one after another, hold the text; only curated ones if that is asked for."""
    out = faceted(df, {}, text, fields)
    return out if curated is None else out.where(F.coalesce(curated, F.lit(False)))


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of all facets, in one pass and one shuffle."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def all_words(field: Column | str, query: str) -> Column:
    """Every word of the query is in the field, whatever its accents and case."""
    f = norm(field)
    return reduce(lambda a, b: a & b, [F.contains(f, norm(F.lit(w))) for w in query.split()], F.lit(True))


def like_any(query: str, *fields: str, digits: str | None = None) -> Column:
    """The query, without wildcards, is in one of the fields; its digits alone, if any, in ``digits``."""
    plain = "".join(c for c in query if c not in "%_\\").strip()
    tests = [F.col(f).ilike(f"%{plain}%") for f in fields]
    only = "".join(c for c in query if c.isdigit())
    if digits and only:
        tests.append(F.contains(F.regexp_replace(digits, "[^0-9]", ""), F.lit(only)))
    return reduce(lambda a, b: a | b, tests)


#: Rows of the stated side of an overlap that are sent to the tasks at once, so few that a file names them by a byte; the same where only the first pairs
#: are wanted, which are not written; distinct items up to which sets are bitmaps.
BLOCK, RANKED_BLOCK, MOST_ITEMS = 200, 2_000, 512


#: Sets of items that rows are held against to see that they can be among no row's best.
SETS = 64


#: Pairs that a task compares.
PAIRS = 20_000_000


def overlapping(a: DataFrame, b: DataFrame, a_key: str, b_key: str, items_a: str, items_b: str, most: int | None = None) -> DataFrame:
    """(a_key, b_key, shared): pairs whose arrays meet; ``a`` is the stated side. A key is there once on each side. With ``most`` pairs may be missing
    that are not among the first ``most`` of their ``a_key`` by (shared, b_key), even where its own key is left out.

    Items are counted first. If they are selective, or more than MOST_ITEMS, they are joined. If they are few, and so common that a
    join would make more rows than there are pairs, each array becomes a bitmap of the items; blocks of ``a`` are
    broadcast, and each pair is one comparison of bits, without a hot key and without a shuffle. Both give the same rows.
    """
    left = cut(a.select(F.col(a_key).alias("__a"), F.array_distinct(items_a).alias("i")))
    right = cut(b.select(F.col(b_key).alias("__b"), F.array_distinct(items_b).alias("i")))
    return written_overlaps(left, right, a_key, b_key, most)


def overlapping_within(df: DataFrame, asked: Column, key: str, other: str, items: str, most: int | None = None) -> DataFrame:
    """``overlapping`` of the asked rows with all rows of the same frame, which is made and written once."""
    right = cut(df.select(F.col(key), F.array_distinct(items).alias("i")))
    left = right.where(asked).select(F.col(key).alias("__a"), "i")
    pairs = written_overlaps(left, right.withColumnRenamed(key, "__b"), key, other, most)
    return pairs.where(F.col(key) != F.col(other))


def written_overlaps(left: DataFrame, right: DataFrame, a_key: str, b_key: str, most: int | None) -> DataFrame:
    """``overlapping`` of frames (__a, i) and (__b, i) that are written."""
    n, m = left.where("size(i) > 0").count(), right.where("size(i) > 0").count()
    left, right = left.select("__a", F.explode("i").alias("i")), right.select("__b", F.explode("i").alias("i"))
    of = lambda df, name: df.groupBy("i").agg(F.count("*").alias(name))
    items = cut(of(left, "n").join(of(right, "m"), "i"))
    kinds, joined = items.agg(F.count("*"), F.sum(F.col("n").cast("double") * F.col("m"))).first()
    if kinds > MOST_ITEMS or (joined or 0.0) <= n * m:
        return left.join(right, "i").groupBy(F.col("__a").alias(a_key), F.col("__b").alias(b_key)).agg(F.count("*").alias("shared"))
    place = items.select("i", (F.row_number().over(Window.orderBy("i")) - 1).alias("at"))  # MOST_ITEMS rows at most
    words = range(-(-kinds // 64))

    def bitmaps(df: DataFrame, key: str, name: str) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)
        met = df.join(F.broadcast(place), "i")
        return met.groupBy(key).agg(*[F.bit_or(F.when(F.floor(F.col("at") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}{w}") for w in words])

    rows = BLOCK if most is None else RANKED_BLOCK
    parts = -(-n // rows)
    one, other, bits = bitmaps(left, "__a", "x"), bitmaps(right, "__b", "y"), [f"y{w}" for w in words]
    mine = [*[f"x{w}" for w in words], "__a"]
    block_of = F.spark_partition_id() % parts  # every row is in a block, whatever number of partitions there is
    one = cut(one.repartitionByRange(parts, *mine).sortWithinPartitions(*mine).withColumn("__block", block_of)).coalesce(left.sparkSession.sparkContext.defaultParallelism)
    if most is not None:
        other = cut(unsurpassed(other, "__b", bits, most + 1))  # one more, as a row may be left out for itself
        m = other.count()
    # Written once for all blocks, in parts by what they have to compare, as few bytes make many pairs. Rows with the same items follow one another on
    # both sides, so a file of pairs says the same numbers again and again, and is a small part of one in any order.
    tasks = max(-(-min(n, rows) * m // PAIRS), left.sparkSession.sparkContext.defaultParallelism)
    other = cut(other.repartitionByRange(tasks, *bits, "__b").sortWithinPartitions(*bits, "__b"))
    shared = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x{w}").bitwiseAND(F.col(f"y{w}"))) for w in words]).cast("long")
    out = []
    for k in range(parts):
        block = F.broadcast(one.where(F.col("__block") == k).drop("__block"))
        out.append(other.join(block).select(F.col("__a").alias(a_key), F.col("__b").alias(b_key), shared.alias("shared")).where("shared > 0"))
    return reduce(DataFrame.unionByName, out)


def unsurpassed(df: DataFrame, key: str, bits: list[str], most: int) -> DataFrame:
    """``df`` without rows that ``most`` rows with a lower key surpass, as each has all of their items: these share at least as much with any set, and
    come first. Of rows with the same items the first ``most`` stay. These are held against the SETS largest sets that ``most`` rows have; whatever
    these say of few rows, no row goes that counts."""
    size = reduce(lambda p, q: p + q, [F.bit_count(c) for c in bits])
    first = cut(df.withColumn("__n", F.row_number().over(Window.partitionBy(*bits).orderBy(key))).where(F.col("__n") <= most))
    sets = first.where(F.col("__n") == most).orderBy(size.desc(), key).limit(SETS).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in bits])
    within = [F.col(c).bitwiseAND(F.bitwise_not(F.col(f"__{c}"))) == 0 for c in bits]
    return first.drop("__n").join(F.broadcast(sets), reduce(lambda p, q: p & q, [F.col(key) > F.col("__k"), *within]), "left_anti")


def having_any(df: DataFrame, items: str, wanted: list) -> DataFrame:
    """Rows whose array is there and has one of the wanted items."""
    kind = dict(df.dtypes)[items]
    return df.where(F.col(items).isNotNull() & F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, wanted)).cast(kind)), F.lit(False)))


def joined_arrays(df: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """(key, items): the arrays of a key's rows one after another in ``order``, each item once, where it comes first. A key has the
    rows of one curated entry, which are few."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, items))).alias("x"))
    return rows.select(key, F.array_distinct(F.flatten(F.transform("x", lambda r: r[items]))).alias(items))


def best_overlaps(pairs: DataFrame, key: str, other: str, most: int = 3) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("shared").desc(), other)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def citable_overlaps(df: DataFrame, known: DataFrame, key: str, other: str, items: str, others: str, citable: Column, thesis: str, most: int = 3) -> DataFrame:
    """(key, other, shared, rank): of the rows of ``known`` that may be cited and have a thesis, the ``most`` that share most items with a row."""
    final = known.where(citable & F.col(thesis).isNotNull())
    return best_overlaps(overlapping(df, final, key, other, items, others, most), key, other, most)


def first_match(df: DataFrame, rules: DataFrame, key: str, items: str, item: str, label: str, order: str, otherwise: Column) -> DataFrame:
    """``df`` with ``label``: of the rules (item, label, order) that own one of a row's ``items``, the first."""
    hit = df.select(key, F.explode(items).alias(item)).join(rules, item).groupBy(key).agg(F.min_by(label, order).alias("__l"))
    return df.join(hit, key, "left").withColumn(label, F.coalesce("__l", otherwise)).drop("__l")


def facts_apply(trigger: Column, facts: Column) -> Column:
    """Every key of the trigger has the same value in the facts; an empty trigger applies. Values are
    JSON texts, so true and "true" differ."""
    return F.forall(F.map_entries(trigger), lambda e: e["value"].eqNullSafe(F.try_element_at(facts, e["key"])))


def in_order_of(df: DataFrame, key: str, asked: list) -> DataFrame:
    """The rows of the asked keys with ``place``, their place in the request."""
    kind = dict(df.dtypes)[key]
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, asked)).cast(f"array<{kind}>")).alias("place", "__k"))
    return df.join(F.broadcast(wanted), F.col(key) == F.col("__k")).drop("__k")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with their children as an ordered array (empty without any) and its length."""
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))
    out = parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out.withColumn(f"n_{name}", F.size(name))


def incorporated(df: DataFrame, articles: DataFrame, key: str, touched: str, norm_col: str) -> DataFrame:
    """``df`` with ``incorporated``: each touched article lists the norm among those that changed it; false
    for none. ``articles``: (article, changed_by)."""
    each = df.select(key, norm_col, F.explode(touched).alias("article")).join(articles, "article", "left")
    ok = each.groupBy(key).agg(F.bool_and(F.coalesce(F.array_contains("changed_by", F.col(norm_col)), F.lit(False))).alias("__ok"))
    return df.join(ok, key, "left").withColumn("incorporated", F.coalesce("__ok", F.lit(False))).drop("__ok")


def grouped_names(df: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """(norm, name, n, first_id): names with one normal form together, in their first spelling. The ids of a name
    are found by a join on ``norm``; they are not gathered, as a name may be on any number of rows."""
    return df.groupBy(norm(name).alias("norm")).agg(F.min_by(name, order).alias("name"), F.count("*").alias("n"), F.min(key).alias("first_id"))


def one_or_none(df: DataFrame) -> DataFrame:
    """The only row, or none; a second one stops the job."""
    rows = df.limit(2).agg(F.collect_list(F.struct(*df.columns)).alias("r"))
    checked = F.when(F.size("r") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.col("r"))
    return rows.select(F.inline(checked))


def aligned(parts: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(origin, F.lit(k)) for k, d in parts.items()])


def reattached(cited: DataFrame, own: DataFrame, pool: DataFrame, key: str, order: str) -> DataFrame:
    """Of the cited ids that aren't among one's own, the first row of each in the pool."""
    missing = cited.join(own, key, "left_anti").select(key).distinct()
    w = Window.partitionBy(key).orderBy(order)
    return pool.join(missing, key, "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def few_with_primaries(cards: DataFrame, group: str, primary: str, pos: str, most: int = 4) -> DataFrame:
    """At most ``most`` cards of each group, primary ones first, in their own order again (``place``)."""
    w = Window.partitionBy(group).orderBy(F.col(primary).desc(), pos)
    kept = cards.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(pos)))


def ancestors(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor, depth): every row with itself and all above it, however many.

    Reach doubles in each round: a row whose ancestors are known up to a level is joined with those of the one
    there, and what is known is written. A cycle stops the job.
    """
    own = df.select(F.col(key), F.col(key).alias("ancestor"), F.lit(0).alias("depth"))
    known = cut(df.where(F.col(parent).isNotNull()).select(F.col(key), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        if not known.where(F.col(key) == F.col("ancestor")).isEmpty():
            raise ValueError("a row is above itself")
        above = known.select(F.col(key).alias("__a"), F.col("ancestor").alias("__b"), F.col("depth").alias("__d"))
        more = known.where(F.col("depth") == reach).join(above, F.col("ancestor") == F.col("__a"))
        more = cut(more.select(key, F.col("__b").alias("ancestor"), (F.col("depth") + F.col("__d")).alias("depth")))
        if more.isEmpty():
            return own.unionByName(known)
        known, reach = known.unionByName(more), 2 * reach
