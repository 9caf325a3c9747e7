"""Browsing and relating: views, lookups, facets, overlaps, orders inside groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbatlas.functions.text import norm, slug
from verbatlas.operators import intent, integrity, ordered, relate
from verbatlas.plans.etl_queries import dealt, dealt_sql
from verbatlas.plans.search_queries import t


def q_view_three_way(spark, d):
    r, n, s = t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "supplier")
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


def q_maybe_single(spark, d):
    """One row or none, by key; two rows would be an error."""
    return relate.one_or_none(t(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name"))


def q_order_preserving_lookup(spark, d):
    return relate.in_order_of(t(spark, d, "customer"), "c_custkey", [42, 7, 100, 3, 999999]).select("place", "c_custkey", "c_name")


def q_neighbours(spark, d):
    return ordered.neighbours(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "next")


def q_nested_children(spark, d):
    out = relate.with_children(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", ["l_partkey"], "lines")
    return out.select("o_orderkey", "n_lines", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("listed"))


def q_child_counts(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def brands(spark, d):
    """Customers with the brands that their orders' lines have."""
    o, li, p = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "part")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_set("p_brand").alias("brands"))


def q_overlap_join(spark, d):
    """Customers of every 50th key, as queries, against all."""
    return relate.overlapping_within(brands(spark, d), F.expr("cust % 50 = 0"), "cust", "other", "brands")


def q_overlap_rank(spark, d):
    return relate.best_overlaps(relate.overlapping_within(brands(spark, d), F.expr("cust % 50 = 0"), "cust", "other", "brands", 3), "cust", "other", 3)


def q_first_match_lookup(spark, d):
    """The first brand (by its lowest part key) among an order's, for open orders; 'none' without a line."""
    o = t(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    items = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("p_brand").alias("p_brand"))
    rules = p.groupBy("p_brand").agg(F.min("p_partkey").alias("rank")).select("p_brand", F.concat(F.lit("first: "), "p_brand").alias("label"), "rank")
    have = o.join(items.withColumnRenamed("p_brand", "own"), "o_orderkey", "left")
    return relate.first_match(have, rules, "o_orderkey", "own", "p_brand", "label", "rank", F.lit("none")).select("o_orderkey", "label")


TRIGGERS = [(1, {"k": "9"}), (2, {"k": "99"}), (3, {}), (4, {"k": '"9"'}), (5, {"k": "9", "x": "1"})]


def q_fact_match(spark, d):
    """Events' facts against triggers, compared as JSON values with their types."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.map_from_arrays(F.array(*map(F.lit, m)).cast("array<string>"), F.array(*map(F.lit, m.values())).cast("array<string>")).alias("trigger")) for i, m in TRIGGERS])
    e = t(spark, d, "events")
    facts = F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: v)
    e = e.select("event_id", facts.alias("facts"), F.explode(rules).alias("r"))
    return e.where(relate.facts_apply(F.col("r.trigger"), F.col("facts"))).select("event_id", F.col("r.rule").alias("rule"))


def q_facets(spark, d):
    return relate.facet_counts(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def q_facet_filter(spark, d):
    c = t(spark, d, "customer")
    return relate.faceted(c, {"c_mktsegment": ["MACHINERY", "FURNITURE"], "c_nationkey": [1, 2, 3]}, "customer#0000000", ["c_name", "c_mktsegment"]).select("c_custkey")


def q_curated_toggle(spark, d):
    return relate.listed(t(spark, d, "part"), "Econ", ["p_name", "p_type"], F.col("p_size") > 25).select("p_partkey")


def q_facet_sums(spark, d):
    p = t(spark, d, "part")
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def q_all_words_filter(spark, d):
    return t(spark, d, "part").where(relate.all_words("p_name", "RÉD widget")).select("p_partkey", "p_name")


def q_prefix_or_contains(spark, d):
    p = t(spark, d, "part")
    return p.where(norm("p_name").startswith("hot") | F.contains(norm("p_name"), F.lit("bolt"))).select("p_partkey")


def q_ilike_or(spark, d):
    return t(spark, d, "customer").where(relate.like_any("%household_ 12", "c_name", "c_mktsegment", digits="c_name")).select("c_custkey")


def q_health_counts(spark, d):
    return integrity.health({
        "documents": (t(spark, d, "documents"), None), "vectors": (t(spark, d, "embeddings"), F.col("embedding").isNotNull()), "toxic": (t(spark, d, "labels"), F.col("toxic") == 1),
        "open_orders": (t(spark, d, "orders"), F.col("o_orderstatus") == "O"), "suppliers": (t(spark, d, "supplier"), None),
    }).select(F.to_json(F.struct("documents", "vectors", "toxic", "open_orders", "suppliers")).alias("health"))


def q_pivot_counts(spark, d):
    return t(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


def q_group_vocab(spark, d):
    g = relate.grouped_names(t(spark, d, "part").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))), "p_name", "p_partkey", "p_partkey")
    return g


def q_distinct_on(spark, d):
    e = t(spark, d, "events")
    return ordered.first_of(e, ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "value")


def q_latest_from_last_n(spark, d):
    e = t(spark, d, "events")
    return ordered.latest_among_last(e, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_type", "event_id")


def q_time_bucket_runs(spark, d):
    e = t(spark, d, "events")
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    e = e.withColumn("bucket", ordered.time_bucket(days))
    e = ordered.runs(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], "bucket")
    return e.groupBy("user_id", "run", "bucket").agg(F.count("*").alias("n"))


WEEK_MS = 7 * 24 * 3_600_000


def q_rate_limit(spark, d):
    e = t(spark, d, "events")
    out = ordered.over_rate(e, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), 3, WEEK_MS)
    return out.where("refused").select("event_id", "user_id", "in_window")


def q_quota(spark, d):
    from verbatlas.operators.merge import within_quota

    e = t(spark, d, "events").where("event_type = 'purchase'")
    out = within_quota(e, F.date_format(F.col("ts"), "yyyy-MM-dd"), [F.col("ts"), F.col("event_id")], 50)
    return out.groupBy("period").agg(F.count_if("permitted").alias("permitted"), F.count("*").alias("asked"))


def q_republication_dedupe(spark, d):
    e = t(spark, d, "events")
    return ordered.republished(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "replaced")


def q_carry_forward(spark, d):
    c = t(spark, d, "conversations")
    asked = F.when(F.col("role") == "user", F.col("text"))
    out = ordered.filled_forward(c, ["conv_id"], ["turn"], {"question": asked})
    out = ordered.carried_to_next(out, ["conv_id"], ["turn"], F.col("role"), "role_before")
    return out.select("conv_id", "turn", "question", "role_before")


def q_destination(spark, d):
    e = t(spark, d, "events")
    return ordered.neighbours(e, ["user_id"], ["ts", "event_id"], "event_id").select("event_id", F.col("next").alias("destination"))


def q_context_levels(spark, d):
    """Two heading levels of conversations: roles as the outer, long turns as the inner."""
    c = t(spark, d, "conversations")
    levels = {"outer_level": F.when(F.col("role") == "user", F.col("turn")), "inner_level": F.when(F.length("text") > 300, F.col("turn"))}
    return ordered.context(c, ["conv_id"], ["turn"], levels).select("conv_id", "turn", "outer_level", "inner_level")


def q_duplicate_suffix(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", slug("p_name").alias("slug"))
    return ordered.unique_slugs(p, ["p_type"], "slug", ["p_partkey"])


def q_insert_after_anchor(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    n = ordered.renumbered(n, ["n_regionkey"], ["n_nationkey"])
    new = F.array(*[F.struct(F.lit(r).alias("n_regionkey"), F.lit(k).alias("n_nationkey"), F.lit(x).alias("n_name"), F.lit(a).alias("after"), F.lit(q).alias("seq")) for r, k, x, a, q in INSERTS])
    extra = spark.range(1).select(F.explode(new).alias("x")).select("x.*")
    return ordered.inserted(n, extra, ["n_regionkey"]).select("n_regionkey", "ordem", "n_name")


INSERTS = [(0, 100, "NEW B", 2, 2), (0, 101, "NEW A", 2, 1), (1, 102, "NEW FIRST", 0, 1), (2, 103, "NEW LAST", 99, 1)]


def q_running_max_anomaly(spark, d):
    o = t(spark, d, "orders")
    return ordered.out_of_sequence(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "highest")


def q_last_turns_inherit(spark, d):
    c = t(spark, d, "conversations")
    ids = c.select("conv_id", "turn", F.array_distinct(F.array((F.length("text") % 7).cast("int"), (F.length("text") % 5).cast("int"), F.col("turn").cast("int"))).alias("ids"))
    return ordered.inherited(ordered.last_turns(ids, "conv_id", "turn", 3), "conv_id", "turn", "ids", 5).withColumnRenamed("id", "inherited")


def q_thread_before(spark, d):
    return ordered.last_turns(t(spark, d, "conversations"), "conv_id", "turn", 3, before=3).select("conv_id", "turn", "back")


def q_union_align(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return relate.aligned({"customer": c, "supplier": s}).groupBy("origin", "segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


def q_set_operations(spark, d):
    ev = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 10, F.col("event_type"))).alias("b"))
    return ev.select("user_id", F.size(F.array_except("a", "b")).alias("only_small"), F.size(F.array_intersect("a", "b")).alias("large"))


def q_recursive_parent(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 3, F.floor(F.col("n_nationkey") / 3).cast("int")).alias("parent"))
    return relate.ancestors(n, "id", "parent")


def q_source_cards(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")).alias("pos"), (F.col("l_returnflag") == "R").alias("first"))
    return relate.few_with_primaries(li, "l_orderkey", "first", "pos").select("l_orderkey", "pos", "place")


def q_reattached(spark, d):
    o = t(spark, d, "orders")
    cited = o.select(F.col("o_custkey").alias("k"))
    own = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return relate.reattached(cited, own, o.select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey")


def q_incorporated(spark, d):
    """Orders whose every part is also sold by the supplier with the order's customer number modulo 10."""
    li = t(spark, d, "lineitem")
    arts = li.groupBy(F.col("l_partkey").alias("article")).agg(F.collect_set((F.col("l_suppkey") % 10).cast("string")).alias("changed_by"))
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("norm"))
    touched = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("touched"))
    return relate.incorporated(o.join(touched, "o_orderkey", "left"), arts, "o_orderkey", "touched", "norm").select("o_orderkey", "incorporated")


def q_impact_counts(spark, d):
    """How many orders touch each part of a brand; parts without any count 0."""
    p = t(spark, d, "part").where("p_brand = 'Brand#1'").select("p_partkey")
    n = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("n"))
    return p.join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


def q_run_summary(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("ok"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.min(F.to_date("ts")).alias("oldest"))


def q_distinct_years(spark, d):
    return t(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def q_anti_join(spark, d):
    """Users without a large purchase: an anti-join."""
    e = t(spark, d, "events")
    return e.select("user_id").distinct().join(e.where("event_type = 'purchase' AND value > 200"), "user_id", "left_anti")


ASKS = ["art. 3# da lei de drogas", "o que diz a doutrina sobre furto", "prazo para resposta à acusação", "Artigo 217-A do Código Penal", "tráfico privilegiado", "recurso no CPP"]


def q_intent(spark, d):
    q = dealt(spark, d, ASKS, "q")
    c = intent.classified("q")
    return q.select("n", c["kind"].alias("kind"), c["article"].alias("article"), c["law"].alias("law"), intent.wants_state_acts("q").alias("state"), intent.act_query("q").alias("rewritten"))


def q_citable_precedents(spark, d):
    """Suppliers as precedents on the brands that they supply, of which some are pending and some say nothing; for every fiftieth customer the
    three that share most brands."""
    line, part = t(spark, d, "lineitem"), t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplied = line.join(part, "l_partkey").select("l_suppkey", "p_brand").distinct().groupBy("l_suppkey").agg(F.collect_list("p_brand").alias("articles"))
    status = F.when(F.col("l_suppkey") % 3 == 0, "Em julgamento").otherwise("Trânsito em julgado")
    known = supplied.select(F.col("l_suppkey").alias("precedent"), "articles", status.alias("status"), F.when(F.col("l_suppkey") % 5 > 0, "thesis").alias("thesis"))
    bought = line.join(t(spark, d, "orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(part, "l_partkey")
    asked = bought.select(F.col("o_custkey").alias("cust"), "p_brand").distinct().groupBy("cust").agg(F.collect_list("p_brand").alias("asked"))
    return relate.citable_overlaps(asked, known, "cust", "precedent", "asked", "articles", F.col("status") == "Trânsito em julgado", "thesis").select("cust", "precedent", "shared", "rank")


def q_first_headings(spark, d):
    """Of the documents' first lines as they are written, in each language the first document that has it."""
    docs = t(spark, d, "documents").select("lang", F.substring_index("text", "\n", 1).alias("heading"), "doc_id").where("heading <> ''")
    return ordered.first_of(docs, ["lang", "heading"], ["doc_id"]).select("lang", F.md5(F.col("heading").cast("binary")).alias("heading"), "doc_id")


def q_sequence_anomalies(spark, d):
    """Documents as articles: numbers that run back within a source, and first lines that are too short."""
    docs = t(spark, d, "documents").select("source", "doc_id", (F.col("doc_id") * 37 % 101).cast("int").alias("number"), F.substring_index("text", "\n", 1).alias("caput"))
    return ordered.anomalies(docs, ["source"], "number", ["doc_id"], "caput").select("source", "doc_id", "problem", "after")


B = "SELECT o_custkey AS cust, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
ORD = "ORDER BY ts DESC, event_id DESC"
SQL = {
    "q_intent": """SELECT * FROM (VALUES (0, 'dispositivo', '3#', 'lei_11343_2006', FALSE, 'art 3# da lei de drogas'), (1, 'doutrina', NULL, NULL, FALSE, 'o que diz a doutrina sobre furto'), (2, 'processual', NULL, NULL, FALSE, 'prazo para resposta a acusacao'),
      (3, 'dispositivo', '217-A', 'dl_2848_1940', FALSE, 'artigo 217-a do codigo penal'), (4, 'aberta', NULL, NULL, FALSE, 'trafico privilegiado'), (5, 'processual', NULL, NULL, FALSE, 'recurso no cpp')) v(n, kind, article, law, state, rewritten)""",
    "q_view_three_way": "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "q_maybe_single": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7",
    "q_order_preserving_lookup": "SELECT place, c_custkey, c_name FROM customer JOIN (VALUES (0, 42), (1, 7), (2, 100), (3, 3), (4, 999999)) v(place, k) ON c_custkey = k",
    "q_neighbours": "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "q_nested_children": """SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS listed
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "q_child_counts": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "q_overlap_join": f"WITH b AS ({B}) SELECT a.cust, b.cust AS other, count(*) AS shared FROM b a JOIN b ON a.p_brand = b.p_brand AND a.cust <> b.cust WHERE a.cust % 50 = 0 GROUP BY 1, 2",
    "q_overlap_rank": f"WITH b AS ({B}) SELECT *, row_number() OVER (PARTITION BY cust ORDER BY shared DESC, other) AS rank FROM (SELECT a.cust, b.cust AS other, count(*) AS shared FROM b a JOIN b ON a.p_brand = b.p_brand AND a.cust <> b.cust WHERE a.cust % 50 = 0 GROUP BY 1, 2) QUALIFY rank <= 3",
    "q_first_match_lookup": """WITH r AS (SELECT p_brand, min(p_partkey) AS rank FROM part GROUP BY 1),
      h AS (SELECT l_orderkey, min_by('first: ' || r.p_brand, rank) AS label FROM lineitem JOIN part ON l_partkey = p_partkey JOIN r ON r.p_brand = part.p_brand GROUP BY 1)
      SELECT o_orderkey, coalesce(label, 'none') AS label FROM orders LEFT JOIN h ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""",
    "q_fact_match": """SELECT event_id, rule FROM events, (VALUES (1), (2), (3), (4), (5)) v(rule) WHERE CASE rule WHEN 1 THEN json_extract(props, '$.k')::VARCHAR = '9'
      WHEN 2 THEN json_extract(props, '$.k')::VARCHAR = '99' WHEN 3 THEN TRUE ELSE FALSE END""",
    "q_facets": "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "q_facet_filter": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IN (1, 2, 3) AND contains(lower(c_name || ' ' || c_mktsegment), 'customer#0000000')",
    "q_curated_toggle": "SELECT p_partkey FROM part WHERE p_size > 25 AND contains(strip_accents(lower(p_name || ' ' || p_type)), 'econ')",
    "q_facet_sums": "SELECT p_type, count(*) AS n, sum(p_size) AS size, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1",
    "q_all_words_filter": "SELECT p_partkey, p_name FROM part WHERE contains(strip_accents(lower(p_name)), 'red') AND contains(strip_accents(lower(p_name)), 'widget')",
    "q_prefix_or_contains": "SELECT p_partkey FROM part WHERE starts_with(p_name, 'hot') OR contains(p_name, 'bolt')",
    "q_ilike_or": "SELECT c_custkey FROM customer WHERE c_name ILIKE '%household 12%' OR c_mktsegment ILIKE '%household 12%' OR contains(regexp_replace(c_name, '[^0-9]', '', 'g'), '12')",
    "q_health_counts": """SELECT '{"documents":' || (SELECT count(*) FROM documents) || ',"vectors":' || (SELECT count(embedding) FROM embeddings) || ',"toxic":' || (SELECT count(*) FROM labels WHERE toxic = 1)
      || ',"open_orders":' || (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') || ',"suppliers":' || (SELECT count(*) FROM supplier) || '}' AS health""",
    "q_pivot_counts": "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1",
    "q_group_vocab": "SELECT lower(p_name) AS norm, min_by(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1",
    "q_distinct_on": "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, value DESC NULLS LAST, event_id",
    "q_latest_from_last_n": f"SELECT event_type, event_id FROM (SELECT * FROM events {ORD} LIMIT 20) QUALIFY row_number() OVER (PARTITION BY event_type {ORD}) = 1",
    "q_time_bucket_runs": f"""WITH e AS (SELECT *, date_diff('day', ts::DATE, DATE '2024-01-31') AS days FROM events),
      b AS (SELECT *, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days <= 7 THEN '7 days' WHEN days <= 30 THEN '30 days' ELSE 'earlier' END AS bucket FROM e),
      c AS (SELECT *, CASE WHEN lag(bucket) OVER (PARTITION BY user_id {ORD}) IS DISTINCT FROM bucket THEN 1 ELSE 0 END AS c FROM b),
      r AS (SELECT *, sum(c) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING) AS run FROM c)
      SELECT user_id, run, bucket, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "q_rate_limit": f"SELECT event_id, user_id, in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN {WEEK_MS - 1} PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 3",
    "q_quota": "SELECT strftime(ts, '%Y-%m-%d') AS period, least(count(*), 50) AS permitted, count(*) AS asked FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "q_republication_dedupe": f"SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS replaced FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type {ORD}) = 1",
    "q_carry_forward": """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question,
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS role_before FROM conversations""",
    "q_destination": "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS destination FROM events",
    "q_context_levels": """WITH a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS outer_level FROM conversations)
      SELECT conv_id, turn, outer_level, max(CASE WHEN length(text) > 300 THEN turn END) OVER (PARTITION BY conv_id, outer_level ORDER BY turn ROWS UNBOUNDED PRECEDING) AS inner_level FROM a""",
    "q_duplicate_suffix": """SELECT p_partkey, p_type, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM (
      SELECT p_partkey, p_type, slug, row_number() OVER (PARTITION BY p_type, slug ORDER BY p_partkey) AS n FROM (SELECT *, replace(p_name, ' ', '-') AS slug FROM part))""",
    "q_insert_after_anchor": f"""WITH a AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p, 0 AS q FROM nation
      UNION ALL SELECT r, x, a, q FROM (VALUES {', '.join(f"({r}, '{x}', {a}, {q})" for r, _, x, a, q in INSERTS)}) v(r, x, a, q))
      SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY p, q) AS ordem, n_name FROM a""",
    "q_running_max_anomaly": "SELECT o_orderkey, highest FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM orders) WHERE o_orderkey <= highest",
    "q_last_turns_inherit": """WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3),
      i AS (SELECT conv_id, turn, 0 AS p, length(text) % 7 AS id FROM l UNION ALL SELECT conv_id, turn, 1, length(text) % 5 FROM l UNION ALL SELECT conv_id, turn, 2, turn FROM l),
      o AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn DESC, p) = 1)
      SELECT conv_id, id AS inherited, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, p, id) AS rank FROM o QUALIFY rank <= 5""",
    "q_thread_before": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE turn < 3 QUALIFY back <= 3",
    "q_union_align": """SELECT 'customer' AS origin, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 2
      UNION ALL SELECT 'supplier', NULL, count(*), round(sum(s_acctbal), 2) FROM supplier""",
    "q_set_operations": """WITH g AS (SELECT user_id, event_type, bool_or(value > 10) AS big FROM events GROUP BY 1, 2)
      SELECT user_id, count(*) FILTER (WHERE NOT coalesce(big, FALSE)) AS only_small, count(*) FILTER (WHERE big) AS large FROM g GROUP BY 1""",
    "q_recursive_parent": """WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey >= 3 THEN n_nationkey // 3 END AS parent FROM nation),
      a(id, ancestor, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT a.id, n.parent, depth + 1 FROM a JOIN n ON a.ancestor = n.id WHERE n.parent IS NOT NULL) SELECT id, ancestor, depth FROM a""",
    "q_source_cards": """WITH p AS (SELECT l_orderkey, l_returnflag = 'R' AS first, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS pos FROM lineitem),
      k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY first DESC, pos) <= 4)
      SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place FROM k""",
    "q_reattached": "SELECT o_custkey AS k, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "q_incorporated": """WITH a AS (SELECT DISTINCT l_partkey, (l_suppkey % 10)::VARCHAR AS by FROM lineitem),
      o AS (SELECT o_orderkey, (o_custkey % 10)::VARCHAR AS norm FROM orders),
      x AS (SELECT DISTINCT o_orderkey, norm, l_partkey FROM o JOIN lineitem ON l_orderkey = o_orderkey),
      y AS (SELECT o_orderkey, bool_and(EXISTS (SELECT 1 FROM a WHERE a.l_partkey = x.l_partkey AND a.by = x.norm)) AS ok FROM x GROUP BY 1)
      SELECT o_orderkey, coalesce(ok, FALSE) AS incorporated FROM o LEFT JOIN y USING (o_orderkey)""",
    "q_impact_counts": "SELECT p_partkey, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_brand = 'Brand#1' GROUP BY 1",
    "q_run_summary": "SELECT user_id, bool_and(event_type <> 'error') AS ok, sum(value::DECIMAL(18,2))::DOUBLE AS total, min(ts::DATE) AS oldest FROM events GROUP BY 1",
    "q_distinct_years": "SELECT DISTINCT year(o_orderdate) AS year FROM orders",
    "q_anti_join": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)",
}
SQL["q_intent"] = dealt_sql(SQL["q_intent"], ASKS, filled=("article", "rewritten"))
SQL["q_citable_precedents"] = """WITH p AS (SELECT DISTINCT l_suppkey AS precedent, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 3 <> 0 AND l_suppkey % 5 > 0),
      a AS (SELECT DISTINCT o_custkey AS cust, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 50 = 0)
      SELECT cust, precedent, shared, row_number() OVER (PARTITION BY cust ORDER BY shared DESC, precedent) AS rank FROM (SELECT cust, precedent, count(*) AS shared FROM a JOIN p USING (p_brand) GROUP BY 1, 2) QUALIFY rank <= 3"""
SQL["q_first_headings"] = "SELECT lang, md5(h) AS heading, min(doc_id) AS doc_id FROM (SELECT lang, split_part(text, chr(10), 1) AS h, doc_id FROM documents) WHERE h <> '' GROUP BY lang, h"
SQL["q_sequence_anomalies"] = """WITH a AS (SELECT source, doc_id, doc_id * 37 % 101 AS number, split_part(text, chr(10), 1) AS caput FROM documents),
      b AS (SELECT *, max(number) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
      SELECT source, doc_id, 'out of order' AS problem, top::INT AS after FROM b WHERE number < top UNION ALL SELECT source, doc_id, 'short caput', NULL FROM b WHERE length(trim(caput, ' ')) < 15"""

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
