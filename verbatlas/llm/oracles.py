"""SQL for DuckDB with the rows of the queries that SQL can express.

Ops 3, 5, 6, 8, 9, 10 and 13 need a tokenizer, a trained model, base32 digests, XXH64, tests of digits at positions, or audio
features: they are held against brute force in tests. Ops 4 and 13 have held-out accuracy.
"""

from __future__ import annotations

from . import mixing, quality, sharding

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
HEX = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"

# The table by brute force: in turn i shard i modulo n takes the first free slot in its order.
OP1 = f"""WITH RECURSIVE shards AS (
    SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard, md5('shard-' || lpad(i::VARCHAR, 3, '0')) AS h FROM range({sharding.SHARDS}) r(i)),
  prefer AS (SELECT list(CAST('0x' || substr(h, 1, 12) AS BIGINT) % {sharding.SLOTS} ORDER BY i) AS start, list(CAST('0x' || substr(h, 13, 12) AS BIGINT) % {sharding.SLOTS - 1} + 1 ORDER BY i) AS stride FROM shards),
  fill(turn, taken, slot) AS (
    SELECT 0, list_transform(range({sharding.SLOTS}), lambda x: FALSE), NULL::BIGINT
    UNION ALL
    SELECT turn + 1, list_concat(list_concat(taken[1:s], [TRUE]), taken[s + 2:]), s FROM (
      SELECT turn, taken, list_filter(list_transform(range({sharding.SLOTS}), lambda j: (start[turn % {sharding.SHARDS} + 1] + j * stride[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS}), lambda x: NOT taken[x + 1])[1] AS s
      FROM fill, prefer WHERE turn < {sharding.SLOTS}))
  SELECT doc_id, f.slot, shard FROM documents JOIN fill f ON f.slot = {HEX.format("coalesce(doc_id::VARCHAR, text, '')")} % {sharding.SLOTS} JOIN shards ON i = (turn - 1) % {sharding.SHARDS}"""


#: Rounds of raking after which no digit that the query returns changes on these tables.
SQL_ROUNDS = 18


def op2() -> str:
    n = mixing.NONE
    upper, symbols = "length(regexp_replace(t, '[^A-Z]', '', 'g'))", "length(regexp_replace(t, '[^#*$%&<>]', '', 'g'))"
    topic = f"CASE WHEN contains(t, ' | ') THEN 'tabular' WHEN 10 * {symbols} > length(t) THEN 'symbolic' WHEN 2 * {upper} > length(t) THEN 'shouted' WHEN regexp_matches(t, '[0-9]') THEN 'personal' ELSE 'prose' END"
    out = [
        f"d AS (SELECT doc_id, text, coalesce(source, '{n}') AS source, coalesce(lang, '{n}') AS lang, {topic} AS topic, len({WORDS}) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "w0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL)",
        "every AS (SELECT sum(tokens) AS total FROM w0)",
    ]
    for x in mixing.DIMENSIONS:
        out.append(f"t_{x} AS (SELECT {x}, p / sum(p) OVER () AS share FROM (SELECT {x}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {mixing.POWERS[x]}) ELSE 0 END AS p FROM w0 GROUP BY 1))")
    k = 0
    for _ in range(SQL_ROUNDS):
        for x in mixing.DIMENSIONS:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN own > 0 THEN weight * share * total / own ELSE 0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {x}) AS own FROM w{k}) JOIN t_{x} USING ({x}), every)")
            k += 1
    out.append(f"r0 AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN weight / tokens END AS rate FROM w{k})")
    out.append("steps AS (SELECT floor(ln(rate) * 16) AS step, sum(tokens) AS tokens, max(rate) AS rate FROM r0 WHERE rate > 0 GROUP BY 1)")
    out.append(f"top AS (SELECT min_by(rate, step) AS top FROM (SELECT *, sum(tokens) OVER (ORDER BY step) AS upto, sum(tokens) OVER () AS every FROM steps) WHERE upto >= {mixing.FULL} * every)")
    out.append("r AS (SELECT source, lang, topic, round(coalesce(least(rate / top, 1), 1), 9) AS rate FROM r0, top)")
    u = HEX.format("coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))")
    return f"WITH {', '.join(out)} SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, {u} / {float(1 << 48)} < rate AS sampled FROM d JOIN r USING (source, lang, topic)"


def op7() -> str:
    b = "CASE WHEN length(bin({0})) > 5 THEN ({0} >> (length(bin({0})) - 5)::INT) << (length(bin({0})) - 5)::INT ELSE {0} END"
    ratio = {"symbols": (f"greatest(n_symbols - {quality.FREE_SYMBOLS}, 0)", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "word_len": ("word_chars", "n_words")}
    each = " UNION ALL ".join(f"SELECT k, lang, source, '{m}' AS metric, {c} * 1000 // greatest({d}, 1) AS v FROM c WHERE NOT bad" for m, (c, d) in ratio.items())
    width = "1 << greatest(length(bin({0})) - 5, 0)::INT"
    levels = {2: ("lang", "source"), 1: ("lang",), 0: ()}
    parts = []
    for level, keys in levels.items():
        cols = ", ".join([k if k in keys else f"NULL::VARCHAR AS {k}" for k in ("lang", "source")])
        group = ", ".join([*keys, "metric"])
        parts.append(f"""SELECT {level} AS level, {cols}, metric, max(total) AS docs, min(b) FILTER (WHERE upto * 4 >= total) AS q1, min(b) FILTER (WHERE upto * 4 >= total * 3) AS q3, min(b) FILTER (WHERE upto * {quality.TAIL[1]} >= total * {quality.TAIL[0]}) AS tail
          FROM (SELECT *, sum(n) OVER (PARTITION BY {group}) AS total, sum(n) OVER (PARTITION BY {group} ORDER BY b) AS upto FROM (SELECT {group}, b, count(*) AS n FROM m GROUP BY {group}, b)) GROUP BY {group}""")
    return f"""WITH w AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
      g AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
      twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS n FROM g) WHERE n > 1),
      rep AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY 1),
      ln AS (SELECT k, unnest(string_split(t, chr(10))) AS x FROM w),
      dup AS (SELECT k, count(*) - count(DISTINCT x) AS n, count(*) AS lines FROM ln WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
      c0 AS (SELECT k, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)),
      c AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS bad FROM c0),
      m AS (SELECT *, {b.format('v')} AS b FROM ({each})),
      q AS ({' UNION ALL '.join(parts)}),
      f AS (SELECT *, CASE WHEN metric IN {quality.SPREAD_METRICS} THEN q3 + {quality.FENCE} * (q3 - q1 + ({width.format('q3')})) ELSE tail + ({width.format('tail')}) END AS fence FROM q),
      v AS (SELECT m.k, bool_or(m.b > coalesce(f2.fence, f1.fence, f0.fence)) AS over FROM m
        LEFT JOIN f f2 ON f2.level = 2 AND f2.docs >= {quality.LEAST_DOCS} AND f2.metric = m.metric AND f2.lang IS NOT DISTINCT FROM m.lang AND f2.source IS NOT DISTINCT FROM m.source
        LEFT JOIN f f1 ON f1.level = 1 AND f1.docs >= {quality.LEAST_DOCS} AND f1.metric = m.metric AND f1.lang IS NOT DISTINCT FROM m.lang
        LEFT JOIN f f0 ON f0.level = 0 AND f0.metric = m.metric GROUP BY 1)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed, NOT bad AND NOT coalesce(over, FALSE) AS kept
      FROM c LEFT JOIN v USING (k)"""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def op11(levels: int = 24) -> str:
    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def tree(name: str, first: str, groups: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {groups}, i >> 1 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 1) // 2 AS n FROM {name}{k} WHERE n > 1 GROUP BY {groups}, i >> 1, n)")
        out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT {groups}, i, h, n, {k} AS k FROM {name}{k}" for k in range(levels + 1)) + ")")
        return out

    steps = [
        f"d0 AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS claimed FROM documents)",
        "d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d0)",
        *tree("t", "SELECT lang, pos AS i, leaf AS h, n FROM d", "lang"),
        "subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1)",
        *tree("s", "SELECT 0 AS one, pos AS i, h, n FROM subroots", "one"),
        # a row's way up: L and R are siblings at that side, N is a level without one
        "way AS (SELECT rid, t.k, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i < t.i THEN 'L' ELSE 'R' END AS side, coalesce(o.h, '') AS h FROM d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND t.i = d.pos >> t.k AND t.n > 1 LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM d.lang AND o.k = t.k AND o.i = xor(t.i, 1)"
        " UNION ALL SELECT rid, 100 + s.k, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i < s.i THEN 'L' ELSE 'R' END, coalesce(o.h, '') FROM d JOIN subroots r ON r.lang IS NOT DISTINCT FROM d.lang JOIN s ON s.i = r.pos >> s.k AND s.n > 1 LEFT JOIN s o ON o.k = s.k AND o.i = xor(s.i, 1))",
        "ways AS (SELECT rid, list(side || h ORDER BY k) AS way, string_agg(h, '' ORDER BY k) AS hs FROM way GROUP BY rid)",
        "f AS (SELECT d.*, coalesce(hs, '') AS hs, list_reduce(list_concat([claimed], coalesce(way, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM d LEFT JOIN ways USING (rid))",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, r.h AS subroot, s.h AS root, sha256(hs) AS proof_sha256, folded_root, folded_root = s.h AS verified FROM f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang JOIN s ON s.n = 1"


def op12() -> str:
    """The cheapest edits by one path for each grammar state, forward, turn by turn."""
    some = "coalesce({}::VARCHAR, ' ')".format
    space = "[^\\x20\\x09-\\x0D]"

    def go(s: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}} END"

    def least(*paths: str) -> str:
        return f"list_min([{', '.join(paths)}])"

    def when(test: str, path: str) -> str:
        return f"CASE WHEN {test} THEN {path} END"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    keep, to_user, to_assistant = "role || ':' || text || chr(10)", "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
    delete = {i: go(f"s{i}", "2", "D") for i in range(4)}
    before_user = [f"s{i}" for i in (0, 1, 3)]
    raw = {
        0: delete[0],
        1: least(delete[1], when("free AND x = 's'", go("s0", "more", "K", keep))),
        2: least(delete[2], *[when("free AND x = 'u'", go(s, "more", "K", keep)) for s in before_user], *[when("free", go(s, "more + 1", "R", to_user)) for s in before_user]),
        3: least(delete[3], when("free AND x = 'a'", go("s2", "more", "K", keep)), when("free", go("s2", "more + 1", "R", to_assistant))),
    }
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {some('role')} AS role, {some('text')} AS text, {crc32(some('conv_id') + " || ':' || " + some('turn'))} % 20 AS code FROM conversations),
      hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE code <> 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM hurt),
      faults AS (SELECT *, role[1] AS x, CASE WHEN NOT regexp_matches(text, '{space}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS px FROM o),
      r AS MATERIALIZED (SELECT *, fault IN ('', 'truncated') AS free, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM faults),
      steps AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {none} AS s1, {{'c': 5::BIGINT, 'a': 'I', 'r': {user}}} AS s2, {{'c': 10::BIGINT, 'a': 'II', 'r': {user} || {assistant}}} AS s3 FROM r
        UNION ALL
        SELECT conv_id, k, s0, s1, s2, {least('s3', go('s2', '5', 'I', assistant))} FROM (
          SELECT conv_id, k, s0, s1, {least('s2', go('s0', '5', 'I', user), go('s1', '5', 'I', user), go('s3', '5', 'I', user))} AS s2, s3 FROM (
            SELECT p.conv_id, r.k, {raw[0]} AS s0, {raw[1]} AS s1, {raw[2]} AS s2, {raw[3]} AS s3 FROM steps p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1))),
      best AS (SELECT conv_id, {least('s0', 's3')} AS s FROM steps p WHERE k = (SELECT max(n) FROM r WHERE r.conv_id IS NOT DISTINCT FROM p.conv_id)),
      sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
      SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(left(s.r, -1), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLE_SQL: dict[str, str] = {"op1_sharding": OP1, "op2_mixing": op2(), "op7_quality": op7(), "op11_merkle": op11(), "op12_turns": op12()}
