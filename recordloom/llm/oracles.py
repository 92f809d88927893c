"""SQL that gives what queries of this subpackage give, where SQL can."""

from __future__ import annotations

from . import quality_rules as q

_GAP = r"[ \t\n\x0B\f\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_GAP}'), lambda x: x <> '')"


def _numbers(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _distance(counts: str, total: str, reference: list[float]) -> str:
    """Jensen-Shannon distance of a list of counts from a reference."""
    size = sum(reference)
    pairs = f"list_zip(list_transform({counts}, lambda n: n / {total}::DOUBLE), {_numbers([v / size for v in reference])})"
    p, r = "z[1]", "z[2]"
    m = f"(({p} + {r}) / 2)"
    part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * ln({v} / {m}) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform({pairs}, lambda z: {part(p)} + {part(r)})), 0) / (2 * ln(2)))"


def _quality() -> str:
    classes = [_LOWER, _UPPER, None, "0123456789", "#*$%&|<>", ".,;:!?''\"()-"]
    left, steps = "t", []
    for k, c in enumerate(classes):
        gone = f"regexp_replace({left}, '{_GAP}', '', 'g')" if c is None else f"translate({left}, '{c}', '')"
        steps.append(f"s{k} AS (SELECT *, {gone} AS t{k}, length({left}) - length({gone}) AS c{k} FROM {f's{k - 1}' if k else 'w'})")
        left = f"t{k}"
    every = sorted({w for some in q.COMMON_WORDS.values() for w in some})
    of_class = ", ".join(_distance("classes", "n_chars", q.CLASS_SHARES[x]) for x in q.LANGUAGES)

    def of_words(name: str) -> str:
        own = [f"common[{every.index(w) + 1}]" for w in q.COMMON_WORDS[name]]
        return _distance(f"[{', '.join(own)}, n_words - ({' + '.join(own)})]", "n_words", q.word_shares(name))

    word_list = "[" + ", ".join(f"'{w}'" for w in every) + "]"
    of_word = ", ".join(of_words(x) for x in q.LANGUAGES)
    steps_sql = ",\n".join(steps)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w FROM documents),
{steps_sql},
places AS (SELECT doc_id, i, w[i:i + 4] AS run FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
twice AS (SELECT doc_id, run FROM places GROUP BY doc_id, run HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM places JOIN twice USING (doc_id, run), range(0, 5) r(j) GROUP BY doc_id),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (length(t) - c2)::BIGINT AS word_chars, c4::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(t) AS n_chars, [c0, c1, c2, c3, c4, c5, length(t5)] AS classes,
    list_transform({word_list}, lambda e: len(list_filter(found, lambda x: x = e))) AS common
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines,
      list_transform(w, lambda x: lower(rtrim(x, '{q.END_MARKS}'))) AS found FROM s5) LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
    CASE WHEN n_words > 0 THEN round(least({of_class}), 9) END AS class_distance,
    CASE WHEN n_words > 0 THEN round(least({of_word}), 9) END AS word_distance
  FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {q.CLASS_WORDS} OR class_distance <= {q.CLASS_LIMIT!r}::DOUBLE + {q.CLASS_CHANCE!r}::DOUBLE / n_words)
    AND (n_words < {q.WORD_WORDS} OR word_distance <= {q.WORD_LIMIT!r}::DOUBLE + {q.WORD_CHANCE!r}::DOUBLE / sqrt(n_words)) AS kept,
  class_distance, word_distance
FROM judged"""


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
firsts AS (SELECT run, min(doc_id) AS f FROM places GROUP BY run),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS spots FROM places JOIN firsts USING (run), range(0, 13) r(j) WHERE f < doc_id GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN spots IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(spots, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, v FROM reach JOIN both_ways ON u = r),
least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id USING (doc_id)"""

# Every order spelt out: each kind of document is sent through all 120.
FILTER_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1) AS toxic
  FROM documents),
first AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
fails AS (
  SELECT part, good, toxic, list_filter([CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN first_id < doc_id THEN 'E' END], lambda x: x IS NOT NULL) AS f
  FROM d JOIN first USING (t)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS x FROM orders, range(1, 6) s(step)),
masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM fails GROUP BY part, f),
taken AS (
  SELECT part, filter_order, o.step, m.f, n, n_good, n_toxic, o.x, list_contains(m.f, o.x) AS failing,
    len(list_filter(m.f, lambda y: instr(filter_order, y) < o.step)) > 0 AS gone
  FROM masks m, steps o),
counted AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing AND len(f) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM taken GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""

# Bytes as two hex digits each; every string of 400 bytes is looked at.
SUFFIX_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM d, LATERAL (SELECT unnest(range(0, strlen(x) // 2 - 399)) AS i)),
often AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM strings JOIN often USING (h)),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
between_spans AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cleaned AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM between_spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cleaned USING (doc_id)"""

# crc32 bit by bit, as DuckDB has no function for it.
PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
      list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))),
      4294967295::BIGINT) % 9 AS h
  FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
paths AS (
  SELECT c.conv_id AS conv, coalesce(p, []) AS p, coalesce(s, []) AS s
  FROM c LEFT JOIN (
    SELECT conv_id, list(md5(length(role)::VARCHAR || ' ' || role || text) ORDER BY own, place) AS p, list(strlen(text) ORDER BY own, place) AS s
    FROM rebuilt GROUP BY conv_id) r ON r.conv_id = c.conv_id),
members AS (SELECT conv, d, array_to_string(p[1:d], '') AS path, array_to_string(p[1:d - 1], '') AS above, coalesce(s[d], 0) AS size, d = len(p) AS ending FROM paths, LATERAL (SELECT unnest(range(0, len(p) + 1)) AS d)),
nodes AS (
  SELECT path, d, min(conv) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(above) AS above,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ending), '')) AS ends_sha256
  FROM members GROUP BY path, d),
kids AS (SELECT above AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above, d),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, d)),
sums AS (
  SELECT m.path, m.d, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
  FROM full_nodes u JOIN members m ON m.conv = u.conv_id AND m.d <= u.d GROUP BY m.path, m.d)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM full_nodes v JOIN sums USING (path, d) LEFT JOIN nodes up ON up.path = v.above AND up.d = v.d - 1"""

ORACLES = {"op2_quality_rules": _quality(), "op5_substring_dedup": SUBSTRINGS, "op6_minhash": MINHASH, "op11_suffix_repeats": SUFFIX_REPEATS, "op12_prefix_trie": PREFIX_TRIE, "op13_filter_audit": FILTER_AUDIT}
