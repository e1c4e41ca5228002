"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from doccat.llm import chat, parity_join, secret_scan

_SPACE = r"[^\x20\x09-\x0D]"


def quality() -> str:
    """Windows are compared as words; the rules of the cascade are written out again."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '{_SPACE}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM d),
u AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
t AS (
  SELECT rid, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM f, range(3) AS o(k) WHERE n > 1 GROUP BY rid),
m AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         1 + len(regexp_extract_all(text, '\n')) AS n_lines
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * len(regexp_extract_all(text, '\p{{Lu}}')) > len(regexp_extract_all(text, '\p{{L}}'))
            OR 2 * len(regexp_extract_all(text, '{_SPACE}*\p{{L}}{_SPACE}*')) < n_words
            OR 3 * len(regexp_extract_all(text, '!!')) > n_words
            OR 10 * len(regexp_extract_all(text || chr(10), '(?:\.\.\.|\x{{2026}})\n')) > 4 * n_lines
            OR 10 * len(regexp_extract_all(chr(10) || text, '\n[-*\x{{2022}}] ')) > 9 * n_lines) AS kept
FROM b"""


def chat_views() -> str:
    begin, end = chat.BEGIN, chat.END.replace("\n", "' || chr(10) || '")
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                ELSE 'user name=' || speaker END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, '{begin}' || role || chr(10) || text || '{end}' AS segment FROM r),
o AS (
  SELECT *, row_number() OVER v - 1 AS turn_no, sum(length(segment)) OVER v AS stop FROM s
  WINDOW v AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, turn_no::BIGINT AS turn_no, speaker, role, segment,
       (stop - length(segment))::BIGINT AS start, stop::BIGINT AS "end",
       CASE WHEN role = 'assistant' THEN (stop - length(segment) + {len(begin) + 10})::BIGINT END AS mask_start,
       CASE WHEN role = 'assistant' THEN (stop - 1)::BIGINT END AS mask_end
FROM o"""


def secrets() -> str:
    parts = []
    for no, rule in enumerate(secret_scan.RULES, 1):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, '{rule.kind}' AS kind, {no} AS no, unnest(regexp_extract_all(text, '{pattern}', 0)) AS hit,
         unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS part,
         unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}', 0)))) AS gap,
         unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS i, {rule.least} AS least
  FROM d WHERE regexp_matches(text, '{pattern}')""")
    kinds = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    counts = ", ".join(f"(count(*) FILTER (kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT rid, kind, no, length(part) AS size, least, length(hit) AS n,
         sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM h),
k AS (SELECT rid, kind, no, (stop - n)::BIGINT AS b, stop::BIGINT AS e FROM s WHERE size >= least),
g AS (
  SELECT rid, {counts},
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (kind IN ({kinds})) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) AS spans
  FROM k GROUP BY rid)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


def near_duplicates() -> str:
    """All pairs of documents that share a shingle, then their components."""
    n = parity_join.SHINGLE
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {n} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) END AS shingles FROM d),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(reach.b), s.doc_id))::BIGINT AS component_id
FROM s LEFT JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, len(shingles)"""


def neighbours() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


def warc_records() -> str:
    """SHA-1 in base32: five hexadecimal digits are four of base 32."""
    groups = " || ".join(f"to_base(('0x' || substr(hex, {1 + 5 * k}, 5))::BIGINT, 32, 4)" for k in range(8))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, translate(upper({groups}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN coalesce(page_id = top, top IS NULL) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT coalesce(page_id = top, top IS NULL) THEN top END AS refers_to
FROM d"""


def audit() -> str:
    """Every document against every order, without masks or packing."""
    first = " ".join(f"WHEN substr(filter_order, {s}, 1) = ANY(fails) THEN {s}" for s in range(1, 6))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter([CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
                      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
                      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY ALL),
s(x) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT part, filter_order, fails, n, g, t, CASE {first} END AS gone FROM c, o),
q AS (
  SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS filter,
         coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone < step AND substr(filter_order, step::INTEGER, 1) = ANY(fails)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [substr(filter_order, step::INTEGER, 1)]), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(t) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM r, range(1, 6) AS k(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM q"""


ORACLES: dict[str, str] = {
    "op3_quality": quality(),
    "op4_chat": chat_views(),
    "op5_secrets": secrets(),
    "op6_parity_join": near_duplicates(),
    "op9_neighbours": neighbours(),
    "op12_warc_chunks": warc_records(),
    "op13_filter_audit": audit(),
}
