"""DuckDB SQL for the rows of op6 and op8, written from their rules and not from their expressions.

Fixed phrases, labels and placeholders are read from the operators; everything else is stated here.
The SQL takes doc_id as the key of `documents`, as the given tables have it.
"""

from __future__ import annotations

from . import quality_rules, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PHRASES = " OR ".join(f"contains(small, {_text(p)})" for p in quality_rules.BOILERPLATE)
_LABELS = ", ".join(map(_text, quality_rules.LABELS))

QUALITY_RULES = rf"""
WITH split AS (
    SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line
    FROM documents
),
lines AS (
    SELECT *, lower(line) AS small, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM split
),
judged AS (
    SELECT *, len(words) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|•»]')) AS links
    FROM lines
),
kept AS (
    SELECT *, n = 0 OR NOT (
        symbols > n * 0.5::DOUBLE
        OR length(line) - length(replace(line, '!!', '!')) > n * 0.3::DOUBLE
        OR (links >= 2 AND links * 4 >= n)
        OR (n <= 3 AND trim(small, ' ') IN ({_LABELS}))
        OR (n BETWEEN 2 AND 12 AND len(list_filter(words, lambda w: NOT regexp_matches(w, '^[\p{{Lu}}\p{{Lt}}]'))) = 0 AND NOT regexp_matches(line, '[.!?…:;,"]'))
        OR {_PHRASES}
        OR (n >= 5 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
        OR (n >= 10 AND len(list_distinct(words)) < n * 0.2::DOUBLE)
    ) AS stays
    FROM judged
),
figures AS (
    SELECT doc_id, sum(n)::BIGINT AS n_words, sum(length(array_to_string(words, '')))::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
        (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines,
        coalesce(sum(length(array_to_string(words, ''))) FILTER (stays), 0)::BIGINT AS clean_chars
    FROM kept GROUP BY doc_id
),
tokens AS (
    SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS p
    FROM (SELECT doc_id, i, generate_subscripts(words, 1) AS j, unnest(words) AS w FROM lines)
),
fives AS (
    SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five FROM tokens
),
twice AS (
    SELECT doc_id, unnest(list(p)) AS p FROM fives WHERE len(five) = 5 GROUP BY doc_id, five HAVING count(*) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT p + d)::BIGINT AS n_repeat_words FROM twice, (VALUES (0), (1), (2), (3), (4)) AS places(d) GROUP BY doc_id
),
all_figures AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
    FROM (SELECT figures.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM figures LEFT JOIN covered USING (doc_id))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(1 - clean_chars::DOUBLE / nullif(word_chars, 0), 0) <= 0.5 AS kept
FROM all_figures
"""

#: Kind, pattern, group of the value, least length. Letters in either case are spelt out: here (?i) would also fold other letters.
_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("other", "[A-Za-z0-9_+/=-]+", 0, 20),
)


def _found(rank: int) -> str:
    """Spans of a kind: the text is cut at its matches, lengths of pieces and matches give the positions."""
    kind, pattern, group, least = _KINDS[rank]
    p = _text(pattern)
    mixed = " AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')" if kind == "other" else ""
    return f"""
    SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, stop - length(match) AS start, stop, value
    FROM (
        SELECT doc_id, owner, match, value, (sum(length(piece) + length(match)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS stop
        FROM (
            SELECT doc_id, owner, generate_subscripts(matches, 1) AS k, unnest(matches) AS match, unnest(regexp_extract_all(text, {p}, {group})) AS value,
                unnest(list_slice(regexp_split_to_array(text, {p}), 1, len(matches))) AS piece
            FROM (SELECT *, regexp_extract_all(text, {p}, 0) AS matches FROM texts)
        )
    )
    WHERE length(value) >= {least}{mixed}"""


SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_found(k) for k in range(3))}),
wide AS ({_found(3)}),
candidates AS (
    SELECT * FROM base
    UNION ALL
    SELECT * FROM wide WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = wide.doc_id AND base.start < wide.stop AND base.stop > wide.start)
),
spread AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT doc_id) AS documents FROM candidates GROUP BY value),
judged AS (
    SELECT *, kind || ':' || start || ':' || stop AS span, owners || ':' || documents AS held,
        owners <= 1 AND documents <= 10 AND NOT regexp_matches(value, {_text(secrets.PLACEHOLDER)}) AS live
    FROM candidates JOIN spread USING (value)
),
by_base AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS written
    FROM base GROUP BY doc_id
),
by_text AS (
    SELECT doc_id, string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
        string_agg(span, ',' ORDER BY start, rank) FILTER (live) AS live_spans, string_agg(held, ',' ORDER BY start, rank) AS spread
    FROM judged WHERE live OR rank < 3 GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(written, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live_spans, '') AS live_spans, coalesce(spread, '') AS spread
FROM documents LEFT JOIN by_base USING (doc_id) LEFT JOIN by_text USING (doc_id)
"""
