"""SQL equivalents of training-text queries, for DuckDB, where SQL can say them; the others are tested in tests/llm.

Percentiles are exact in SQL; digests are exact too up to some 12,600 rows a group, beyond that they keep to their bound.
"""

from __future__ import annotations

from turnwise.llm import markup, quality, repetition

_S = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
_AT = "CASE WHEN regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN try_strptime(created_at, '%Y-%m-%d %H:%M:%S') END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPOKEN = f"regexp_replace(regexp_replace(regexp_replace(transcription_text, '\\r\\n?', chr(10), 'g'), {_q(markup.HEAD)}, '', 'g'), {_q(markup.SOUND)}, ' ', 'g')"

# per transcript (once): words, and how many stand in runs of four said before
_REPEATED = rf"""
    said AS (SELECT DISTINCT id, regexp_extract_all(lower(coalesce({_SPOKEN}, '')), {_q("[\\p{L}\\p{N}]+(?:['’ʼ-][\\p{L}\\p{N}]+)*")}) AS w FROM sample_multiline),
    runs AS (SELECT id, i, w[i:i + {repetition.RUN - 1}] AS run FROM (SELECT id, w, unnest(range(1, len(w) - {repetition.RUN - 2})) AS i FROM said)),
    again AS (SELECT id, i FROM runs QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY i) > 1),
    hit AS (SELECT id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range({repetition.RUN})) AS k) GROUP BY 1),
    shares AS (SELECT id, len(w) AS n_words, coalesce(n, 0) AS n_repeated, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) END AS repeated_share FROM said LEFT JOIN hit USING (id))"""
_LINES = rf"""
    texts AS (SELECT DISTINCT id, coalesce(telegram_user_internal_id, '') AS host, list_filter(list_transform(string_split(lower({_SPOKEN}), chr(10)), lambda x: trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM sample_multiline),
    docs AS (SELECT * FROM texts WHERE len(l) > 0),
    every AS (SELECT host, id, unnest(l) AS line FROM docs),
    often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT id) AS n FROM every GROUP BY 1, 2) JOIN (SELECT host, count(*) AS docs FROM docs GROUP BY 1) USING (host) WHERE n > 20 AND n > 0.01 * docs),
    counted AS (SELECT id, host, count(*) AS n_lines, count(often.line) AS n_removed FROM every LEFT JOIN often USING (host, line) GROUP BY 1, 2)"""


def _quantiles(groups: str, name: str) -> str:
    """The least value with at least q * n values up to it, per group."""
    return f"""WITH t AS (SELECT DISTINCT id, CASE WHEN trim(telegram_user_internal_id) <> '' THEN telegram_user_internal_id END AS u, {_AT} AS ts FROM sample_multiline), g AS ({groups}),
        r AS (SELECT grp, ts, row_number() OVER (PARTITION BY grp ORDER BY ts) AS upto, count(*) OVER (PARTITION BY grp) AS n FROM g)
        SELECT grp AS {name}, n, q, min(ts) FILTER (upto >= q * n) AS created_at, CAST(floor(n * 0.005) AS BIGINT) AS max_rank_error FROM r, (SELECT CAST(unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS q) GROUP BY grp, n, q"""


def _statistics() -> str:
    ends, closers = "[.!?…]", "[\"»”'')\\]]"
    line = lambda p: f"len(list_filter(l, lambda x: regexp_matches(x, '{p}')))"
    ratio = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} END, 6)"
    return rf"""WITH s AS (SELECT DISTINCT id, coalesce({_SPOKEN}, '') AS t FROM sample_multiline),
        w AS (SELECT id, t, string_split(t, chr(10)) AS l, list_filter(string_split_regex(t, '[{_S}]+'), lambda x: x <> '') AS words, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}]+') AS tokens FROM s),
        c AS (SELECT id, len(words) AS n_words, {line(f'[^{_S}]')} AS n_lines, length(array_to_string(words, '')) AS visible, len(regexp_extract_all(t, '[^\p{{L}}\p{{M}}\p{{N}}{_S}]')) AS symbols, {line(f'{ends}{closers}?[{_S}]*$')} AS punctuated, {line(f'(?:…|[.][.][.])[{_S}]*$')} AS ellipses,
               len(list_filter(words, lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}]'))) AS lettered, len(tokens) AS n_tokens, len(list_filter(tokens, lambda x: list_contains(known, x))) AS n_common FROM w, (SELECT list(DISTINCT lower(word)) AS known FROM common_words WHERE word <> ''))
        SELECT id, n_words, n_lines, n_common, {ratio('visible', 'n_words')} AS mean_word_length, {ratio('symbols', 'visible')} AS symbol_ratio, {ratio('punctuated', 'n_lines')} AS punctuated_share, {ratio('ellipses', 'n_lines')} AS ellipsis_share,
               {ratio('lettered', 'n_words')} AS letter_share, {ratio('n_common', 'n_tokens')} AS common_share, n_words BETWEEN 1 AND {quality.MIN_WORDS - 1} AS too_few_words, n_words > 0 AND n_common < {quality.STOP_WORDS} AS no_common_words FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_statistics": _statistics(),
        "p4_percentiles": _quantiles("SELECT u AS grp, ts FROM t WHERE ts IS NOT NULL AND u IS NOT NULL UNION ALL SELECT '*', ts FROM t WHERE ts IS NOT NULL", '"user"'),
        "p4_days": _quantiles("SELECT strftime(ts, '%Y-%m') AS grp, ts FROM t WHERE ts IS NOT NULL", "month"),
        "p7_found": f"WITH {_REPEATED} SELECT DISTINCT id FROM shares WHERE repeated_share >= {repetition.REPEATED_SHARE}",
        "p7_shares": f"""WITH {_REPEATED}, {_LINES} SELECT id, n_words, n_repeated, round(repeated_share, 6) AS repeated_share, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
            FROM shares LEFT JOIN (SELECT id, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_removed) AS BIGINT) AS n_removed FROM counted GROUP BY 1) c USING (id)""",
        "p7_lines": f"WITH {_LINES} SELECT id, host, n_lines, n_removed, n_lines - n_removed < 0.5 * n_lines AS rejected FROM counted",
    }
