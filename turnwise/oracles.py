"""SQL equivalents of the transcript operators, for DuckDB.

They reach the results another way than the operators: texts become rows of lines, and windows over lines find chunks, blocks
and segments. Patterns are those of RE2; white space is spelled out, as RE2 knows the ASCII one only.
"""

from __future__ import annotations

from turnwise.operators import category, language, raw_summary

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
W = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_BLANK = r"[\t \f\x0B\r]"
_NAME = r"(?i:SPEAKER_(?:\d+|[A-Z]{1,3}))"
HEADER = rf"^{_BLANK}*(?:\[\s*{_NAME}\s*\]|{_NAME}){_BLANK}*$"
CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?"
INLINE = rf"^({CLOCK})\s*[-–—]\s*({CLOCK})\s*:[ ]?"
INLINE_HEAD = rf"^{_BLANK}*{CLOCK}\s*[-–—]\s*{CLOCK}\s*:"
BRACKET = rf"\[\s*({CLOCK})\s*[-–—]\s*({CLOCK})\s*\]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def blank(x: str) -> str:
    return f"NOT regexp_matches({x}, '[^{W}]')"


def seconds(clock: str) -> str:
    p = f"string_split(regexp_replace({clock}, '\\..*$', ''), ':')"
    return f"CASE WHEN len({p}) = 3 THEN CAST(CAST({p}[1] AS INT) * 3600 + CAST({p}[2] AS INT) * 60 + CAST({p}[3] AS INT) AS DOUBLE) END"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(pattern)}))"


def chars_of(x: str, pattern: str) -> str:
    """How many characters runs of the pattern take."""
    return f"(length({x}) - length(regexp_replace({x}, {_q(pattern)}, '', 'g')))"


# one row per row of the table (rid) and segment (seg_no from 0)
SEGMENT_ROWS = f"""
    src AS (SELECT row_number() OVER () AS rid, * FROM sample_multiline),
    lines AS (SELECT rid, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT rid, string_split(regexp_replace(coalesce(transcription_text, ''), '{LINE_ENDS}', chr(10), 'g'), chr(10)) AS l FROM src)),
    cut AS (SELECT *, regexp_full_match(line, '-{{20,}}{_BLANK}*') AS sep FROM lines),
    chunked AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS chunk FROM cut),
    spanned AS (SELECT *, min(CASE WHEN NOT ({blank('line')}) THEN i END) OVER c AS lo, max(CASE WHEN NOT ({blank('line')}) THEN i END) OVER c AS hi FROM chunked WHERE NOT sep WINDOW c AS (PARTITION BY rid, chunk)),
    trimmed AS (SELECT rid, chunk, i, CASE WHEN i = lo AND i = hi THEN {stripped('line')} WHEN i = lo THEN regexp_replace(line, '^[{W}]+', '') WHEN i = hi THEN regexp_replace(line, '[{W}]+$', '') ELSE line END AS line FROM spanned WHERE i BETWEEN lo AND hi),
    headed AS (SELECT *, regexp_matches(line, {_q(HEADER)}) AS head FROM trimmed),
    blocked AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY rid, chunk ORDER BY i) AS block FROM headed),
    opened AS (SELECT *, max(CASE WHEN head THEN upper(regexp_extract(line, {_q('(' + _NAME + ')')}, 1)) END) OVER b AS speaker, min(CASE WHEN NOT head AND NOT ({blank('line')}) THEN i END) OVER b AS f FROM blocked WINDOW b AS (PARTITION BY rid, chunk, block)),
    kinds AS (SELECT *, CASE WHEN block = 0 OR head THEN 'plain' WHEN i = f AND regexp_matches({stripped('line')}, {_q(INLINE)}) THEN 'first_inline' WHEN i = f AND regexp_matches(line, {_q(BRACKET)}) THEN 'bracket'
                      WHEN i = f THEN 'prose' WHEN i > f AND regexp_matches(line, {_q(INLINE_HEAD)}) THEN 'inline' ELSE 'plain' END AS kind FROM opened),
    numbered AS (SELECT *, sum(CASE WHEN kind = 'inline' THEN 1 ELSE 0 END) OVER (PARTITION BY rid, chunk, block ORDER BY i) AS part, regexp_replace({stripped('line')}, {_q(INLINE)}, '') AS said FROM kinds),
    bodied AS (SELECT *, CASE WHEN head OR kind = 'bracket' THEN NULL WHEN kind IN ('inline', 'first_inline') THEN CASE WHEN {blank('said')} THEN NULL ELSE said END ELSE line END AS kept FROM numbered),
    found AS (SELECT rid, chunk, block, part, any_value(speaker) AS speaker, coalesce(string_agg(kept, chr(10) ORDER BY i), '') AS body, bool_or(kind IN ('inline', 'first_inline', 'bracket')) AS has_timestamp, bool_or(kind = 'prose') AS malformed,
                     max(CASE WHEN kind IN ('inline', 'first_inline') THEN {seconds(f"regexp_extract({stripped('line')}, {_q(INLINE)}, 1)")} WHEN kind = 'bracket' THEN {seconds(f"regexp_extract(line, {_q(BRACKET)}, 1)")} END) AS start_s,
                     max(CASE WHEN kind IN ('inline', 'first_inline') THEN {seconds(f"regexp_extract({stripped('line')}, {_q(INLINE)}, 2)")} WHEN kind = 'bracket' THEN {seconds(f"regexp_extract(line, {_q(BRACKET)}, 2)")} END) AS end_s
              FROM bodied GROUP BY 1, 2, 3, 4),
    segs AS (SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY chunk, block, part) - 1 AS INTEGER) AS seg_no, speaker, body, has_timestamp, malformed, start_s, end_s FROM found WHERE speaker IS NOT NULL OR has_timestamp OR NOT ({blank('body')}))"""
SEGMENTS = f"WITH {SEGMENT_ROWS} SELECT id, seg_no, speaker, body, has_timestamp, malformed, start_s, end_s FROM segs JOIN src USING (rid)"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{W}]+'), lambda x: x <> '')"


_NORMAL = f"lower(regexp_replace({stripped('body')}, '[{W}]+', ' ', 'g'))"
LAYER_A_ROWS = f"""
    measured AS (SELECT *, len({_tokens('body')}) AS w, length(body) AS c, {_NORMAL} AS norm, coalesce(start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s, FALSE) AS timed FROM segs),
    spoken AS (SELECT rid, count(*) FILTER (speaker <> before) AS switches FROM (SELECT rid, speaker, lag(speaker) OVER (PARTITION BY rid ORDER BY seg_no) AS before FROM segs WHERE speaker IS NOT NULL) GROUP BY 1),
    twins AS (SELECT rid, count(*) AS m, count(*) FILTER (norm = before) AS twins FROM (SELECT rid, norm, lag(norm) OVER (PARTITION BY rid ORDER BY seg_no) AS before FROM measured WHERE norm <> '') GROUP BY 1),
    a AS (SELECT rid, count(*) AS n, count(DISTINCT speaker) AS speakers, CAST(median(w) AS DOUBLE) AS mw, CAST(median(c) AS DOUBLE) AS mc, max(w) AS xw, count(*) FILTER (speaker IS NOT NULL AND (malformed OR NOT has_timestamp)) AS bad,
                 coalesce(sum(end_s - start_s) FILTER (timed), 0.0) AS covered, coalesce(max(end_s) FILTER (timed) - min(start_s) FILTER (timed), 0.0) AS span, count(*) FILTER (timed) AS n_timed FROM measured GROUP BY 1),
    layer_a AS (SELECT src.rid, coalesce(n, 0) AS layer_a_segment_count, CASE WHEN {stripped("coalesce(transcription_text, '')")} = '' THEN 0 ELSE (SELECT count(*) FROM cut WHERE cut.rid = src.rid AND sep) END AS layer_a_separator_count,
                 coalesce(speakers, 0) AS layer_a_distinct_speakers, mw AS layer_a_median_words_per_segment, mc AS layer_a_median_chars_per_segment, xw AS layer_a_max_words_per_segment, coalesce(bad, 0) / greatest(coalesce(n, 0), 1) AS layer_a_malformed_timestamp_ratio,
                 CASE WHEN coalesce(m, 0) > 1 THEN twins / (m - 1) ELSE 0.0 END AS layer_a_duplicate_adjacent_segment_ratio, coalesce(switches, 0) AS layer_a_speaker_switch_count, coalesce(switches, 0) / greatest(coalesce(n, 0), 1) AS layer_a_speaker_switch_rate,
                 CAST(coalesce(switches, 0) > greatest(5, coalesce(n, 0)) AND coalesce(switches, 0) / greatest(coalesce(n, 0), 1) > 0.8 AS TINYINT) AS layer_a_unreasonable_speaker_churn, coalesce(covered, 0.0) AS layer_a_duration_covered_seconds, coalesce(span, 0.0) AS layer_a_duration_span_seconds,
                 CASE WHEN coalesce(span, 0.0) > 0 THEN covered / span ELSE 0.0 END AS layer_a_duration_coverage_ratio, coalesce(n_timed, 0) / greatest(coalesce(n, 0), 1) AS layer_a_segments_with_duration_ratio
               FROM src LEFT JOIN a USING (rid) LEFT JOIN spoken USING (rid) LEFT JOIN twins USING (rid))"""


def sample(t: str, n: int) -> str:
    if n <= 0:
        return t
    wing = n // 3
    mid = n - 2 * wing
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {wing}) || substr({t}, CAST(greatest(0, floor((length({t}) - {mid}) / 2)) AS BIGINT) + 1, {mid}) || substr({t}, length({t}) - {wing - 1}, {wing}) END"


def language_rows(source: str, key: str, text: str) -> str:
    """CTEs up to ``lang`` (key, iso, confidence, mixed) of the texts of ``source``."""
    table = {k: v.split() for k, v in language.SMALL_WORDS.items()}
    counted = []
    for iso in table:
        there = "cyrillic" if iso in language.CYRILLIC else "latin"
        runs = lambda p: f"(?:{p})+" if "|" in p else f"{p}+"
        own = f"({chars_of('low', runs(language.LETTERS[iso]))} - {chars_of('low', runs(language.AGAINST[iso]))})"
        words = ", ".join(_q(w) for w in table[iso])
        counted.append(f"('{iso}', greatest({there} / greatest(cyrillic + latin, 1) * (0.05 + 2 * (len(list_filter(words, lambda w: w IN ({words}))) / greatest(len(words), 1)) + 2 * (CASE WHEN {there} > 0 THEN {own} ELSE 0 END) / greatest(cyrillic + latin, 1)), 0.0))")
    return rf"""
    lang_low AS (SELECT {key}, lower({text}) AS low FROM {source}),
    lang_count AS (SELECT *, {chars_of('low', '[' + chr(92) + 'p{Cyrillic}]+')} AS cyrillic, {chars_of('low', '[' + chr(92) + 'p{Latin}]+')} AS latin, regexp_extract_all(low, '\p{{L}}+') AS words FROM lang_low),
    lang_each AS (SELECT {key}, cyrillic, latin, unnest([{', '.join(f"struct_pack(iso := {c[1:c.index(',')]}, score := {c[c.index(',') + 2:-1]})" for c in counted)}]) AS s FROM lang_count),
    lang_rank AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s.score DESC, s.iso DESC) AS r, sum(s.score) OVER (PARTITION BY {key}) AS total FROM lang_each),
    lang AS (SELECT {key}, CASE WHEN known THEN iso ELSE '' END AS iso, CASE WHEN known THEN first / total ELSE 0.0 END AS confidence, CASE WHEN known THEN scripts OR (first - second) / total < {language.MIXED_GAP} ELSE FALSE END AS mixed
             FROM (SELECT {key}, any_value(cyrillic + latin) > 0 AND any_value(total) > 0 AS known, max(s.iso) FILTER (r = 1) AS iso, max(s.score) FILTER (r = 1) AS first, max(s.score) FILTER (r = 2) AS second, any_value(total) AS total,
                   any_value(least(cyrillic, latin) > {language.SECOND_SHARE} * (cyrillic + latin)) AS scripts FROM lang_rank GROUP BY 1))"""


DETECT = f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {language_rows('docs', 'doc_id', 't')} SELECT doc_id, iso, round(confidence, 6) AS confidence, mixed FROM lang"


def _category_rows() -> str:
    line = "line"
    for p in (r"(?i)\[?SPEAKER_\d+\]?", r"\[\d{2}:\d{2}:\d{2}.*?\]", rf"\d{{2}}:\d{{2}}:\d{{2}}[{W}]*-[{W}]*\d{{2}}:\d{{2}}:\d{{2}}:?"):
        line = f"regexp_replace({line}, {_q(p)}, '', 'g')"
    hits = ", ".join(f"len(list_intersect(words, [{', '.join(_q(w) for w in words)}])) AS h_{c}" for c, words in category.KEYWORDS.items())
    names = list(category.KEYWORDS)
    cover = {c: f"least(1.0, h_{c} / {len(category.KEYWORDS[c])})" for c in names}
    top = f"greatest({', '.join(cover.values())}) < {category.DIALOGUE_MAX_COVERAGE} AND greatest({', '.join('h_' + c for c in names)}) <= {category.DIALOGUE_MAX_HITS}"
    entries = [f"CASE WHEN h_{c} > 0 THEN struct_pack(s := {cover[c]}, o := -{category.ORDER.index(c)}, c := '{c}') END" for c in names]
    entries.append(f"CASE WHEN (speakers >= 2 OR switches > 3) AND h_business_work = 0 AND h_support = 0 AND {top} THEN struct_pack(s := least(1.0, ln(1 + speakers + 2 * switches) / ln(1 + {category.DIALOGUE_FULL})), o := -{category.ORDER.index('dialogue_meeting')}, c := 'dialogue_meeting') END")
    brackets = r"\[(?:noise|music|silence|applause|неразборчиво)\]"
    return rf"""
    cat_lines AS (SELECT rid, seg_no, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT rid, seg_no, string_split(body, chr(10)) AS l FROM segs)),
    cat_clean AS (SELECT rid, seg_no, i, {stripped(line)} AS x FROM cat_lines),
    cat_text AS (SELECT rid, string_agg(x, ' ' ORDER BY seg_no, i) AS t FROM cat_clean WHERE length(x) > 2 GROUP BY 1),
    cat_talk AS (SELECT rid, count(DISTINCT speaker) AS speakers, count(*) FILTER (speaker <> before) AS switches FROM (SELECT rid, speaker, lag(speaker) OVER (PARTITION BY rid ORDER BY seg_no) AS before FROM segs) GROUP BY 1),
    cat_words AS (SELECT src.rid, coalesce(t, '') AS t, coalesce(speakers, 0) AS speakers, coalesce(switches, 0) AS switches, {count("lower(coalesce(t, ''))", "[A-Za-zА-Яа-яЁё0-9'-]{3,}")} AS n,
                   list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(t, '')), {_q(brackets)}, ' ', 'g'), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}]+')) AS words FROM src LEFT JOIN cat_text USING (rid) LEFT JOIN cat_talk USING (rid)),
    cat_hits AS (SELECT *, {hits} FROM cat_words),
    cat_ranked AS (SELECT rid, t, n, list_reverse_sort(list_filter([{', '.join(entries)}], lambda r: r IS NOT NULL)) AS r FROM cat_hits),
    cat AS (SELECT rid, CASE WHEN {blank('t')} THEN 'empty' WHEN len(r) > 0 THEN r[1].c WHEN n < 15 THEN 'short_note' WHEN n < 60 THEN 'quick_message' ELSE 'general_monologue' END AS "primary",
              CASE WHEN {blank('t')} THEN 0.0 WHEN len(r) > 0 THEN round_even(CASE WHEN len(r) > 1 AND r[2].s > 1e-12 THEN least(1.0, r[1].s / r[2].s) ELSE least(1.0, r[1].s / {category.LONE_STRENGTH}) END, 3)
                   ELSE round_even(least(1.0, 10.0 / greatest(5, n) * 0.8), 3) END AS confidence FROM cat_ranked)"""


CATEGORY = f"WITH {SEGMENT_ROWS}, {_category_rows()} SELECT id, \"primary\", confidence FROM cat JOIN src USING (rid)"


def features(extension: str, parts: str, scripts: dict[str, str], more: str = "") -> str:
    """All features of each row; ``extension`` and ``parts`` say file names, ``scripts`` are the counted classes, ``more`` are further columns."""
    n = lambda p: count("body", p)
    total = "(cyrillic + latin + cjk + arabic + digit + other)"
    return rf"""WITH {SEGMENT_ROWS}, {LAYER_A_ROWS}, {_category_rows()},
    said AS (SELECT src.rid, coalesce(b, '') AS body FROM src LEFT JOIN (SELECT rid, string_agg({stripped('body')}, chr(10) ORDER BY seg_no) AS b FROM segs WHERE NOT ({blank('body')}) GROUP BY 1) USING (rid)),
    toks AS (SELECT rid, body, {_tokens('body')} AS w FROM said),
    {language_rows('said', 'rid', 'body')},
    types AS (SELECT rid, x, count(*) AS k FROM (SELECT rid, unnest(w) AS x FROM toks) GROUP BY 1, 2),
    ent AS (SELECT rid, -sum(k / m * log2(k / m)) AS e, count(*) FILTER (k = 1) / any_value(m) AS h FROM (SELECT *, sum(k) OVER (PARTITION BY rid) AS m FROM types) GROUP BY 1),
    cl AS (SELECT rid, {', '.join(f'{n(p)} AS {k}' for k, p in scripts.items())} FROM said), scr AS (SELECT *, letters - latin - cyrillic_letters - cjk_letters - arabic_letters AS other FROM cl),
    runs AS (SELECT rid, sum(n) FILTER (n >= 3) / sum(n) AS r FROM (SELECT rid, run, any_value(x) AS x, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS new
             FROM (SELECT rid, unnest(string_split(body, '')) AS x, generate_subscripts(string_split(body, ''), 1) AS i FROM said WHERE body <> ''))) GROUP BY 1, 2) WHERE regexp_matches(x, '[\p{{L}}\p{{N}}]') GROUP BY 1),
    short AS (SELECT rid, count(*) FILTER (len({_tokens('body')}) <= 2) / count(*) AS s FROM segs WHERE NOT ({blank('body')}) GROUP BY 1)
    SELECT id, file_name, {more} layer_a.* EXCLUDE (rid),
      CAST({n(chr(0xFFFD))} AS BIGINT) AS layer_b_unicode_replacement_count, CAST({n(chr(92) + 'p{C}')} - {n('[' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')} AS BIGINT) AS layer_b_control_char_count, CAST({n('[' + chr(0x200B) + '-' + chr(0x200D) + chr(0xFEFF) + ']')} AS BIGINT) AS layer_b_zero_width_count,
      coalesce(({n(r"[\p{C}\p{Z}]")} - {n(r"[ \t\n\r]")}) / nullif(length(body), 0), 0.0) AS layer_b_nonprintable_ratio, coalesce(runs.r, 0.0) AS layer_b_repeated_char_run_ratio, len(w) AS layer_b_total_tokens, len(list_distinct(w)) AS layer_b_unique_tokens,
      CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END AS layer_b_type_token_ratio, ent.h AS layer_b_hapax_ratio, ent.e AS layer_b_word_entropy_bits, list_avg(list_transform(w, lambda x: length(x))) AS layer_b_mean_word_length, CAST(list_median(list_transform(w, lambda x: length(x))) AS DOUBLE) AS layer_b_median_word_length,
      CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) >= 7)) / len(w) END AS layer_b_long_word_ratio, coalesce(short.s, 0.0) AS layer_b_short_utterance_ratio, CASE WHEN body = '' THEN '' ELSE iso END AS layer_b_primary_language, CASE WHEN body = '' THEN 0.0 ELSE lang.confidence END AS layer_b_primary_language_confidence,
      CAST(CASE WHEN body = '' THEN FALSE ELSE mixed END AS TINYINT) AS layer_b_language_mixed, {', '.join(f'coalesce({k} / nullif({total}, 0), 0.0) AS content_script_{k}_ratio' for k in ('cyrillic', 'latin', 'cjk', 'arabic', 'digit', 'other'))},
      {extension} AS content_file_extension, CAST(len(list_filter(string_split_regex(coalesce(list_extract({parts}, -1), ''), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS BIGINT) AS content_file_basename_token_count, CAST(greatest(len({parts}) - 1, 0) AS BIGINT) AS content_file_path_depth,
      CASE WHEN body = '' THEN 'unknown' ELSE "primary" END AS content_primary_category, CASE WHEN body = '' THEN 0.0 ELSE cat.confidence END AS content_category_confidence
    FROM src JOIN layer_a USING (rid) JOIN toks USING (rid) JOIN scr USING (rid) JOIN lang USING (rid) JOIN cat USING (rid) LEFT JOIN ent USING (rid) LEFT JOIN runs USING (rid) LEFT JOIN short USING (rid)"""


def excerpt(n: int) -> str:
    window = max(500, n // 3)
    t = stripped("coalesce(text, '')")
    middle = f"substr(t, CAST(greatest(0, floor(length(t) / 2) - {window // 2}) AS BIGINT) + 1, {window})"
    parts = f"'[BEGINNING EXCERPT]' || chr(10) || regexp_replace(substr(t, 1, {window}), '[{W}]+$', '') || chr(10) || chr(10) || '[MIDDLE EXCERPT]' || chr(10) || {stripped(middle)} || chr(10) || chr(10) || '[ENDING EXCERPT]' || chr(10) || regexp_replace(substr(t, length(t) - {window - 1}, {window}), '^[{W}]+', '')"
    return f"SELECT doc_id, CASE WHEN length(t) > {n} THEN substr({parts}, 1, {n + 300}) ELSE t END AS excerpt, length(t) > {n} AS limited FROM (SELECT doc_id, {t} AS t FROM documents)"


def _words(*names: str) -> str:
    """A pattern of whole words: RE2 has no Unicode word edges, so what stands around is part of the match."""
    return rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{'|'.join(names)})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])"


_TOKENS = "[A-Za-zА-Яа-яЁёІіЇїЄє'-]{3,}"


def raw(at: str) -> str:
    """CTEs up to ``raw``: a row of flags, counts and labels per row with a readable time."""
    body = stripped("coalesce(transcription_text, '')")
    noise = f"regexp_matches(b, '(?i){_words('ээ+', 'мм+', 'uh+', 'um+', 'aaa+', 'ага+')}') OR regexp_matches(b, '(?i)\\[(?:noise|music|silence|applause)\\]') OR regexp_matches(b, '(?i){_words('неразборчиво', 'inaudible', 'unintelligible')}')"
    timed = rf"\[\d{{2}}:\d{{2}}:\d{{2}}[{W}]*-[{W}]*\d{{2}}:\d{{2}}:\d{{2}}\]|\d{{2}}:\d{{2}}:\d{{2}}[{W}]*-[{W}]*\d{{2}}:\d{{2}}:\d{{2}}[{W}]*:"
    labels = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {_q(w)})' for w in words)} THEN '{c}' END" for c, words in category.RAW_KEYWORDS.items())
    score = lambda c: " + ".join(f"(length(j) - length(replace(j, {_q(w)}, ''))) // {len(w)}" for w in category.RAW_KEYWORDS[c])
    ranked = ", ".join(f"CASE WHEN list_contains(labels, '{c}') THEN struct_pack(n := {score(c)}, o := -{category.RAW_ORDER.index(c)}, c := '{c}') END" for c in category.RAW_KEYWORDS)
    return rf"""
    raw_body AS (SELECT row_number() OVER () AS rid, strftime({at}, '%Y-%m') AS month, coalesce(transcription_text, '') AS t, {body} AS b FROM sample_multiline WHERE {at} IS NOT NULL),
    raw_flags AS (SELECT *, lower(t) AS low, CASE WHEN b = '' THEN 1 ELSE 0 END AS empty, CAST(b <> '' AND regexp_matches(b, '(?i){_words('тест', 'test', 'sample', 'пример', 'пусто', 'без текста')}') AS INT) AS placeholder,
                  CAST(b <> '' AND regexp_matches(b, '\[?SPEAKER_\d{{2}}\]?') AS INT) AS has_speaker, CAST(b <> '' AND regexp_matches(b, {_q(timed)}) AS INT) AS has_timestamp, CAST(b <> '' AND ({noise}) AS INT) AS noise,
                  {count('lower(b)', _TOKENS)} AS word_count, length(b) AS char_count, CASE WHEN b = '' THEN 0 ELSE {count('b', chr(92) + 'n')} + 1 END AS line_count, {count('lower(b)', '[а-яёіїє]')} AS cyr, {count('lower(b)', '[a-z]')} AS lat FROM raw_body),
    raw_own AS (SELECT *, CAST(b = '' OR (has_speaker = 1 AND has_timestamp = 0) OR (contains(b, repeat('-', 80)) AND has_speaker = 0) AS INT) AS malformed, CASE WHEN cyr > 1.3 * lat THEN 'cyr' WHEN lat > 1.3 * cyr THEN 'lat' ELSE 'mixed' END AS dominance,
                regexp_extract_all(low, {_q(_TOKENS)}) AS toks, list_filter([{labels}], lambda x: x IS NOT NULL) AS own FROM raw_flags),
    raw_labels AS (SELECT *, array_to_string(toks, ' ') AS j, CASE WHEN len(own) > 0 THEN own ELSE [CASE WHEN len(toks) < 8 THEN '{category.RAW_FALLBACKS[0]}' WHEN len(toks) < 40 THEN '{category.RAW_FALLBACKS[1]}' ELSE '{category.RAW_FALLBACKS[2]}' END] END AS labels FROM raw_own),
    raw AS (SELECT *, CASE WHEN len(labels) = 1 THEN labels[1] ELSE list_reverse_sort(list_filter([{ranked}], lambda r: r IS NOT NULL))[1].c END AS primary_label FROM raw_labels)"""


_RAW_MEANS = ", ".join(
    ["count(*) AS n", *(f"round_even(avg({c}), 2) AS avg_{c}" for c in ("word_count", "char_count", "line_count")), *(f"round_even(avg({c}), 4) AS {c}_share" for c in raw_summary.FLAGS), *(f"round_even(avg(CASE WHEN dominance = '{d}' THEN 1 ELSE 0 END), 4) AS {d}_dominant_share" for d in ("cyr", "lat", "mixed"))]
)


def raw_monthly(at: str) -> str:
    return f"WITH {raw(at)} SELECT month, {_RAW_MEANS} FROM raw GROUP BY 1"


def raw_overall(at: str) -> str:
    return f"WITH {raw(at)} SELECT {_RAW_MEANS} FROM raw"


def raw_trend(at: str) -> str:
    delta = lambda c, f: f"round_even((arg_max({c}, month) - arg_min({c}, month)) * {f}, 2)"
    shares = ", ".join(f"{delta(c, 100)} AS {c}_pp" for c in ("has_speaker_share", "has_timestamp_share", "malformed_share", "noise_share", "empty_share"))
    return f"SELECT min(month) AS first_month, max(month) AS last_month, {delta('avg_word_count', 1)} AS words_delta, {shares} FROM ({raw_monthly(at)})"


def raw_primary_labels(at: str) -> str:
    return f"WITH {raw(at)} SELECT month, primary_label, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY month), 4) AS share FROM raw GROUP BY 1, 2"


def month_quantiles(features_sql: str, at: str, metrics: list[str]) -> str:
    each = ", ".join(f"round(median({m}), 6) AS {m}_median, round(quantile_cont({m}, 0.25), 6) AS {m}_q1, round(quantile_cont({m}, 0.75), 6) AS {m}_q3" for m in metrics)
    return f"SELECT date_trunc('month', {at})::TIMESTAMP AS bucket_month, count(*) AS n_rows, {each} FROM ({features_sql}) WHERE {at} IS NOT NULL GROUP BY 1"


def month_share(features_sql: str, at: str, column: str) -> str:
    return f"""SELECT b AS bucket_month, c AS _category, count(*) AS n_in_category, CAST(sum(count(*)) OVER (PARTITION BY b) AS BIGINT) AS n_in_bucket, round(count(*) / sum(count(*)) OVER (PARTITION BY b), 6) AS share
               FROM (SELECT date_trunc('month', {at})::TIMESTAMP AS b, coalesce(nullif({column}, ''), '(null)') AS c FROM ({features_sql}) WHERE {at} IS NOT NULL) GROUP BY b, c"""


def candidates(at: str, latin: str, chars: int = 0) -> str:
    """CTEs up to ``cand``: the cheap features of each transcript with a readable time."""
    wing = chars // 3
    windows = "t" if chars <= 0 else f"CASE WHEN length(t) <= {chars} THEN t ELSE substr(t, 1, {wing}) || substr(t, CAST(greatest(0, floor(length(t) / 2) - {wing // 2}) AS BIGINT) + 1, {wing}) || substr(t, length(t) - {wing - 1}, {wing}) END"
    classes = {
        "cyrillic": r"[\x{0400}-\x{052F}]", "latin": latin, "cjk": r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]", "arabic": r"[\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{07BF}\x{07CA}-\x{08FF}]",
        "nd": r"\p{Nd}", "letters": r"\p{L}", "in_cyrillic": r"[\x{0400}-\x{0481}\x{048A}-\x{052F}]",
    }
    hits = ", ".join(f"struct_pack(n := {' + '.join(f'CAST(contains(low, {_q(w)}) AS INT)' for w in words)}, c := '{c}')" for c, words in category.KEYWORDS.items())
    words = r"\p{L}{2,}(?:['-]\p{L}+)?"
    share = {k: f"{k} / total" for k in ("cyrillic", "latin", "cjk", "arabic")}
    best = f"greatest({', '.join(share.values())})"
    named = " ".join(f"WHEN {v} = {best} AND {best} > 0 THEN '{k}_dominant'" for k, v in share.items())
    return rf"""
    cand_base AS (SELECT DISTINCT ON (trim(id)) trim(id) AS transcript_id, strftime({at}, '%Y-%m') AS month, trim(created_at) AS created_at, coalesce(transcription_text, '') AS t FROM sample_multiline WHERE {at} IS NOT NULL),
    cand_text AS (SELECT *, {windows} AS s, lower({windows}) AS low, regexp_replace(t, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS l FROM cand_base),
    cand_counts AS (SELECT *, list_transform(regexp_extract_all(l, '(?im)^\s*\[?\s*(SPEAKER_\d+|SPEAKER_[A-Z]{{1,3}})\s*\]?\s*$', 1), lambda x: upper(x)) AS heads, {count('l', r"\[\s*" + CLOCK + r"\s*[-–—]\s*" + CLOCK + r"\s*\]|(?m:^)\s*" + CLOCK + r"\s*[-–—]\s*" + CLOCK + ":")} AS n_times,
      {count('l', r"(?m)^-{20,}\s*$")} AS n_separators, {count('t', words)} AS total_tokens, {', '.join(f'{count("s", p)} AS {k}' for k, p in classes.items())},
      coalesce(({count('s', '[' + chr(92) + 'p{C}' + chr(92) + 'p{Z}]')} - {count('s', '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')}) / nullif(length(s), 0), 0.0) AS nonprintable_ratio, {count('s', chr(0xFFFD))} AS unicode_replacement_count FROM cand_text),
    cand_runs AS (SELECT transcript_id, sum(n) FILTER (n >= 3) / sum(n) AS r FROM (SELECT transcript_id, run, any_value(x) AS x, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY transcript_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY transcript_id ORDER BY i) THEN 0 ELSE 1 END AS new
      FROM (SELECT transcript_id, unnest(string_split(s, '')) AS x, generate_subscripts(string_split(s, ''), 1) AS i FROM cand_text WHERE s <> ''))) GROUP BY 1, 2) WHERE regexp_matches(x, '[\p{{L}}\p{{N}}]') GROUP BY 1),
    cand_more AS (SELECT c.*, coalesce(r, 0.0) AS repeated_char_run_ratio, len(heads) AS n_heads, len(list_distinct(heads)) AS distinct_speakers, len(list_filter(list_zip(heads[1:len(heads) - 1], heads[2:]), lambda p: p[1] <> p[2])) AS speaker_switch_count,
      greatest(n_times, len(heads), n_separators) AS segment_count, greatest(1, cyrillic + latin + cjk + arabic + (letters - in_cyrillic - latin - cjk - arabic) + nd) AS total, list_reverse_sort([{hits}])[1] AS hit FROM cand_counts c LEFT JOIN cand_runs USING (transcript_id)),
    cand_rates AS (SELECT *, CASE WHEN n_heads = 0 THEN 0.0 WHEN n_times = 0 THEN 1.0 ELSE greatest(0.0, (n_heads - n_times) / n_heads) END AS malformed_timestamp_ratio, speaker_switch_count / greatest(1, segment_count) AS speaker_switch_rate, speaker_switch_count > greatest(5, segment_count) AS unreasonable_speaker_churn,
      distinct_speakers >= 2 AND speaker_switch_count >= 3 AS talk, {share['cyrillic']} >= 0.2 AND {share['latin']} >= 0.2 AS two FROM cand_more),
    cand AS (SELECT transcript_id, month, created_at, total_tokens, distinct_speakers, speaker_switch_count, nonprintable_ratio, repeated_char_run_ratio, unicode_replacement_count, segment_count, malformed_timestamp_ratio, speaker_switch_rate, unreasonable_speaker_churn,
      CASE WHEN two THEN 'mixed_cyrillic_latin' {named} ELSE 'unknown' END AS language, CASE WHEN two THEN least(1.0, {share['cyrillic']} + {share['latin']}) ELSE {best} END AS language_confidence,
      CASE WHEN hit.n > 0 THEN hit.c WHEN talk THEN 'dialogue_meeting' WHEN total_tokens < 15 THEN 'short_note' WHEN total_tokens < 60 THEN 'quick_message' ELSE 'general_monologue' END AS content_category,
      CASE WHEN hit.n > 0 THEN least(1.0, hit.n / 4) WHEN talk THEN least(1.0, ln(1 + speaker_switch_count) / ln(21)) WHEN total_tokens < 15 THEN 0.6 WHEN total_tokens < 60 THEN 0.5 ELSE 0.4 END AS category_confidence,
      CASE WHEN total_tokens < 20 THEN 'very_short' WHEN total_tokens < 120 THEN 'short' WHEN total_tokens < 500 THEN 'medium' WHEN total_tokens < 1200 THEN 'long' ELSE 'very_long' END AS length_bin,
      CASE WHEN distinct_speakers <= 1 THEN 'monologue_or_single_speaker' WHEN distinct_speakers > 2 THEN 'multi_speaker' WHEN segment_count < 20 THEN 'two_speaker_light' ELSE 'two_speaker_dense' END AS dialogue_bin,
      CASE WHEN malformed_timestamp_ratio > 0.2 OR unicode_replacement_count > 0 OR nonprintable_ratio > 0.01 OR unreasonable_speaker_churn THEN 'structural_or_text_anomaly' WHEN malformed_timestamp_ratio > 0 OR repeated_char_run_ratio > 0.05 THEN 'minor_artifact_signal' ELSE 'typical' END AS quality_bin FROM cand_rates),
    centers AS (SELECT month, coalesce(median(total_tokens), 0.0) AS center_tokens, coalesce(median(segment_count), 0.0) AS center_segments, coalesce(median(distinct_speakers), 0.0) AS center_speakers, coalesce(median(malformed_timestamp_ratio), 0.0) AS center_malformed FROM cand GROUP BY 1)"""


def month_center(at: str, latin: str) -> str:
    return f"WITH {candidates(at, latin)} SELECT month, center_tokens, center_segments, center_speakers, round(center_malformed, 6) AS center_malformed FROM centers"


_LOGS = lambda a, b: f"abs(ln(1 + {a}) - ln(1 + {b}))"
_DISTANCE = f"{_LOGS('total_tokens', 'center_tokens')} + {_LOGS('segment_count', 'center_segments')} + 0.4 * abs(distinct_speakers - center_speakers) + 2.0 * abs(malformed_timestamp_ratio - center_malformed)"
_ANOMALY = f"5.0 * malformed_timestamp_ratio + 0.5 * speaker_switch_rate + 3.0 * repeated_char_run_ratio + 10.0 * nonprintable_ratio + 0.5 * unicode_replacement_count + CASE WHEN unreasonable_speaker_churn THEN 2.0 ELSE 0.0 END + 0.2 * {_LOGS('total_tokens', 'greatest(center_tokens, 1.0)')}"
_RATES = ("nonprintable_ratio", "repeated_char_run_ratio", "malformed_timestamp_ratio", "speaker_switch_rate", "language_confidence", "category_confidence")


def sample_candidates(at: str, latin: str) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in (*_RATES, "center_malformed"))
    return f"WITH {candidates(at, latin)} SELECT * REPLACE ({rounded}), round({_DISTANCE}, 6) AS distance, round({_ANOMALY}, 6) AS anomaly FROM cand JOIN centers USING (month)"


def _chosen(at: str, latin: str, k: int, seed: int) -> str:
    """CTEs up to ``chosen``: the stratified sample without the excluded ids, step after step over all candidates."""
    stratum = "month, content_category, language, length_bin, dialogue_bin"
    near = "round(distance, 9), tie, transcript_id"
    sentinel, representative = int(k >= 4), max(1, round(k * 0.65))
    steps = (
        ("representative_dominant_stratum", "place = 1", "size DESC, tie, transcript_id", f"{representative}"),
        ("representative_month_center", "TRUE", near, f"{representative} - taken"),
        ("contrastive_rare_stratum", "first_open", "size, tie, transcript_id", f"{max(0, k - representative - sentinel)}"),
        ("quality_sentinel", "TRUE", "round(anomaly, 9) DESC, tie, transcript_id", f"{sentinel}"),
        ("balanced_fill", "TRUE", near, f"{k} - taken"),
    )
    base = candidates(at, latin).replace("    cand AS (", "    cand_all AS (").replace("    centers AS (", "    cand AS (SELECT * FROM cand_all WHERE transcript_id NOT IN (SELECT trim(transcript_id) FROM excluded_ids WHERE trim(transcript_id) <> '')),\n    centers AS (")
    ctes = [
        base,
        f"scored AS (SELECT cand.*, {_DISTANCE} AS distance, {_ANOMALY} AS anomaly, md5('{seed}:' || transcript_id) AS tie FROM cand JOIN centers USING (month))",
        f"step0 AS (SELECT *, count(*) OVER (PARTITION BY {stratum}) AS size, row_number() OVER (PARTITION BY {stratum} ORDER BY {near}) AS place, count(*) OVER (PARTITION BY month) AS month_n, CASE WHEN count(*) OVER (PARTITION BY month) <= {k} THEN 'all_available_for_sparse_month' END AS reason FROM scored)",
    ]
    for i, (reason, eligible, order, upto) in enumerate(steps):
        ctes.append(f"open{i} AS (SELECT *, count(reason) OVER (PARTITION BY month) AS taken, reason IS NULL AND row_number() OVER (PARTITION BY {stratum} ORDER BY reason IS NOT NULL, {near}) = 1 AS first_open FROM step{i})")
        ctes.append(
            f"step{i + 1} AS (SELECT * EXCLUDE (taken, first_open, e, r) REPLACE (CASE WHEN e AND r <= {upto} THEN '{reason}' ELSE reason END AS reason) FROM (SELECT *, row_number() OVER (PARTITION BY month, e ORDER BY {order}) AS r FROM (SELECT *, reason IS NULL AND month_n > {k} AND ({eligible}) AS e FROM open{i})))"
        )
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in (*_RATES, "distance", "anomaly"))
    ctes.append(f"chosen AS (SELECT * EXCLUDE (tie, size, place, month_n, reason) REPLACE ({rounded}), reason AS selection_reason FROM step{len(steps)} WHERE reason IS NOT NULL)")
    return ",\n    ".join(ctes)


def stratified_sample(at: str, latin: str, k: int = 8, seed: int = 42) -> str:
    return f"WITH {_chosen(at, latin, k, seed)} SELECT * FROM chosen"


def sample_excerpts(at: str, latin: str, n: int = 4500, k: int = 8, seed: int = 42) -> str:
    cut = excerpt(n).replace("doc_id", "transcript_id").replace("coalesce(text, '')", "t").replace("FROM documents", "FROM cand_base").replace("AS limited", "AS excerpt_limited")
    return f"WITH {_chosen(at, latin, k, seed)}, cut AS ({cut}) SELECT * FROM chosen JOIN cut USING (transcript_id)"
