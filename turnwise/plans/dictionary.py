"""What each metric is: layer, unit and a description in English and in Russian."""

from __future__ import annotations

from turnwise.operators.layers import LAYER_A_VERSION, LAYER_B_VERSION

A, B, C = "layer_a_", "layer_b_", "content_"
# name, unit, English, Russian
ENTRIES = (
    (A + "segment_count", "count", "Speaker segments found in the transcript", "Число сегментов диаризации в транскрипте"),
    (A + "separator_count", "count", "Lines that are long dashed separators", "Число строк-разделителей из дефисов"),
    (A + "distinct_speakers", "count", "Different speaker labels", "Число разных меток спикеров"),
    (A + "median_words_per_segment", "words", "Median number of words of a segment", "Медиана числа слов в сегменте"),
    (A + "median_chars_per_segment", "characters", "Median number of characters of a segment", "Медиана числа знаков в сегменте"),
    (A + "max_words_per_segment", "words", "Words of the longest segment", "Число слов в самом длинном сегменте"),
    (A + "malformed_timestamp_ratio", "ratio", "Share of labelled segments without a readable time", "Доля сегментов с меткой, но без читаемого времени"),
    (A + "duplicate_adjacent_segment_ratio", "ratio", "Share of neighbouring segments with the same text", "Доля соседних сегментов с одинаковым текстом"),
    (A + "speaker_switch_count", "count", "How often the speaker changes from one labelled segment to the next", "Сколько раз меняется спикер между соседними сегментами"),
    (A + "speaker_switch_rate", "ratio", "Speaker changes per segment", "Смены спикера в расчёте на сегмент"),
    (A + "unreasonable_speaker_churn", "flag", "More speaker changes than segments allow", "Признак неправдоподобно частой смены спикеров"),
    (A + "duration_covered_seconds", "seconds", "Sum of the durations of timed segments", "Суммарная длительность сегментов с временем"),
    (A + "duration_span_seconds", "seconds", "From the first start to the last end", "Промежуток от первого начала до последнего конца"),
    (A + "duration_coverage_ratio", "ratio", "Covered seconds per second of the span", "Отношение покрытого времени к промежутку"),
    (A + "segments_with_duration_ratio", "ratio", "Share of segments with a start before their end", "Доля сегментов с началом раньше конца"),
    (B + "unicode_replacement_count", "count", "Replacement characters", "Число знаков замены Юникода"),
    (B + "control_char_count", "count", "Control and format characters, line ends and tabs aside", "Число управляющих знаков без переводов строк и табуляций"),
    (B + "zero_width_count", "count", "Characters of no width", "Число знаков нулевой ширины"),
    (B + "nonprintable_ratio", "ratio", "Share of characters that do not print", "Доля непечатаемых знаков"),
    (B + "repeated_char_run_ratio", "ratio", "Share of letters and digits in runs of three and more of one character", "Доля букв и цифр в повторах одного знака от трёх подряд"),
    (B + "total_tokens", "count", "Words between white space", "Число слов, разделённых пробелами"),
    (B + "unique_tokens", "count", "Different words", "Число разных слов"),
    (B + "type_token_ratio", "ratio", "Different words per word", "Отношение числа разных слов к числу слов"),
    (B + "hapax_ratio", "ratio", "Share of words that occur once", "Доля слов, встретившихся один раз"),
    (B + "word_entropy_bits", "bits", "Shannon entropy of the words", "Энтропия Шеннона по словам"),
    (B + "mean_word_length", "characters", "Mean length of a word", "Средняя длина слова"),
    (B + "median_word_length", "characters", "Median length of a word", "Медиана длины слова"),
    (B + "long_word_ratio", "ratio", "Share of words of seven characters and more", "Доля слов от семи знаков"),
    (B + "short_utterance_ratio", "ratio", "Share of segments of at most two words", "Доля сегментов не длиннее двух слов"),
    (B + "primary_language", "label", "Code of the language the text is most likely in", "Код наиболее вероятного языка текста"),
    (B + "primary_language_confidence", "ratio", "Share of the best language's score in all scores", "Доля оценки лучшего языка в сумме оценок"),
    (B + "language_mixed", "flag", "Two languages score alike or two scripts are used", "Признак смешения языков или письменностей"),
    *((C + f"script_{s}_ratio", "ratio", f"Share of counted characters in {en}", f"Доля знаков: {ru}") for s, en, ru in (
        ("cyrillic", "Cyrillic", "кириллица"), ("latin", "Latin", "латиница"), ("cjk", "Chinese, Japanese and Korean scripts", "письменности Восточной Азии"), ("arabic", "Arabic", "арабское письмо"), ("digit", "digits", "цифры"), ("other", "other scripts", "прочие письменности"))),
    (C + "file_extension", "label", "Extension of the file name, lower case", "Расширение имени файла строчными буквами"),
    (C + "file_basename_token_count", "count", "Words in the last part of the file name", "Число слов в последней части имени файла"),
    (C + "primary_category", "label", "Category with the strongest signal", "Категория с самым сильным сигналом"),
    (C + "category_confidence", "ratio", "Best signal against the second best; no probability", "Отношение лучшего сигнала ко второму; не вероятность"),
)


def dictionary(with_b: bool = True) -> dict:
    """The metrics of a run with their descriptions and the versions they are defined by."""
    from turnwise import __version__

    metrics = [{"name": n, "layer": "A" if n.startswith(A) else "B", "unit": unit, "description": en + ".", "description_ru": ru + "."} for n, unit, en, ru in ENTRIES if with_b or n.startswith(A)]
    versions = {"layer_a_code_version": LAYER_A_VERSION} | ({"layer_b_code_version": LAYER_B_VERSION} if with_b else {})
    return {"schema_version": "1", "metrics": metrics, **versions, "package_version": __version__}


def descriptions(value: dict, key: str = "description_ru") -> dict[str, str]:
    """Metric to text of a loaded dictionary; entries without one are left out."""
    return {m["name"]: m[key] for m in value.get("metrics", []) if isinstance(m, dict) and m.get("name") and m.get(key)}
