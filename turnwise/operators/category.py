"""Content categories: by whole keywords and dialogue structure, and the looser substring labels of the raw summary."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import bind, strip

RULES_VERSION = "v2_strength_primary"

# fixed values: keywords of each category
KEYWORDS = {
    "business_work": ["клиент", "проект", "задач", "встреч", "совещан", "созвон", "договор", "сделк", "бизнес", "команд", "маркет", "продаж", "офис", "meeting", "project", "client", "task", "deal", "contract"],
    "tech_it": ["код", "программ", "сервер", "баг", "ошибк", "api", "python", "javascript", "sql", "docker", "алгоритм", "данн", "deploy", "backend", "frontend", "debug", "github", "prompt", "llm", "model"],
    "education": ["урок", "курс", "обуч", "школ", "универ", "экзам", "лекц", "lesson", "course", "learn", "study"],
    "personal": ["семь", "мам", "пап", "друз", "отношен", "дом", "поездк", "покупк", "здоров", "жизн", "семья", "family", "friend", "home", "life"],
    "media_creative": ["музык", "песн", "фильм", "видео", "подкаст", "youtube", "тикток", "story", "script", "music", "video"],
    "finance_legal": ["деньг", "оплат", "счет", "налог", "кредит", "банк", "юрист", "суд", "долг", "budget", "payment", "tax"],
    "support": ["инструкц", "настрой", "помог", "поддерж", "проблем", "решен", "issue", "support", "fix", "setup"],
}
# fixed values: equal strengths are settled in this order
ORDER = ["tech_it", "business_work", "finance_legal", "education", "support", "media_creative", "personal", "dialogue_meeting"]
# fixed values: where a dialogue may win, its scale, and the strength that counts as full without a rival
DIALOGUE_MAX_COVERAGE, DIALOGUE_MAX_HITS, DIALOGUE_FULL, LONE_STRENGTH = 0.12, 2, 28.0, 0.18

# fixed values: stems of the raw summary's labels, and its own order
RAW_KEYWORDS = {
    "work_business": ["клиент", "проект", "задач", "встреч", "созвон", "договор", "сделк", "бизнес", "команд", "маркет", "продаж", "office", "meeting", "project", "client", "task", "deal", "contract", "work", "team"],
    "tech_it": ["код", "программ", "сервер", "баг", "ошибк", "api", "python", "javascript", "sql", "docker", "алгоритм", "данн", "deploy", "backend", "frontend", "debug", "github", "prompt", "llm", "model", "dataset"],
    "education_learning": ["урок", "курс", "обуч", "школ", "универс", "экзам", "лекц", "lesson", "study", "course", "learn", "exam", "class", "homework"],
    "personal_life": ["семь", "мам", "пап", "друз", "отношен", "дом", "поезд", "покуп", "здоров", "жизн", "wife", "husband", "family", "friend", "home", "trip", "health", "life"],
    "media_creative": ["музык", "песн", "фильм", "видео", "сценар", "подкаст", "youtube", "тикток", "song", "music", "movie", "video", "podcast", "story", "script"],
    "finance_legal": ["деньг", "оплат", "счет", "налог", "кредит", "банк", "юрист", "суд", "долг", "budget", "payment", "invoice", "tax", "bank", "loan", "legal"],
    "support_ops": ["инструкц", "настрой", "помог", "поддерж", "проблем", "решен", "issue", "support", "setup", "fix", "configure", "install"],
}
RAW_ORDER = ["tech_it", "finance_legal", "work_business", "education_learning", "support_ops", "media_creative", "personal_life"]
# fixed values: labels by number of words
RAW_FALLBACKS = ("very_short_notes", "quick_messages", "general_speech")

# fixed values: fillers and sound marks that are no words
FILLERS = r"(?iU)\b(?:ээ+|мм+|ух|ага|ммм)\b|\[(?:noise|music|silence|applause|неразборчиво)\]"


def clean_text(segments: Column) -> Column:
    """The body lines without leftover labels and times, those longer than two characters, joined by blanks."""
    lines = F.flatten(F.transform(segments, lambda s: F.split(s["body"], "\n")))
    # fixed values: the patterns of left-over labels and times
    bare = F.transform(
        lines,
        lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)\[?SPEAKER_\d+\]?", ""), r"\[\d{2}:\d{2}:\d{2}.*?\]", ""), r"(?U)\d{2}:\d{2}:\d{2}\s*-\s*\d{2}:\d{2}:\d{2}:?", "")),
    )
    return F.array_join(F.filter(bare, lambda x: F.length(x) > 2), " ")


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many different keywords stand in the text as whole words. ``text`` is lower case, its words are found once each."""
    return F.size(F.array_intersect(text, F.array(*[F.lit(w) for w in words])))


def dialogue_strength(speakers: Column, switches: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(speakers + 2 * switches) / math.log1p(DIALOGUE_FULL))


def classify(segments: Column) -> Column:
    """(primary, confidence) of a transcript's segments.

    Each category's strength is the share of its keywords that occur; a dialogue may win only where keywords are thin. Text
    without any signal falls back to its length. No segments or no text: ("empty", 0.0).
    """
    text = clean_text(segments)
    named = F.transform(segments, lambda s: s["speaker"])
    before, after = F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))), F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0)))
    switches = F.size(F.filter(F.zip_with(before, after, lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)), lambda x: x))
    speakers = F.size(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    bound = F.struct(text.alias("text"), speakers.alias("speakers"), switches.alias("switches"))

    def hits(x: Column) -> Column:
        low = F.regexp_replace(F.lower(x["text"]), FILLERS, " ")
        n = F.regexp_count(F.lower(x["text"]), F.lit(r"[A-Za-zА-Яа-яЁё0-9'-]{3,}"))
        found = bind(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), 0)), lambda words: F.struct(*[keyword_hits(words, k).alias(c) for c, k in KEYWORDS.items()]))
        return F.struct(x["text"].rlike(r"(?U)\S").alias("said"), x["speakers"].alias("speakers"), x["switches"].alias("switches"), n.alias("n"), found.alias("hits"))

    def decide(x: Column) -> Column:
        counts = {c: x["hits"][c] for c in KEYWORDS}
        cover = {c: F.least(F.lit(1.0), h / len(KEYWORDS[c])) for c, h in counts.items()}
        flag = (x["speakers"] >= 2) | (x["switches"] > 3)
        listed = flag & (counts["business_work"] == 0) & (counts["support"] == 0)
        thin = (F.greatest(*cover.values()) < DIALOGUE_MAX_COVERAGE) & (F.greatest(*counts.values()) <= DIALOGUE_MAX_HITS)
        entry = lambda c, s: F.struct(s.alias("s"), F.lit(-ORDER.index(c)).alias("o"), F.lit(c).alias("c"))
        rows = [F.when(counts[c] > 0, entry(c, cover[c])) for c in KEYWORDS]
        rows.append(F.when(listed & thin, entry("dialogue_meeting", dialogue_strength(x["speakers"], x["switches"]))))
        length = F.when(x["n"] < 15, "short_note").when(x["n"] < 60, "quick_message").otherwise("general_monologue")
        fallback = F.bround(F.least(F.lit(1.0), F.lit(10.0) / F.greatest(F.lit(5), x["n"]) * 0.8), 3)

        def name(ranked: Column) -> Column:
            best, runner = ranked[0]["s"], F.try_element_at(ranked, F.lit(2))["s"]
            sure = F.bround(F.when(runner > 1e-12, F.least(F.lit(1.0), best / runner)).otherwise(F.least(F.lit(1.0), best / LONE_STRENGTH)), 3)
            found = F.size(ranked) > 0
            return F.struct(
                F.when(~x["said"], "empty").when(found, ranked[0]["c"]).otherwise(length).alias("primary"),
                F.when(~x["said"], 0.0).when(found, sure).otherwise(fallback).alias("confidence"),
            )

        return bind(F.reverse(F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull()))), name)

    return F.transform(F.transform(F.array(bound), hits), decide)[0]


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-zА-Яа-яЁёІіЇїЄє'-]{3,}"), 0)


def raw_labels(text: Column) -> Column:
    """All labels a stem of which occurs anywhere in the text; without any, one label by the number of words."""
    def own(low: Column) -> Column:
        return F.filter(F.array(*[F.when(_any(low, words), F.lit(c)) for c, words in RAW_KEYWORDS.items()]), lambda x: x.isNotNull())

    n = F.size(raw_tokens(text))
    fallback = F.array(F.when(n < 8, RAW_FALLBACKS[0]).when(n < 40, RAW_FALLBACKS[1]).otherwise(RAW_FALLBACKS[2]))
    return bind(bind(F.lower(F.coalesce(text, F.lit(""))), own), lambda labels: F.when(F.size(labels) > 0, labels).otherwise(fallback))


def _any(low: Column, words: list[str]) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def raw_primary(text: Column, labels: Column) -> Column:
    """The label with most stem occurrences in the joined words; ties by the fixed order; a single label stands."""
    def score(joined: Column, c: str) -> Column:
        total = F.lit(0)
        for w in RAW_KEYWORDS[c]:
            total = total + (F.length(joined) - F.length(F.replace(joined, F.lit(w), F.lit("")))) / len(w)
        return total.cast("int")

    def best(joined: Column) -> Column:
        ranked = F.array(*[F.when(F.array_contains(labels, c), F.struct(score(joined, c).alias("n"), F.lit(-RAW_ORDER.index(c)).alias("o"), F.lit(c).alias("c"))) for c in RAW_KEYWORDS])
        return F.array_max(F.filter(ranked, lambda r: r.isNotNull()))["c"]

    return F.when(F.size(labels) == 1, labels[0]).otherwise(bind(F.array_join(raw_tokens(text), " "), best))
