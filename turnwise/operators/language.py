"""A light language detector for the feature pass: letters only some languages use, and their frequent small words.

One expression a language, no model and no Python. The result is a struct (iso, confidence, mixed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import bind, count_chars

# fixed values: frequent small words of each language
SMALL_WORDS = {
    "en": "the and to of in is that it for on with was be you but not this have are at by so just from we",
    "ru": "и в не на я мы что это с но как за к для так из же всё если то от бы уже ещё потом только когда",
    "uk": "і в не на я ми що це з але як за до для так із усе якщо то від би вже ще потім тільки коли",
    "be": "і у не на я мы што гэта з але як за да для так бо яшчэ усё калі ад бы ўжо потым толькі пра каб",
    "de": "der die das und zu in wir ist es für auf mit war ich aber nicht den ein eine von so auch noch wenn",
    "pl": "i w nie na że się z do po ale jak za o dla tak od co ja my już jeszcze bo czy jest tylko kiedy",
}
# fixed values: letters that set a language apart from its neighbours
LETTERS = {"en": r"[qwx]|th", "ru": "[ыэъё]", "uk": "[їєґ]", "be": "[ўэы]|дз", "de": "[äöüß]|sch|ch", "pl": "[ąęłńśźż]|cz|sz|rz"}
CYRILLIC = ("ru", "uk", "be")
AGAINST = {"ru": "[іїєґў]", "uk": "[ыэъёў]", "be": "[иїєґщъ]", "en": "[äöüßąęłńśźż]", "de": "[ąęłńśźż]", "pl": "[äöüß]"}
MIXED_GAP = 0.08
SECOND_SHARE = 0.3


def language_codes(text: str | None) -> list[str]:
    """Codes of a comma-separated list, lower case, sorted, each once; the default languages for an empty one."""
    codes = sorted({c.strip().lower() for c in (text or "").split(",") if c.strip()})
    return [c for c in codes if c in SMALL_WORDS] or sorted(SMALL_WORDS)


def _one_of(words: list[str]):
    return lambda w: w.isin(words)


def detect(sample: Column, languages: dict[str, list[str]] | None = None) -> Column:
    """(iso, confidence, mixed) of a text. Blank text and text in neither script: ("", 0.0, false).

    A language scores its small words twice, its own letters, and loses letters it never uses; confidence is the best
    score's share of all; mixed if the two best are close or a second script holds a third of the letters.
    """
    table = languages or {k: v.split() for k, v in SMALL_WORDS.items()}
    every = sorted({w for own in table.values() for w in own})

    def counted(low: Column) -> Column:
        """Counts of one text; a script's own letters are only looked for where the script occurs."""
        return bind(F.struct(count_chars(low, r"\p{IsCyrillic}").alias("cyrillic"), count_chars(low, r"\p{IsLatin}").alias("latin")), lambda x: letters(low, x))

    def letters(low: Column, x: Column) -> Column:
        own = []
        for iso in table:
            there = x["cyrillic"] if iso in CYRILLIC else x["latin"]
            size = count_chars(low, LETTERS[iso]) - count_chars(low, AGAINST[iso]) if iso in LETTERS else F.lit(0).cast("bigint")
            own.append(F.when(there > 0, size).otherwise(0).alias(f"own_{iso}"))
        rest = [(x["cyrillic"] + x["latin"]).alias("n"), x["cyrillic"].alias("cyrillic"), x["latin"].alias("latin"), *own]
        # all small words are picked out once; each language then looks among these only
        return bind(F.regexp_extract_all(low, F.lit(r"\p{L}+"), 0), lambda w: F.struct(F.filter(w, _one_of(every)).alias("small"), F.size(w).alias("m"), *rest))

    def scores(x: Column) -> Column:
        n, m = F.greatest(x["n"], F.lit(1)), F.greatest(x["m"], F.lit(1))
        each = []
        for iso, own in table.items():
            script = (x["cyrillic"] if iso in CYRILLIC else x["latin"] if iso in SMALL_WORDS else x["n"]) / n
            small = F.size(F.filter(x["small"], _one_of(own))) / m
            each.append(F.struct(F.greatest(script * (0.05 + 2 * small + 2 * x[f"own_{iso}"] / n), F.lit(0.0)).alias("score"), F.lit(iso).alias("iso")))
        return F.struct(x["n"].alias("n"), F.sort_array(F.array(*each), asc=False).alias("by"), (F.least(x["cyrillic"], x["latin"]) > SECOND_SHARE * x["n"]).alias("scripts"))

    def pick(x: Column) -> Column:
        total = F.aggregate(x["by"], F.lit(0.0), lambda a, s: a + s["score"])
        return bind(F.struct(x["n"].alias("n"), x["scripts"].alias("scripts"), x["by"].alias("by"), total.alias("total")), name)

    def name(x: Column) -> Column:
        first, second = x["by"][0]["score"] / x["total"], (x["by"][1]["score"] / x["total"] if len(table) > 1 else F.lit(0.0))
        known = (x["n"] > 0) & (x["total"] > 0)
        return F.struct(
            F.when(known, x["by"][0]["iso"]).otherwise("").alias("iso"),
            F.when(known, first).otherwise(0.0).alias("confidence"),
            F.when(known, x["scripts"] | (first - second < MIXED_GAP)).otherwise(False).alias("mixed"),
        )

    return bind(bind(bind(F.lower(F.coalesce(sample, F.lit(""))), counted), scores), pick)
