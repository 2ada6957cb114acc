"""String, Unicode and lexical expressions over text columns. All are JVM expressions; null text counts as empty.

White space and word classes are Unicode ones, hence ``(?U)`` in the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LONG_WORD = 7


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda every mention of an expression would compute it again."""
    return F.transform(F.array(value), use)[0]


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(_text(c), F.lit(pattern)).cast("bigint")


def count_chars(c: Column, chars: str) -> Column:
    """How many characters are of a class such as ``[a-z]``: what is gone once runs of them are cut out. Cheaper than listing matches."""
    t = _text(c)
    runs = f"(?:{chars})++" if "|" in chars else f"{chars}++"
    return (F.length(t) - F.length(F.regexp_replace(t, runs, ""))).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


# fixed values: the characters with the Unicode property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(_text(c), F.lit(WHITE))


def line_feeds(c: Column) -> Column:
    """Every kind of line end as ``\\n``."""
    return F.regexp_replace(_text(c), LINE_ENDS, "\n")


def replacement_count(c: Column) -> Column:
    return count_chars(c, r"\x{FFFD}")


def zero_width_count(c: Column) -> Column:
    return count_chars(c, r"[\x{200B}-\x{200D}\x{FEFF}]")


def control_count(c: Column) -> Column:
    return count_chars(c, r"[\p{C}&&[^\t\n\r]]")


def nonprintable_ratio(c: Column) -> Column:
    """Characters that do not print, blanks other than U+0020 included, per character; 0 for empty text."""
    return F.coalesce(ratio(count_chars(c, r"[[\p{C}\p{Z}]&&[^ \t\n\r]]"), F.length(_text(c))), F.lit(0.0))


LATIN = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}]"
SCRIPTS = {
    "cyrillic": r"[\x{0400}-\x{052F}]",
    "latin": LATIN,
    "digit": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]",
    "cjk": r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]",
    "arabic": r"[[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]&&[^\p{Nd}]]",
    "other": r"\p{L}",
}


def class_counts(c: Column, classes: dict[str, str], use) -> Column:
    """``use`` of a struct with how many characters are of each class, every one counted for the first class it is of.

    What is counted is cut out before the next class is looked for, so the rarer classes are sought in what little is left.
    """
    names = list(classes)

    def step(left: Column, i: int, counts: list[Column]) -> Column:
        if i == len(names):
            return use(F.struct(*[n.alias(k) for n, k in zip(counts, names)]))
        return bind(F.regexp_replace(left, f"{classes[names[i]]}++", ""), lambda rest: step(rest, i + 1, [*counts, (F.length(left) - F.length(rest)).cast("bigint")]))

    return bind(_text(c), lambda t: step(t, 0, []))


def script_ratios(c: Column) -> Column:
    """A struct of six shares (cyrillic, latin, cjk, arabic, digit, other) of the counted characters; all 0 if none counts."""
    def shares(s: Column) -> Column:
        total = sum((s[k] for k in list(SCRIPTS)[1:]), s["cyrillic"])
        return F.struct(*[F.coalesce(ratio(s[k], total), F.lit(0.0)).alias(k) for k in ("cyrillic", "latin", "cjk", "arabic", "digit", "other")])

    return class_counts(c, SCRIPTS, lambda counts: bind(counts, shares))


def tokens(c: Column) -> Column:
    """Words between Unicode white space; case and punctuation stay."""
    return F.filter(F.split(_text(c), r"(?U)\s+"), lambda x: x != "")


def type_counts(words: Column) -> Column:
    """(run, weight, once) folded over the sorted words: sum of k * log2 k over the counts k of the types, and types with count 1."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("weight"), F.lit(0).alias("once"))

    def close(s: Column) -> Column:
        return F.struct(
            s["word"].alias("word"), s["run"].alias("run"),
            (s["weight"] + F.when(s["run"] > 1, s["run"] * F.log2(s["run"].cast("double"))).otherwise(0.0)).alias("weight"), (s["once"] + F.when(s["run"] == 1, 1).otherwise(0)).alias("once"),
        )

    def step(s: Column, w: Column) -> Column:
        same = F.struct(s["word"].alias("word"), (s["run"] + 1).alias("run"), s["weight"].alias("weight"), s["once"].alias("once"))
        other = F.struct(
            w.alias("word"), F.lit(1).alias("run"),
            (s["weight"] + F.when(s["run"] > 1, s["run"] * F.log2(s["run"].cast("double"))).otherwise(0.0)).alias("weight"), (s["once"] + F.when(s["run"] == 1, 1).otherwise(0)).alias("once"),
        )
        return F.when(s["word"] == w, same).otherwise(other)

    return F.aggregate(F.array_sort(words), start, step, close)


def entropy_bits(words: Column, counts: Column | None = None) -> Column:
    """Shannon entropy of the word types in bits; null without words. ``counts`` is ``type_counts(words)`` if at hand."""
    n = F.size(words)
    counts = type_counts(words) if counts is None else counts
    return F.when(n > 0, F.log2(n.cast("double")) - counts["weight"] / n)


def hapax_ratio(words: Column, counts: Column | None = None) -> Column:
    """Share of word positions whose word occurs once; null without words."""
    n = F.size(words)
    counts = type_counts(words) if counts is None else counts
    return F.when(n > 0, counts["once"] / n)


def type_token_ratio(words: Column) -> Column:
    return ratio(F.size(F.array_distinct(words)), F.size(words))


def array_median(values: Column) -> Column:
    """Exact median of an array of numbers, the mean of the middle two for an even count; null if empty."""
    n = F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
    return F.when(n > 0, bind(F.array_sort(values), lambda v: (F.element_at(v, low) + F.element_at(v, high)) / 2.0))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def word_lengths(words: Column) -> Column:
    return F.transform(words, lambda w: F.length(w))


def long_word_ratio(words: Column) -> Column:
    return ratio(F.size(F.filter(words, lambda w: F.length(w) >= LONG_WORD)), F.size(words))


def short_utterance_ratio(bodies: Column) -> Column:
    """Share of non-blank bodies of at most two words; 0 if none."""
    said = F.filter(bodies, lambda b: b.rlike(r"(?U)\S"))
    short = F.filter(said, lambda b: F.size(tokens(b)) <= 2)
    return F.coalesce(ratio(F.size(short), F.size(said)), F.lit(0.0))


def repeated_char_run_ratio(c: Column) -> Column:
    """Letters and digits in runs of three or more of the same character, per letter and digit; 0 if there are none."""
    runs = F.regexp_extract_all(_text(c), F.lit(r"([\p{L}\p{N}])\1{2,}"), 0)
    inside = F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(ratio(inside, count_chars(c, r"[\p{L}\p{N}]")), F.lit(0.0))


def normalise_body(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def detection_sample(c: Column, max_chars: int) -> Column:
    """At most ``max_chars``: the head, the middle and the tail third; the text itself if short or the budget is not positive."""
    t = _text(c)
    if max_chars <= 0:
        return t
    wing = max_chars // 3
    if wing == 0:
        return F.when(F.length(t) <= max_chars, t).otherwise(F.substring(t, 1, max_chars))
    middle = max_chars - 2 * wing
    start = F.greatest(F.lit(0), F.floor((F.length(t) - middle) / 2)).cast("int")
    cut = F.concat(F.substring(t, 1, wing), F.substring(t, start + 1, F.lit(middle)), F.right(t, F.lit(wing)))
    return F.when(F.length(t) <= max_chars, t).otherwise(cut)


def excerpt(c: Column, max_chars: int) -> Column:
    """A struct (excerpt, limited): the stripped text, or labelled windows of its start, middle and end if it is longer."""
    t = strip(c)
    window = max(500, max_chars // 3)
    start = F.greatest(F.lit(0), F.floor(F.length(t) / 2) - window // 2).cast("int")
    head = F.regexp_replace(F.substring(t, 1, window), r"(?U)\s+$", "")
    middle = strip(F.substring(t, start + 1, F.lit(window)))
    tail = F.regexp_replace(F.right(t, F.lit(window)), r"(?U)^\s+", "")
    parts = F.concat(F.lit("[BEGINNING EXCERPT]\n"), head, F.lit("\n\n[MIDDLE EXCERPT]\n"), middle, F.lit("\n\n[ENDING EXCERPT]\n"), tail)
    long = F.length(t) > max_chars
    return F.struct(F.when(long, F.substring(parts, 1, max_chars + 300)).otherwise(t).alias("excerpt"), long.alias("limited"))


def file_extension(name: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(strip(name), r"\\", "/"), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]+)$", 1))


def basename_token_count(name: Column) -> Column:
    """Words of the last part of a path, the extension included; 0 for null and blank names."""
    parts = F.filter(F.split(F.regexp_replace(strip(name), r"\\", "/"), "/"), lambda x: ~x.isin("", "."))
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.size(F.filter(F.split(base, r"(?U)\W+"), lambda x: x != "")).cast("bigint")


def path_depth(name: Column) -> Column:
    """Folders above the file; 0 for null and blank names."""
    parts = F.filter(F.split(F.regexp_replace(strip(name), r"\\", "/"), "/"), lambda x: ~x.isin("", "."))
    return F.greatest(F.size(parts) - 1, F.lit(0)).cast("bigint")
