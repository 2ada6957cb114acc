import re

import pytest

from turnwise.llm import quality

COMMON = ["the", "and", "we", "to", "of", "is", "was", "in", "it", "on", "и", "мы", "на", "в"]
PROSE = "We agreed on the new schedule, and it was the best we had in a year. The rest is to be done on Monday."
CASES = {
    "prose": (PROSE, False),
    "reply": ("SPEAKER_00: Yes.", False),
    "raw": ("we agreed on the new schedule and it was the best we had in a year the rest is to be done", False),
    "numbered": ("\n".join(f"{i}. We agreed on item {i} in the end." for i in range(1, 9)), False),
    "repeated": ("кабель " * 80, False),
    "list": ("SPEAKER_00\n[00:00:00 - 00:01:00]\n" + "\n".join(f"- the cable drum x{i}" for i in range(20)), True),
    "numbered list": ("\n".join(f"{i}) cable drum;" for i in range(1, 20)), True),
    "bare list": ("\n".join(["cable drum", "new schedule", "tea supplies x3"] * 6), True),
    "table": ("\n".join(f"{i} | 00:32:30 | 883.61 | audio" for i in range(20)), True),
    "tabs": ("\n".join(f"{i}\t713.57\teditor\t01:52:57" for i in range(20)), True),
    "json": ("\n".join(f'{{"seg":{i},"p":[0.46,0.38]}}' for i in range(20)), True),
    "hex": ("\n".join(f"000000{i}0  8f c4 2b 4d 1b 7b 48 1f" for i in range(9)), True),
    "base64": ("aE6BJK3zJZg9Ji0mgtbWtAhZS3cVnyUJs5M9fRx41J5hp7pWqKIWxlFnsUqE" * 5, True),
    "letters": ("шлюкьхтчг шбдтожлчщсв йюнолбй дъйгжпт ьхмкн вьлкптр жхсшщпг тпкмнрс цшгщкв", True),
    "symbols": ("?>@> ]][@};=<(:  ! ^!=   :> +%% +^[  >:${:} ?:*: />(+](.!~;  ~&% !;" * 4, True),
    "half prose": (PROSE * 3 + "\n1 | 2 | 3", False),
}


@pytest.fixture(scope="module")
def rows(spark):
    from tests.conftest import TRANSCRIPT

    data = [(k, "u", None, None, None, t, "x") for k, (t, _) in CASES.items()] + [("null", None, None, None, None, None, "x"), ("blank", None, None, "", "", " \n ", "x")]
    return spark.createDataFrame(data, TRANSCRIPT + ", n_words string")


def test_junk_cases(rows):
    got = {r["id"]: r for r in quality.text_quality(rows, COMMON).collect()}
    assert {k: got[k]["junk"] for k in CASES} == {k: v for k, (_, v) in CASES.items()}
    assert set(quality.junk_transcripts(rows, COMMON).toPandas()["id"]) == {k for k, (_, v) in CASES.items() if v}
    assert got["null"]["reasons"] == got["blank"]["reasons"] == ["empty"] and got["null"]["n_words"] == 0 and got["null"]["common_share"] is None


def test_statistics_match_plain_python(rows):
    r = {x["id"]: x for x in quality.text_quality(rows, COMMON).collect()}["prose"]
    words = PROSE.split()
    assert r["n_words"] == len(words)
    assert abs(r["mean_word_length"] - sum(map(len, words)) / len(words)) < 1e-9
    assert r["punctuated_share"] == 1.0 and r["n_lines"] == 1
    assert r["n_common"] == sum(w.strip(".,").lower() in COMMON for w in words)
    assert "too_few_words" in r["reasons"] and not set(quality.CASES) & set(r["reasons"])


# wording, separators, lengths and marks that were not looked at when the thresholds were set
HELD_OUT = {
    "long cells": ("\n".join(f"the second quarter report of the southern region{i};a rather long remark about the delivery of goods;{i * 37}" for i in range(20)), "table_rows"),
    "long items": ("\n".join(f"- stainless steel kitchen knife with wooden handle size {i} shipped worldwide overnight" for i in range(20)), "list_items"),
    "log": ("\n".join(f"2024-03-0{i} 12:00:0{i},{i}17 0x7f{i}a [{i}] {{}} 200 {i * 991} -> 0.{i}31" for i in range(1, 9)), "codes"),
    "csv": ("\n".join(f"{i},Madrid,{i * 7.5},open,yes" for i in range(20)), "table_rows"),
    "xml": ("\n".join(f'<a x="{i}" y="{i * 31}"/><b>{i}</b>' for i in range(20)), "codes"),
    "shopping": ("\n".join(["dos kilos manzanas", "leche entera", "pan integral", "queso curado", "aceite oliva", "una docena huevos"] * 3), "list_items"),
    "dashes": ("- Where did you go after the meeting?\n- To the station, and then home.\n- Did anyone see you?\n- I do not think so." * 3, None),
    "spanish": ("Ayer fuimos al mercado y compramos pan, queso y fruta. Luego volvimos a casa y preparamos la cena juntos. " * 3, None),
    "steps": ("\n".join(f"Step {i}: we open the lid and wait until the light is green" for i in range(1, 9)), None),
    "sums": ("So 2 and 2 is 4, and 3 times 7 is 21, which we all know. The total was 1,250.50 in the end; 300 of it was mine.", None),
    "aside": ("We went on and on; then we stopped; then we went on again, and it was late; nobody was in the hall.", None),
    "repeated item": ("1. the broken door the broken door the broken door the broken door the broken door\n2. We went on.", None),
}


def test_held_out_wording(rows, spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in HELD_OUT.items()], "id string, transcription_text string")
    got = {r["id"]: [x for x in r["reasons"] if x in quality.CASES] for r in quality.text_quality(df, COMMON).collect()}
    assert {k: bool(v) for k, v in got.items()} == {k: want is not None for k, (_, want) in HELD_OUT.items()}
    assert all(want is None or want in got[k] for k, (_, want) in HELD_OUT.items())


def test_counts_match_plain_python_on_the_tables(spark, small):
    common = quality.common_words(spark, f"{small}/common_words.parquet")
    from turnwise.llm.markup import spoken

    texts = [r[0] for r in spark.read.parquet(f"{small}/sample_multiline.parquet").select(spoken("transcription_text")).collect()] + [None, "", " \n\n", "\n", "a"]
    got = quality.count(texts, quality.common_hashes(common))
    for i, t in enumerate(texts):
        words, lines = (t or "").split(), [x.strip() for x in (t or "").split("\n") if x.strip()]
        tokens = re.findall(r"[^\W\d_]+", (t or ""))
        assert got["n_words"][i] == len(words) and got["visible"][i] == sum(map(len, words)) and got["n_lines"][i] == len(lines)
        assert got["ellipses"][i] == sum(x.endswith(("...", "…")) for x in lines)
        assert got["tokens"][i] == len(tokens) and got["n_common"][i] == sum(w.lower() in common for w in tokens)


def test_very_long_texts_and_empty_table(spark, rows):
    from tests.conftest import TRANSCRIPT

    long = [("a;b;" * 60_000), ("| " * 60_000), ("word " * 60_000), ("- item\n" * 30_000), ("]{" * 60_000), "a" * 400_000]
    df = spark.createDataFrame([(str(i), None, None, None, None, t) for i, t in enumerate(long)], TRANSCRIPT)
    assert quality.text_quality(df, COMMON).count() == len(long)
    assert quality.text_quality(rows.limit(0), COMMON).count() == 0


def test_parts_give_the_same_counts(monkeypatch):
    from turnwise.llm import language, markup, repetition

    texts = [t for t, _ in CASES.values()] + [None, "", PROSE * 40] * 3
    model = language.fit([("en", PROSE), ("es", "ayer fuimos al mercado y compramos pan"), ("de", "wir haben den Plan geändert und es ist gut")])
    whole = [quality.count(texts, quality.common_hashes(COMMON)), repetition.covered(texts), language.Scorer(model).stretches(texts)]
    monkeypatch.setattr(markup, "PART_CHARS", 300)
    cut = [quality.count(texts, quality.common_hashes(COMMON)), repetition.covered(texts), language.Scorer(model).stretches(texts)]
    assert all((whole[0][f] == cut[0][f]).all() for f in quality.FIELDS)
    assert all((a == b).all() for k in (1, 2) for a, b in zip(whole[k], cut[k]))
