import pytest

from turnwise.llm import pii

CASES = [
    ("email", "Please write to t_harlan09@postfach.test today.", "t_harlan09@postfach.test"),
    ("email", "Проверьте. Пишите на lev7771 собака notes точка example точка net сегодня.", "lev7771 собака notes точка example точка net"),
    ("email", "They answered from office+memo (at) pochta.example yesterday.", "office+memo (at) pochta.example"),
    ("phone", "Звонил на +7 (246) 025-43-08, никто не взял.", "+7 (246) 025-43-08"),
    ("phone", "Ich habe (0221) 4710-156 gewählt und niemand ging ran.", "(0221) 4710-156"),
    ("phone", "Zadzwoń na 288 001 312 po pracy.", "288 001 312"),
    ("id_number", "СНИЛС 000-777-473 69, как на карточке.", "000-777-473 69"),
    ("id_number", "Die Versicherungsnummer lautet 00 265613 X 413, wie auf der Karte.", "00 265613 X 413"),
    ("id_number", "Номер документа 00 46 № 099693, это удостоверение.", "00 46 № 099693"),
    ("address", "Живу по адресу ул. Тополёвая, д. 122, кв. 84, звоните два раза.", "ул. Тополёвая, д. 122, кв. 84"),
    ("address", "Send the parcel to Flat 6, 104 Quarry Bell Street, please.", "Flat 6, 104 Quarry Bell Street"),
    ("address", "Mieszkam przy ulica Olchowa 9 m. 50, proszę dzwonić dwa razy.", "ulica Olchowa 9 m. 50"),
    ("name", "Меня зовут Лев Завьюгых, я подключился позже.", "Лев Завьюгых"),
    ("name", "Das hat gestern Kai R. Rautenhold gesagt.", "Kai R. Rautenhold"),
    ("name", "So that was Tobin Wrenfordorth on the line.", "Tobin Wrenfordorth"),
]
NOT = ["Заявка 4707778160 закрыта, код отправки 737-8366.", "Ник в чате @studio_992, и всё.", "Order number 82831267 is still open.", "We met at the Copper Lantern near Northern Ridge.", "Версия 4.3.1 вышла 15.07.2025.", "Кабинет 718 на этаже 1 свободен."]


@pytest.mark.parametrize("kind, text, value", CASES)
def test_spans_are_proposed_exactly(kind, text, value):
    assert (kind, value) in {(c[0], c[1]) for c in pii.candidates(text)}


FIRST = ("Anna", "Karl", "Lena", "Otto", "Ida", "Hugo")
LAST = ("Bergheim", "Talmann", "Rautenhold", "Steinort", "Wiesner", "Kolbing", "Dornach", "Mehlhorn")
# sentences that stand in no list of the operator, each with what it holds; {n} is a name, {d} are digits
TEMPLATES = {
    "said": ("name", "It was {n} who brought the cake.", "{n}"),
    "asks": ("name", "Yesterday {n} went home early.", "{n}"),
    "lower": ("name", "yesterday {l} went home early", "{l}"),
    "reach": ("phone", "Reach us under {d} 44 {d}, day or night.", "{d} 44 {d}"),
    "plus": ("phone", "Reach us under +49 {d} 44 {d}, day or night.", "+49 {d} 44 {d}"),
    "intro": ("name", "My name is {n}, hello.", "{n}"),
}


def _documents():
    rows, want = [], set()
    for i, first in enumerate(FIRST):
        for j, last in enumerate(LAST):
            fill = {"n": f"{first} {last}", "l": f"{first} {last}".lower(), "d": f"{2 + i}{j}{i}{j}"}
            for t, (kind, text, value) in TEMPLATES.items():
                rows.append((f"{t}{i}{j}", "u", None, f"SPEAKER_00\r\n[00:00:01 - 00:00:09]\r\nWe agreed. {text.format(**fill)}"))
                want.add((f"{t}{i}{j}", kind, value.format(**fill)))
    return rows, want


def test_contexts_and_names_are_learned_from_the_table(transcripts):
    rows, want = _documents()
    rows += [(f"n{k}{j}", "u", None, f"We agreed. {t}") for j in range(3) for k, t in enumerate(NOT)] + [rows[0], ("null", None, None, None), ("e", "", "", "")]
    rows += [(f"k{k}", "u", None, t) for k, (kind, t, _) in enumerate(CASES) if kind in ("email", "address", "id_number")]
    want |= {(f"k{k}", kind, value) for k, (kind, _, value) in enumerate(CASES) if kind in ("email", "address", "id_number")}
    df = transcripts(rows)
    got = {(r["id"], r["kind"], r["value"]) for r in pii.personal_information(df).collect()}
    missed = want - got
    assert len(missed) <= 0.05 * len(want), sorted(missed)[:20]
    assert len(got - want) <= 0.02 * len(got), sorted(got - want)[:20]
    assert not [x for x in got if x[0].startswith("n")]
    text = {r["id"]: r["text"] for r in pii.redacted(df).collect()}
    assert len(text) == len(set(r[0] for r in rows)) and text["null"] is None and text["e"] == ""
    assert text["plus11"] == "SPEAKER_00\r\n[00:00:01 - 00:00:09]\r\nWe agreed. Reach us under [PHONE], day or night."


def test_texts_of_one_id_keep_their_own_places(transcripts):
    rows = [("a", "u", None, "write to t_harlan09@postfach.test today"), ("a", "u", None, "zz now write to lev@inbox.example"), ("b", "u", None, "by lev@inbox.example")]
    assert {r["id"]: r["text"] for r in pii.redacted(transcripts(rows)).collect()} == {"a": "write to [EMAIL] today", "b": "by [EMAIL]"}


def test_spans_are_cut_out_by_place():
    text = "SPEAKER_00: call 12 34\r\n[00:01] Anna Berg and Anna Bergmann, 12 3456\rAnna Berg"
    bare = "call 12 34\nAnna Berg and Anna Bergmann, 12 3456\nAnna Berg"
    found = [(bare.index("12 34"), 5, "phone"), (bare.index("Anna Berg"), 9, "name"), (bare.rindex("Anna Berg"), 9, "name")]
    assert pii.replaced(text, bare, found) == "SPEAKER_00: call [PHONE]\r\n[00:01] [NAME] and Anna Bergmann, 12 3456\r[NAME]"


def test_empty_table(transcripts):
    assert pii.personal_information(transcripts([("a", None, None, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("gap", [" ", " \u200b", "  ", "\t"])
def test_odd_gaps(gap):
    for text, name in (("Меня зовут Лев Завьюгых, я подключился позже.", "Лев Завьюгых"), ("So that was Priya Harrowgley who will call you back.", "Priya Harrowgley")):
        plain = [c for c in pii.candidates(text) if c[0] == "name"]
        odd = [c for c in pii.candidates(text.replace(" ", gap)) if c[0] == "name"]
        assert odd[0][1] == name.replace(" ", gap) and odd[0][3:] == plain[0][3:]


def test_names_in_lower_case():
    contexts = {"left": {"^ yesterday": 1}, "right": {"went home": 1}}
    cues = pii.automaton({"yesterday": ("left", "^ yesterday"), "went home": ("right", "went home")})
    found = lambda text, given=frozenset(("anna",)): [c[1] for c in pii.names_in_lower_case(text, cues, contexts, given)]
    assert found("well. yesterday lea stern went home") == ["lea stern"]
    assert found("yesterday anna stern was here") == ["anna stern"] and found("and stern anna went home") == ["stern anna"]
    assert found("yesterday we agreed on it") == found("the dog went home") == found("yesterday Anna Stern went home") == []
    assert found("yesterday we agreed on it", None) == ["we agreed"]


def test_gazetteer_has_no_cap(spark, monkeypatch):
    from pyspark.sql import functions as F

    n = 21_000
    found = spark.range(3 * n).select(F.lit("x").alias("id"), F.lit("name").alias("kind"), F.lit("v").alias("value"), F.lit(0).alias("start"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit(1).alias("lone"), F.concat(F.lit("t"), F.col("id") % n).alias("first"), F.concat(F.lit("p"), F.col("id")).alias("last"), F.array(*map(F.lit, (1, 0, 1, 0, 0, 0))).alias("votes"))
    names = pii.gazetteer(found)
    assert names.count() == n
    other = found.limit(5).withColumns({"kind": F.lit("email"), "first": F.lit(""), "last": F.lit("")})
    votes = {}
    for most in (n, 1):  # broadcast, shuffled
        monkeypatch.setattr(pii, "MAX_BROADCAST", most)
        votes[most] = sorted((r["kind"], r["votes"][pii.GAZETTEER], r["count"]) for r in pii.with_gazetteer(found.unionByName(other), names).groupBy("kind", "votes").count().collect())
    assert votes[n] == votes[1] == [("email", 0, 5), ("name", 1, 3 * n)]


def test_overlaps_are_settled_from_the_likeliest_on(spark):
    chain = [("chain", "phone", "a" * 10, 0, 0.6), ("chain", "name", "b" * 10, 8, 0.7), ("chain", "address", "c" * 10, 16, 0.8)]
    cover = [("cover", "address", "d" * 30, 0, 0.9), ("cover", "name", "e" * 5, 2, 0.8), ("cover", "phone", "f" * 5, 10, 0.7), ("cover", "phone", "g" * 5, 30, 0.6)]
    likely = spark.createDataFrame(chain + cover + chain, "id string, kind string, value string, start int, probability double")
    got = sorted((r["id"], r["value"][0]) for r in pii.resolved(likely).collect())
    assert got == [("chain", "a"), ("chain", "c"), ("cover", "d"), ("cover", "g")]
