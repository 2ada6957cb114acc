import pytest

from turnwise.llm import language


@pytest.fixture(scope="module")
def model(spark, small):
    return language.fit(language.references(spark, f"{small}/lang_reference.parquet", f"{small}/common_words.parquet"))


def test_held_out_accuracy(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/lang_reference.parquet").orderBy("ref_id").select("lang", "text").collect()]
    held, kept = rows[::4], [r for i, r in enumerate(rows) if i % 4]
    s = language.Scorer(language.fit(kept))
    right = 0
    for lang, text in held:
        for form in {text, text.upper(), language.latin(text, lang)}:
            _, got, _, words = s.stretches([form])
            right += s.langs[got[words.argmax()]] == lang
    total = sum(len({t, t.upper(), language.latin(t, lang)}) for lang, t in held)
    assert right / total > 0.9


def test_mixed_and_empty(spark, model, transcripts):
    text = "We agreed on the new schedule, and the rest can wait until autumn. " * 2 + "Мы пересчитали старые накладные на чистом листе, и это удивило меня больше всего. " * 2
    df = spark.createDataFrame([("m", text), ("n", None), ("e", ""), ("d", "123 !!! ..."), ("m", text)], "id string, _spoken string")
    got = {r["id"]: r for r in language.label_languages(df, model).collect()}
    assert [s["lang"] for s in got["m"]["stretches"]] == ["en", "ru"]
    assert sum(s["n_words"] for s in got["m"]["stretches"]) == got["m"]["n_words"]
    assert all(0 < s["confidence"] <= 1 for s in got["m"]["stretches"])
    assert [got[k]["n_words"] for k in "ned"] == [0, 0, 0] and got["n"]["stretches"] == []
    assert language.document_languages(language.label_languages(df, model)).filter("id = 'n' and lang is null").count() == 1


def test_other_languages_are_not_forced_into_the_fitted_ones(model):
    foreign = [
        "Ieri siamo andati al mare con i nostri amici e abbiamo mangiato il pesce.", "Yarın sabah erkenden kalkıp işe gideceğiz çünkü toplantı saat dokuzda.",
        "Tegnap este sokáig beszélgettünk a kertben a szomszédokkal az időjárásról.", "Αύριο το πρωί θα πάμε στην αγορά για να αγοράσουμε ψωμί.", "Včera večer jsme dlouho seděli na zahradě a povídali si o počasí.",
    ]
    s = language.Scorer(model)
    doc, lang, confidence, _ = s.stretches(foreign)
    assert set(doc) == set(range(len(foreign))) and (lang == len(s.langs)).all() and (confidence > 0.8).all()


def test_two_models_do_not_share_a_cache(spark):
    df = spark.createDataFrame([("a", "eins zwei drei vier")], "id string, _spoken string").coalesce(1)
    for names in (("x", "y"), ("v", "w")):
        own = language.fit([(names[0], "eins zwei drei vier fünf"), (names[1], "one two three four five")])
        assert language.label_languages(df, own).first()["stretches"][0]["lang"] == names[0]


def test_mislabelled_rules(spark, model, transcripts):
    en = "We agreed on the new schedule after the holidays, and the rest can wait until autumn because nobody asked for it."
    ru = "Мы пересчитали старые накладные на чистом листе после праздников, и это удивило меня больше всего, но цифры нормальные."
    rows = [("ok", "u", None, en), ("region", "u", None, en), ("wrong", "u", None, en), ("null", "u", None, ru), ("norow", "u", None, ru), ("two", "u", None, en + "\n" + ru), ("short", "u", None, "Yes, of course."), ("twice", "u", None, ru), ("twice", "u", None, ru)]
    labels = [("ok", "EN"), ("region", "en-GB"), ("wrong", "ru"), ("null", None), ("two", "en"), ("short", None), ("twice", "english"), ("twice", "english")]
    features = spark.createDataFrame([(i, x, 1) for i, x in labels], "id string, layer_b_primary_language string, spoken int")
    got = {(r["id"], r["lang"]) for r in language.mislabelled(transcripts(rows), features, model, ["the", "and", "мы", "на"]).collect()}
    assert got == {("wrong", "en"), ("null", "ru"), ("norow", "ru"), ("two", "en"), ("two", "ru"), ("twice", "ru")}
    assert language.mislabelled(transcripts(rows).limit(0), features.limit(0), model, []).count() == 0
