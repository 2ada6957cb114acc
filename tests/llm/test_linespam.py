import pytest

from turnwise.llm import linespam

SMALL = ["the", "and", "we", "to", "of", "is", "was", "in", "on", "a"]
PROSE = "We agreed on the new schedule in the end. The rest was to be done on Monday, and the list is long. " * 4
CASES = {
    1: (PROSE, False),
    2: (PROSE + "See https://example.org/a and https://example.org/b for the rest.", False),
    3: ("\n".join(f"Term {i}: the meaning of it is to be found in a book." for i in range(12)), False),
    4: ("\n".join(f"{i}. We agreed on the plan in the end." for i in range(12)), False),
    5: ("buy recorder review recorder cheap recorder best recorder free shipping recorder top recorder " * 12, True),
    6: ("\n".join(f"https://cheap-audio.example/offer-{i}" for i in range(30)), True),
    7: ("#audiotop #voice_cheap #recorderbuy #audio_buy " * 20, True),
    8: ("Tags: " + " · ".join(["cheap recorder", "buy microphone", "audio mini 507", "top recorder", "buy recorder"] * 12), True),
    9: ("h t t p s : / / linktape[.]test/offer174 hxxp://tape (.) example (.) net/page7 " * 10, True),
    10: ("We agreed on it.\n" + "Recorder buy, recorder cheap voice! Top recorder.\n" * 14, True),
    11: (None, False),
    12: ("", False),
    13: (" \n ", False),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in CASES.items()], "doc_id bigint, text string, top string")
    got = {r["doc_id"]: r["spam_share"] for r in linespam.line_shapes(df, SMALL).collect()}
    assert {k: v >= linespam.SPAM_SHARE for k, v in got.items()} == {k: v for k, (_, v) in CASES.items()}
    assert {r[0] for r in linespam.spam_pages(df.union(df), SMALL).collect()} == {k for k, (_, v) in CASES.items() if v}
    assert linespam.spam_pages(df.limit(0), SMALL).count() == 0


# endings, wording and layouts that are in no list of the operator
HELD_OUT = {
    "bare hosts": ("\n".join(f"recorder{i}.shop/deal-{i}" for i in range(20)), True),
    "new endings": ("\n".join(f"best-tape{i}.online best-mic{i}.xyz cheap{i}.store" for i in range(12)), True),
    "small words": ("the best shoes of the year shoes to buy in the shoes shop\n" * 12, True),
    "markdown": ("\n".join(f"* [laptop bag {i}](/bags/{i}.html)" for i in range(30)), True),
    "breadcrumbs": ("\n".join("Home > Shoes > Running > Shoes > Sale > Shoes" for i in range(15)), True),
    "html": ("".join(f'<a href="https://casa{i}.casa/{i}">vuelos baratos</a> ' for i in range(30)), True),
    "spanish tags": ("#zapatos #ofertas #zapatosbaratos #moda #rebajas " * 15, True),
    "recipe": ("Heat the oven to 200 degrees. Put the onions in a pan and fry them in butter. Serve it with bread on a warm plate. " * 3, False),
    "cited": ("The report (see docs.python.org/3/library) was published in May. It is on the site of the institute, www.example.com, and in the library. " * 2, False),
    "versions": ("We moved to version 2.10.3 of the tool, e.g. for the tests, i.e. the slow ones, and to file.txt in the end. It was a good day in the office.", False),
    "dialogue": ("Was it you? No, it was not. And the dog? The dog was in the garden. So who was it? We do not know to this day.", False),
}


def test_held_out_pages():
    got = {k: linespam.weigh(t, frozenset(SMALL))[2] for k, (t, _) in HELD_OUT.items()}
    assert {k: v >= linespam.SPAM_SHARE for k, v in got.items()} == {k: v for k, (_, v) in HELD_OUT.items()}, got


@pytest.mark.parametrize("text", ["word " * 100_000, "a," * 100_000, "\n" * 100_000, "x" * 300_000, "http://" * 30_000])
def test_very_long(text):
    assert 0 <= linespam.weigh(text, frozenset(SMALL))[2] <= 1 + 1e-9


def test_all_shapes_count_however_many():
    links = [" ".join(["bb"] * words + [f"http://x.example/{'p' * (90 // n)}"] * n) for n in (1, 2, 3) for words in (0, 1, 2, 3, 4, 7, 10)]
    prose = ["This is the reason and the way of it, said once."] * 30
    total, shapes, share, top = linespam.weigh("\n".join(links + prose), frozenset(("this", "is", "the", "and", "of")))
    assert len(top) == linespam.TOP_SHAPES < shapes
    assert share == pytest.approx(sum(map(len, links)) / total) and sum(x for _, x in top) < linespam.SPAM_SHARE < share
