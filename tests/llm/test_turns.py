import pytest

from turnwise.llm import turns

WORDS = frozenset(turns.SEED_WORDS)


def speakers(text):
    return [s for s, _ in turns.turns(text, WORDS)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPEAKER_00\n[00:00:01 - 00:00:02]\nhi there\n\nSPEAKER_01\n[00:00:03 - 00:00:04]\nhello", ["SPEAKER_00", "SPEAKER_01"]),
        ("[ speaker_3 ] (00:02): one\nSpeaker_3 (00:05): two\nSprecher B: three", ["SPEAKER_03", "SPEAKER_B"]),
        ("00:00:02 --> 00:00:05\n[SPEAKER_01]: later\n\n00:00:00,500 --> 00:00:01\nSPEAKER_00: earlier", ["SPEAKER_00", "SPEAKER_01"]),
        ("SPEAKER_00\n00:00:09 - 00:00:10: late\nSPEAKER_01\n00:00:01 - 00:00:02: early\n00:00:11 - 00:00:12: last", ["SPEAKER_01", "SPEAKER_00", "SPEAKER_01"]),
        ("SPEAKER_00\n00:00:05 - 00:00:06: b\n[??:??:??] stays behind b\nSPEAKER_01\n00:00:01 - 00:00:02: a", ["SPEAKER_01", "SPEAKER_00"]),
        ("SPEAKER_00: Ммм... [смех]\nSPEAKER_01: Хм?\nSPEAKER_02: да", ["SPEAKER_02"]),
        ("SPEAKER_00: one\r\nSPEAKER_01: [noise]\r\nSPEAKER_00: two\r\nand more", ["SPEAKER_00"]),
        ("SPEAKER_00: а а а а\nSPEAKER_01: Э-э... Yyym.\nSPEAKER_02: Ähm, öhm", ["SPEAKER_00"]),
        ("no labels at all\nsecond line", []),
        ("before any label\nSPEAKER_00: after", ["SPEAKER_00"]),
        ("", []),
        (None, []),
        ("Телефон 8 265 433 15 45", []),
    ],
)
def test_turn_rules(text, want):
    assert speakers(text) == want


def test_text_is_clean():
    assert turns.turns("SPEAKER_00\n00:00:01 - 00:00:02: [music]  well,\nyes (laughter)", WORDS) == [("SPEAKER_00", "well, yes")]


def test_long_text_is_read_whole():
    text = "\n".join(f"SPEAKER_0{i % 2}: line {i}" for i in range(20_000))
    assert len(speakers(text)) == 20_000


def test_unknown_label_words_are_mined(spark, transcripts):
    rows = [(f"u{i}", "a", None, f"Tolmach 0: hello number {i} is here\nTolmach 1: and this is the answer") for i in range(40)]
    rows += [("u0", "a", None, rows[0][3]), ("n", None, None, None), ("e", "", "", "")]
    got = turns.speaker_turns(transcripts(rows), ["and", "is", "the"]).collect()
    assert len(got) == 80 and {r["speaker"] for r in got} == {"SPEAKER_00", "SPEAKER_01"}
    counted = {r["template"]: r["n_lines"] for r in turns.mine(transcripts(rows)).collect()}
    assert counted["tolmach <no> :"] == 82


def test_empty_table(transcripts):
    assert turns.speaker_turns(transcripts([("a", None, None, "x")]).limit(0), []).count() == 0


def test_label_words_do_not_depend_on_the_size_of_the_table(spark, transcripts):
    rows = [(f"u{i}", "a", None, f"Tolmach 0: hello number {i} is here\nTolmach 1: and this is the answer\nTolmach 0: the end") for i in range(5)]
    rows += [("own", "a", None, "Habarkar 1: this is one\nHabarkar 2: and two\nHabarkar 1: the third\nHabarkar 2: is last")]
    rows += [(f"list{i}", "a", None, "Chapter 1: this is one\nChapter 2: and two\nChapter 3: the third") for i in range(30)]
    few = turns.speaker_turns(transcripts(rows), ["and", "is", "the"]).collect()
    more = turns.speaker_turns(transcripts(rows).unionByName(transcripts([(f"p{i}", "a", None, f"plain words of speech number {i} and the rest") for i in range(12_000)])), ["and", "is", "the"]).collect()
    assert sorted(few) == sorted(more)
    assert sorted({r["id"] for r in few}) == ["own", "u0", "u1", "u2", "u3", "u4"] and len(few) == 5 * 3 + 4


@pytest.mark.parametrize(
    "layout",
    ["Tolmach 0 > one is it {i}\nTolmach 1 > two\nTolmach 0 > and three", "(00:00:09) <Tolmach #0> one is it {i}\n(00:00:11) <Tolmach #1> two\n(00:00:15) <Tolmach #0> and three", "[00:01] Tolmach 0 - one is it {i}\n[00:03] Tolmach 1 - two\n[00:05] Tolmach 0 - and three", "<v Tolmach 0>one is it {i}\n<v Tolmach 1>two\n<v Tolmach 0>and three", "Tolmach 0 00:00:01\none is it {i}\nTolmach 1 00:00:04\ntwo\nTolmach 0 00:00:06\nand three", "SPEAKER_00: 00:00:02 one is it {i}\nSPEAKER_01: 00:00:04 two\nSPEAKER_00: 00:00:06 and three"],
)
def test_layouts_the_fixed_pattern_does_not_know_are_inferred(transcripts, layout):
    rows = [(f"u{i}", "a", None, layout.format(i=i)) for i in range(5)]
    got = {(r["id"], r["turn_no"]): (r["speaker"], r["text"]) for r in turns.speaker_turns(transcripts(rows), ["and", "is", "it"]).collect()}
    assert len(got) == 15
    assert [got["u3", k] for k in (1, 2, 3)] == [("SPEAKER_00", "one is it 3"), ("SPEAKER_01", "two"), ("SPEAKER_00", "and three")]
