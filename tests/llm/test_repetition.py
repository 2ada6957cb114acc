import random

from turnwise.llm import repetition


def brute(text):
    words = repetition.WORD.findall(text.lower()) if text else []
    seen, hit = set(), [False] * len(words)
    for j in range(len(words) - 3):
        run = tuple(words[j : j + 4])
        if run in seen:
            hit[j : j + 4] = [True] * 4
        seen.add(run)
    return len(words), sum(hit)


def test_matches_brute_force():
    rng = random.Random(6)
    texts = [None, "", " ", "one two three", "a b c d a b c d", "so so so so so so", "A, b! C d. a b c d"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    n, again = repetition.covered(texts)
    assert [brute(t) for t in texts] == list(zip(n.tolist(), again.tolist()))


def test_runs_do_not_cross_texts():
    n, again = repetition.covered(["a b c d e", "a b c d e"])
    assert again.tolist() == [0, 0]


def test_found_once_per_id_and_markup_does_not_count(transcripts):
    said = "we ordered the new fence today"
    rows = [("r", "x", None, f"SPEAKER_00\n[00:00:01 - 00:00:09]\n{said} [noise] {said}"), ("r", "x", None, f"{said} {said}"), ("s", "x", None, said), ("n", None, None, None), ("e", "", "", "")]
    df = transcripts(rows)
    assert [r["id"] for r in repetition.repetitive(df).collect()] == ["r"]
    shares = {r["id"]: r["n_words"] for r in repetition.repeated_shares(df).collect()}
    assert shares["n"] == shares["e"] == 0 and shares["s"] == 6
    assert repetition.repeated_shares(df.limit(0)).count() == 0


def test_line_frequency_counts_distinct_documents_of_a_host(transcripts):
    rows = [(f"u{i}", "host", None, f"Standard greeting!\nline number {i} of its own\nanother own line {i * 7}") for i in range(30)]
    rows += [("u0", "host", None, rows[0][3])] * 30 + [("x", None, None, "Standard greeting!"), ("n", "host", None, None)]
    got = {r["id"]: r for r in repetition.line_frequency(transcripts(rows)).collect()}
    assert all((got[f"u{i}"]["n_lines"], got[f"u{i}"]["n_removed"], got[f"u{i}"]["rejected"]) == (3, 1, False) for i in range(30))
    assert (got["x"]["n_removed"], got["x"]["rejected"]) == (0, False) and "n" not in got


def test_an_id_under_two_hosts_is_two_documents(transcripts):
    got = repetition.line_frequency(transcripts([("a", "h", None, "one\ntwo"), ("a", "k", None, "one\ntwo\nthree"), ("a", "h", None, "one\ntwo")])).collect()
    assert sorted((r["id"], r["host"], r["n_lines"], r["n_removed"]) for r in got) == [("a", "h", 2, 0), ("a", "k", 3, 0)]


def test_report_keeps_every_transcript(transcripts):
    got = {r["id"]: (r["n_words"], r["n_lines"], r["n_removed"]) for r in repetition.repetition_report(transcripts([("a", "h", None, "one two"), ("n", None, None, None), ("e", "", "", "")])).collect()}
    assert got == {"a": (2, 1, 0), "n": (0, 0, 0), "e": (0, 0, 0)}
