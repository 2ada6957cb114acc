"""Raw transcripts into clean, ordered speaker turns.

Method: line templates are mined with a fixed-depth token tree. The first ``DEPTH`` tokens of each line, as far as it
starts with times, numbers, signs and words before a number or letter, are its path in the tree: times, unreadable times,
numbers and single letters become wildcards, signs and words stay (in lower case). Paths are counted over all transcripts
with how their slots behave within a transcript; only counts leave the tasks. Slots are inferred from behaviour: a number
or letter behind a word that comes back after others is a speaker slot, the first time that grows from line to line is the
start slot, each in at least ``MIN_ALTERNATING`` transcripts and in half of those that use the template repeatedly.

A fixed pattern (``HEAD``) reads the common layouts, so that tiny inputs work too: time, then label, then time in brackets.
Its label words are a small seed list, words that behave like labels in enough transcripts (a fixed number, whatever the
size of the table: ``MIN_ALTERNATING`` in which their numbers come back after others, or ``MIN_TRANSCRIPTS`` at all, and not
mostly lists that only count on), and words whose numbers come back ``OWN_RETURNS`` times in the transcript itself. Where
the inferred slots of a template differ from what the pattern reads, the slots count. Rules of extraction:

* an utterance belongs to the last label at or before it; several timed lines under one label are several utterances;
  a line without label and time continues the utterance before it;
* utterances that hold only sound annotations and hesitations are dropped;
* the others are ordered by start; one without a readable start stays right behind the one written before it;
* a turn is a longest run of utterances of one speaker.

Transcripts without labels have no turns. Null and empty texts have none either.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.markup import distinct_rows, spoken
from turnwise.llm.quality import common_hashes, junk
from turnwise.session import map_batches

DEPTH = 8
MIN_TRANSCRIPTS = 20
MIN_ALTERNATING = 3
OWN_RETURNS = 2
REPEATED = 3
MOSTLY = 0.7
TIMES = 4

# fixed values: words that introduce a speaker
SEED_WORDS = ("speaker", "spk", "спикер", "говорящий", "спікер", "мовець", "sprecher", "mówca", "rozmówca", "прамоўца")
# fixed values: sounds of hesitation, as patterns of the whole word
HESITATION = r"(?:э+м*|э(?:-э)+|м{2,}|хм+|гм+|е{2,}|е(?:-е)+|ем+|а{2,}|ы{2,}|hm+|m{2,}|u+h+|u+m+|e+r+m*|e+h+m*|ä+h+m*|ä{2,}|ö+h+m*|y{2,}m*|ym+|e{2,}|e+m+|a+h+m*|a{2,}|o+h+)"

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_LOST = r"\[(?:no time|[-?xX\d:., ]{4,40})\]"
_LABEL = r"\[?[ ]{0,2}(?P<word>[^\W\d_]{2,20})[ _](?P<who>\d{1,3}|[^\W\d_])[ ]{0,2}\]?(?=[ ]?\(\d|[ \t]*:|[ \t]*$)"
HEAD = re.compile(
    rf"^[ \t﻿]*(?P<time>\[?(?P<start>{_TIME})(?: ?(?:-->|->|-|–|—) ?{_TIME})?\]?:?(?=\s|$|\[|[^\W\d])|{_LOST})?[ \t]*(?:{_LABEL}[ ]?(?P<late>\((?P<start2>{_TIME})\))?[ \t]*:?)?[ \t]*"
)
_SOUND = re.compile(r"[\[(*<][^\W\d_][^\W\d_  ​]*(?:[  ​]+[^\W\d_]+)*[\])*>]")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_HESITATION = re.compile(HESITATION)
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_CLOCK = re.compile(_TIME)
_SEPARATOR = re.compile(r"[ \t]*-{20,}[ \t]*$")
_LETTER = r"[^\W\d_](?=[ ]?[\])}>:|=–—-]|[ \t]*$)"
_PIECE = re.compile(rf"{_TIME}|{_LOST}|-->|(?<=[<\[({{])[^\W\d_]{{1,20}}+(?= [^\W\d_]{{2,20}}[ _#№.-]{{0,2}}\d{{1,3}}(?![^\W_]))|[^\W\d_]{{2,20}}+(?=[ _#№.-]{{0,2}}\d{{1,3}}(?![^\W_])|[ _#№.-]{{1,2}}{_LETTER})|(?<=[ _#№.-]){_LETTER}|\d+|[^\w\s]|_")
RAW = re.compile(rf"(?:[ \t﻿]*(?:{_PIECE.pattern})){{1,{DEPTH}}}")
_JOINT = re.compile(r"[ _#№.-]*")
_CLOSE = re.compile(r"[ \t\])}>|:;,=–—-]*")


def template(head: str) -> str:
    """The path of a line head in the token tree: wildcards for what varies, at most ``DEPTH`` tokens."""
    path = []
    word = False
    for token in _PIECE.findall(head)[:DEPTH]:
        if token[0].isdigit():
            path.append("<time>" if ":" in token else "<no>")
        elif token[0] == "[" and len(token) > 1:
            path.append("[<time>]" if _CLOCK.search(token) else "<lost>")
        elif token[0].isalpha():
            path.append("<no>" if word and len(token) == 1 else token.lower())
            word = True
        else:
            path.append(token)
    return " ".join(path)


def slots(head: str) -> tuple[tuple[int, int, int, int] | None, list[tuple[int, int]]]:
    """(span of the first word and of the number or letter behind it, spans of the times) of a raw line head."""
    label, times, before = None, [], None
    for m in _PIECE.finditer(head):
        token = m.group()
        if ":" in token and len(token) > 1:
            times += [c.span() if token[0] != "[" else (m.start() + c.start(), m.start() + c.end()) for c in ([m] if token[0] != "[" else _CLOCK.finditer(token))]
        elif token[0].isalpha() and len(token) > 1:
            before = m.span()
        elif label is None and before and token.isalnum() and len(token) <= 3 and _JOINT.fullmatch(head, before[1], m.start()):
            label = (*before, *m.span())
    return label, times[:TIMES]


def grows(times: list[float]) -> bool:
    return sum(b >= a for a, b in zip(times, times[1:])) >= MOSTLY * (len(times) - 1) and times[-1] > times[0]


def behaviour(values: list[str]) -> tuple[int, bool]:
    """(times a value comes back after another, whether the values only count on as in a list)."""
    back, seen, last = 0, set(), None
    for v in values:
        if v != last:
            back += v in seen
            seen.add(v)
            last = v
    return back, len(values) >= 3 and len(seen) == len(values)


def observed(df: DataFrame, text: str = "transcription_text") -> DataFrame:
    """The line heads of all texts by template and by label word (``kind``), with how their numbers behave in transcripts.

    Only counts leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list] = {}
        known: dict[str, tuple] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                own: dict[str, list] = {}
                labels: dict[str, list[str]] = {}
                for line in _LINES.split(t) if t else ():
                    m = RAW.match(line)
                    if m is None:
                        continue
                    head = m.group()
                    shape = head.translate(_DIGITS)
                    at = known.get(shape)
                    if at is None:
                        if len(known) > 100_000:
                            known.clear()
                        at = known[shape] = (template(head), *slots(head))
                    path, label, times = at
                    use = own.get(path)
                    if use is None:
                        use = own[path] = [0, [], [[] for _ in range(TIMES)], head]
                    use[0] += 1
                    if label:
                        use[1].append(head[label[2] : label[3]].lower())
                        h = HEAD.match(line)
                        if h.group("word"):
                            labels.setdefault(h.group("word").lower(), []).append(h.group("who").lower())
                    for k, (x, y) in enumerate(times):
                        use[2][k].append(head[x:y])
                for path, (n, who, times, head) in own.items():
                    often = n >= REPEATED
                    back, listed = behaviour(who) if often else (0, False)
                    growing = [often and len(x) >= REPEATED and grows([seconds(c) for c in x]) for x in times]
                    _add(counts, ("template", path), (n, 1, back > 0, listed, often, *growing), head)
                for word, values in labels.items():
                    back, listed = behaviour(values)
                    _add(counts, ("word", word), (len(values), 1, back > 0, listed, 0, *[0] * TIMES), word)
            if len(counts) > 100_000:  # keep memory bounded whatever the input holds; the counts add up later
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    counted = map_batches(df.select(text), run, "kind string, name string, example string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return counted.groupBy("kind", "name").agg(F.min("example").alias("example"), *(F.sum(c).alias(c) for c in COUNTS))


def mine(df: DataFrame, text: str = "transcription_text") -> DataFrame:
    """(template, n_lines, n_transcripts): the line heads of all texts by template. Only counts leave a task."""
    return observed(df, text).filter("kind = 'template'").select(F.col("name").alias("template"), "n_lines", "n_transcripts")


COUNTS = ("n_lines", "n_transcripts", "n_alternating", "n_listed", "n_often", *(f"n_growing_{i}" for i in range(TIMES)))
_DIGITS = str.maketrans("123456789", "000000000")


def _add(counts: dict[tuple[str, str], list], key: tuple[str, str], more: tuple[int, ...], example: str) -> None:
    old = counts.get(key)
    counts[key] = [example, *(int(x) for x in more)] if old is None else [old[0], *(x + y for x, y in zip(old[1:], more))]


def _counts(counts: dict[tuple[str, str], list]) -> pa.RecordBatch:
    cols = list(zip(*counts.values())) if counts else [()] * (1 + len(COUNTS))
    arrays = [pa.array([k for k, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.string()), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "name", "example", *COUNTS])


def inferred(seen: DataFrame) -> tuple[list[str], dict[str, tuple[bool, int | None]]]:
    """Label words, and of each template that ``HEAD`` reads otherwise, whether it has a speaker slot and which time is its start.

    What comes back is bounded by the layouts and the vocabulary of labels that recur, not by the rows.
    """
    listed = 2 * F.col("n_listed") <= F.col("n_transcripts")
    word = (F.col("kind") == "word") & ((F.col("n_alternating") >= MIN_ALTERNATING) | (F.col("n_transcripts") >= MIN_TRANSCRIPTS)) & listed
    enough = lambda c: (F.col(c) >= MIN_ALTERNATING) & (2 * F.col(c) >= F.col("n_often"))
    speaker = enough("n_alternating") & listed
    slot = speaker
    for i in range(TIMES):
        slot = slot | enough(f"n_growing_{i}")
    rows = seen.filter(word | (F.col("kind") == "template") & slot).withColumn("speaker", speaker).collect()
    words = sorted({*SEED_WORDS, *(r["name"] for r in rows if r["kind"] == "word")})
    layouts = {}
    for r in rows:
        if r["kind"] != "template":
            continue
        grown = [r[f"n_growing_{i}"] for i in range(TIMES)]
        start = next((i for i, n in enumerate(grown) if n >= MIN_ALTERNATING and 2 * n >= r["n_often"] and (not i or n >= 2 * grown[0])), None)
        label, times = slots(r["example"])
        m = HEAD.match(r["example"])
        known = m.group("word") and m.group("word").lower() in words
        same_label = not r["speaker"] or known and m.span("who") == label[2:]
        same_start = start is None or times[start] in (m.span("start"), m.span("start2") if known else None)
        if not (same_label and same_start):
            layouts[r["name"]] = (r["speaker"], start)
    return words, layouts


_RAW_SHAPES: dict[str, tuple] = {}


def reading(line: str, layouts: dict[str, tuple[bool, int | None]]) -> tuple[tuple[str, str] | None, str | None, int] | None:
    """(label word and number or letter, start, end of the head) of a line whose template is among ``layouts``."""
    m = RAW.match(line)
    if m is None:
        return None
    head = m.group()
    shape = head.translate(_DIGITS)
    at = _RAW_SHAPES.get(shape)
    if at is None:
        if len(_RAW_SHAPES) > 100_000:
            _RAW_SHAPES.clear()
        path = template(head).split(" ")
        at = _RAW_SHAPES[shape] = ([" ".join(path[:k]) for k in range(len(path), 0, -1)], *slots(head))
    paths, label, times = at
    path = next((x for x in paths if x in layouts), None)  # speech may begin with what could belong to a head
    if path is None:
        return None
    speaker, start = layouts[path]
    who = (line[label[0] : label[1]], line[label[2] : label[3]]) if speaker else None
    clock = line[times[start][0] : times[start][1]] if start is not None else None
    end = max(label[3] if speaker else 0, times[start][1] if start is not None else 0)
    return who, clock, _CLOSE.match(line, end).end()


def seconds(time: str) -> float:
    parts = time.replace(",", ".").split(":")
    value = 0.0
    for p in parts:
        value = value * 60 + float(p)
    return value


def speaker_name(who: str) -> str:
    return f"SPEAKER_{int(who):02d}" if who.isdigit() else f"SPEAKER_{who.upper()}"


def says_something(body: str) -> bool:
    """Whether more is said than sound annotations and hesitations."""
    if "[" in body or "(" in body or "*" in body or "<" in body:
        body = _SOUND.sub(" ", body)
    for m in _WORD.finditer(body):  # the first word decides nearly always
        word = m.group()
        if len(word) > 8 or not _HESITATION.fullmatch(word.lower()):
            return True
    return False


def utterances(text: str, words: frozenset[str], layouts: dict | None = None) -> list[tuple[float | None, str | None, list[str]]]:
    """(start, speaker, lines) of each utterance as written. Words that behave like labels in this very text count as such."""
    others: dict[str, list[str]] = {}
    out: list[tuple[float | None, str | None, list[str]]] = []
    speaker: str | None = None
    current: list | None = None  # [start, speaker, lines, has its own label]
    waiting: float | None = None  # the start read on a line of its own before the speech or label
    timed = labelled = False
    match = HEAD.match
    for line in _LINES.split(text):
        if not line or line.isspace():
            continue
        if line[0] in "- \t" and _SEPARATOR.match(line):
            current, waiting, timed, labelled = None, None, False, False
            continue
        m = match(line)
        time, word, who = m.group("time", "word", "who")
        end = m.end()
        if word is not None and word.lower() not in words:
            others.setdefault(word.lower(), []).append(who.lower())
            word = who = None
            end = m.end("time") if time else 0
        late = m.group("late") if word is not None else None
        if time or late:
            start = m.group("start") if time and m.group("start") else None
            if late:
                start = m.group("start2")
            at = seconds(start) if start else None
        if layouts and (slot := reading(line, layouts)):
            if slot[0]:
                word, who = slot[0]
            if slot[1]:
                time = slot[1]
                at = seconds(time)
            end = max(end, slot[2])
        body = line[end:].strip() if end else line.strip()
        if word is not None:
            speaker = speaker_name(who)
            if time or late:
                waiting, timed = at, True
            elif labelled or not timed:
                waiting, timed = None, False
            labelled, current = True, None
            if not body:
                continue
        elif time:
            waiting, timed, current = at, True, None
            labelled = False
            if not body:
                continue
        if current is None:
            current = [waiting if timed else None, speaker, [body]]
            out.append(current)
            timed, waiting, labelled = False, None, False
        else:
            current[2].append(body)
    own = {w for w, values in others.items() if behaviour(values)[0] >= OWN_RETURNS}
    return utterances(text, words | own, layouts) if own else out


def turns(text: str | None, words: frozenset[str], layouts: dict | None = None, with_text: bool = True) -> list[tuple[str, str]]:
    """(speaker, text) of each turn in order; the text is left empty unless asked for."""
    if not text:
        return []
    kept = [u for u in utterances(text, words, layouts) if u[1] is not None and says_something(" ".join(u[2]))]
    anchor, keyed = (float("-inf"), -1), []
    for i, u in enumerate(kept):
        if u[0] is not None:
            anchor = (u[0], i)
        keyed.append((anchor, i, u))
    keyed.sort(key=lambda k: k[:2])
    out: list[tuple[str, list[str]]] = []
    for _, _, (_, speaker, lines) in keyed:
        if out and out[-1][0] == speaker:
            out[-1][1].extend(lines)
        else:
            out.append((speaker, list(lines)))
    if not with_text:
        return [(s, "") for s, _ in out]
    return [(s, " ".join(" ".join(_SOUND.sub(" ", x).split()) for x in lines)) for s, lines in out]


def speaker_turns(df: DataFrame, common: list[str], with_text: bool = True, key: str = "id", text: str = "transcription_text") -> DataFrame:
    """(id, turn_no, speaker[, text]): the turns of each transcript that is not a list, table or junk; repeated deliveries once.

    ``text`` is the turn's speech without labels, times and sound annotations. Extra columns are ignored.
    """
    labels, layouts = inferred(observed(df, text))
    words = frozenset(labels)
    known = common_hashes(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, speakers, says = [], [], []
            for k, t, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), junk(b.column(2).to_pylist(), known)):
                own = turns(t, words, layouts, with_text) if not bad else None
                if own:
                    keys.append(k)
                    speakers.append([s for s, _ in own])
                    says.append([x for _, x in own] if with_text else [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(speakers, pa.list_(pa.string())), pa.array(says, pa.list_(pa.string()))], names=["id", "speakers", "says"])

    speech = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), spoken(F.col(text)).alias("spoken"))
    rows = distinct_rows(map_batches(speech, run, "id string, speakers array<string>, says array<string>"), "id")
    if with_text:
        return rows.select("id", F.posexplode(F.arrays_zip("speakers", "says"))).select("id", (F.col("pos") + 1).cast("bigint").alias("turn_no"), F.col("col.speakers").alias("speaker"), F.col("col.says").alias("text"))
    return rows.select("id", F.posexplode("speakers").alias("pos", "speaker")).select("id", (F.col("pos") + 1).cast("bigint").alias("turn_no"), "speaker")
