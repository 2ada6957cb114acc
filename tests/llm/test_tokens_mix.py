import random
from pathlib import Path

import pytest
import tiktoken
from pyspark.sql import functions as F

from turnwise.llm import mixing, tokens


VOCABULARY = Path(tokens.TOKENIZER).read_bytes()


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(VOCABULARY), special_tokens={})


def test_ids_equal_the_public_library(spark, public):
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "a", "b", "é", "1", "!", "'s", "  ", " ", "я", "𝕏", "\r\n", "<|endoftext|>", "aaaa", "​", "x" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [None, "", " ", "  ", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (public.encode_ordinary(t) if t else []), repr(t)


def test_long_runs_of_one_letter(public):
    e = tokens.Encoder(VOCABULARY)
    text = "a" * 20_000 + " " * 5_000 + "b"
    n, flat = e.encode([text])
    assert public.decode([int(x) for x in flat]) == text and n[0] == len(public.encode_ordinary(text))


def test_batches_of_long_texts_are_taken_in_parts(public, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 500)
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    texts = [" ".join(f"w{i}x{k}" for k in range(i % 40)) for i in range(120)] + [None, ""]
    e = tokens.Encoder(VOCABULARY)
    n, flat = e.encode(texts)
    ends = n.cumsum()
    assert [flat[b - a : b].tolist() for a, b in zip(n, ends)] == [public.encode_ordinary(t) if t else [] for t in texts]
    assert len(e.codes) < 200


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    return df.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 60) - 1)))


def test_mix_reaches_budgets_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else rng.choice(["mid", "tiny", None, "other"]) if i % 9 else "mid", rng.randint(1, 50)) for i in range(4000)]
    docs = _docs(spark, rows)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 2), ("absent", 0.05, 3)], "source string, weight double, max_repeats int")
    have = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "mid", "tiny", "absent")}
    total = sum(have.values())
    used = mixing.mix(docs, targets).collect()
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    caps = {"big": 1, "mid": 2, "tiny": 2, "absent": 3}
    weight = {"big": 0.5, "mid": 0.3, "tiny": 0.15, "absent": 0.05}
    for s in caps:
        own = [r for r in used if r["source"] == s]
        spent = sum(r["n_tokens"] * r["copies"] for r in own)
        budget = int(weight[s] * total)
        assert spent == report[s]["used_tokens"] <= budget
        assert all(1 <= r["copies"] <= caps[s] for r in own)
        reach = min(budget, have[s] * caps[s])
        assert reach - spent <= 50, s  # less than one document is missing
        assert report[s]["short"] == (have[s] * caps[s] < budget)
    assert abs(sum(r["share"] for r in report.values()) - 1) < 1e-9


def test_budgets_are_nested_and_empty_input_works(spark):
    docs = _docs(spark, [(i, "a", 10) for i in range(500)])
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, weight double, max_repeats int")
    copies = [{r["doc_id"]: r["copies"] for r in mixing.mix(docs, targets, total_tokens=t).collect()} for t in (0, 9, 2000, 5000, 7000, 99999)]
    assert [sum(c.values()) * 10 for c in copies] == [0, 0, 2000, 5000, 7000, 15000]
    for a, b in zip(copies, copies[1:]):
        assert all(b.get(k, 0) >= v for k, v in a.items())
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix_report(docs.limit(0), targets).first()["used_tokens"] == 0
