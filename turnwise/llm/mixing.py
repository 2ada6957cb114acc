"""Mixing sources to target weights of tokens.

Method: hash-threshold histograms. Every document has a fixed pseudo-random number, the hash of its key. Tokens are summed
by source and hash bucket (before any shuffle, so a source with a third of all rows costs no more than another). From these
histograms each source's budget becomes a number of whole rounds and a threshold: documents below the threshold are used
once more. The bucket in which the threshold falls is refined by the next bits of the hash, and only its documents are
summed again, until the threshold lies between two documents. Documents are then filtered by their hash; nothing is sorted.
Budgets are nested: a larger budget uses every document a smaller one uses.

A source's budget is its weight times the total; the total is ``total_tokens`` or, by default, all tokens of the listed
sources. A source whose documents, each used ``max_repeats`` times, do not suffice falls short and is reported so. The
document at the threshold is not used, so no source exceeds its budget. Documents without a source, of unlisted sources or
with no tokens are not used. Ties in the hash stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.tokens import TOKENIZER, token_counts
from turnwise.session import stash

BITS = 12
LEVELS = 5  # 5 x 12 = 60 bits of the hash
MAX_SOURCES = 10_000


def _bucket(level: int):
    return F.shiftright("_h", 60 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, n_tokens, _h) of each document with a source and tokens, as a table that is read again cheaply."""
    counted = token_counts(df.filter(F.col(source).isNotNull()), [key, source], text, tokenizer).filter("n_tokens > 0")
    return stash(counted.withColumn("_h", F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 60) - 1))), "sized")


def _sums(docs: DataFrame, source: str) -> dict[str, int]:
    return {r[0]: r[1] for r in docs.groupBy(source).agg(F.sum("n_tokens")).collect()}


def _edges(docs: DataFrame, open_: list[dict], source: str, level: int) -> dict[str, tuple[int | None, int]]:
    """Of each open source: the bucket of this level in which its rest runs out (None if it does not), and the tokens below it.

    The histogram is summed up where it lies (at most ``2 ** BITS`` rows a source); a row a source comes back.
    """
    width = 1 << (60 - BITS * level)
    state = docs.sparkSession.createDataFrame([(p["source"], p["below"], p["below"] + width, p["rest"]) for p in open_], "_s string, _from bigint, _to bigint, _rest bigint")
    inside = docs.join(F.broadcast(state), (F.col(source) == F.col("_s")) & (F.col("_h") >= F.col("_from")) & (F.col("_h") < F.col("_to")))
    counts = inside.groupBy("_s", "_rest", _bucket(level).alias("_b")).agg(F.sum("n_tokens").alias("_n"))
    summed = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.col("_upto") > F.col("_rest")
    found = summed.groupBy("_s").agg(F.min(F.when(over, F.col("_b"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("_upto"))), F.lit(0)).alias("under")).collect()
    return {r["_s"]: (r["edge"], r["under"]) for r in found}


def thresholds(docs: DataFrame, targets: DataFrame, source: str = "source", total_tokens: int | None = None) -> list[dict]:
    """Per target source: rounds, threshold, budget and what there is. A row a source reaches the driver at each level."""
    wanted = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    plan = {r["source"]: {"source": r["source"], "weight": float(r["weight"] or 0), "max_repeats": max(0, r["max_repeats"] or 0)} for r in wanted if r["source"] is not None}
    names = docs.sparkSession.createDataFrame([(name,) for name in plan], "_s string")
    own = docs.join(F.broadcast(names), F.col(source) == F.col("_s"), "left_semi")
    available = _sums(own, source)
    for name, p in plan.items():
        p["available"] = available.get(name, 0)
    total = total_tokens if total_tokens is not None else sum(p["available"] for p in plan.values())
    open_ = []
    for p in plan.values():
        p["budget"] = int(p["weight"] * total)
        rounds = p["budget"] // p["available"] if p["available"] else 0
        p["rounds"], p["below"] = min(rounds, p["max_repeats"]), 0
        if p["available"] and rounds < p["max_repeats"]:
            p["rest"] = p["budget"] - rounds * p["available"]
            open_.append(p)
    for level in range(LEVELS):
        if not open_:
            break
        width = 1 << (60 - BITS * (level + 1))
        found = _edges(own, open_, source, level)
        still = []
        for p in open_:
            edge, under = found.get(p["source"], (None, 0))
            p["rest"] -= under
            p["below"] += (edge if edge is not None else 1 << BITS) * width
            if edge is not None:
                still.append(p)
        open_ = still
    return list(plan.values())


PLAN = "source string, weight double, max_repeats int, available bigint, budget bigint, rounds bigint, below bigint"


def _plan_rows(docs: DataFrame, targets: DataFrame, source: str, total_tokens: int | None) -> DataFrame:
    """The plan as a table of at most ``MAX_SOURCES`` rows. The jobs that find it run when this is called."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    return docs.sparkSession.createDataFrame([tuple(p[n] for n in names) for p in thresholds(docs, targets, source, total_tokens)], PLAN)


def _chosen(docs: DataFrame, plan: DataFrame, key: str, source: str) -> DataFrame:
    joined = docs.join(F.broadcast(plan.select(F.col("source").alias(source), "rounds", "below")), source)
    copies = F.col("rounds") + F.when(F.col("_h") < F.col("below"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).filter("copies > 0").select(key, source, "n_tokens", "copies")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", total_tokens: int | None = None) -> DataFrame:
    """(key, source, n_tokens, copies): the documents used and how often each is; ``docs`` comes from ``sized``."""
    return _chosen(docs, _plan_rows(docs, targets, source, total_tokens), key, source)


def mix_report(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", total_tokens: int | None = None) -> DataFrame:
    """Per target source: weight, budget, tokens available and used, documents used, most copies, the share of all used tokens reached, the share of the
    total asked for (below the weight only if it fell short) and whether it fell short."""
    plan = _plan_rows(docs, targets, source, total_tokens)
    used = _chosen(docs, plan, key, source).groupBy(F.col(source).alias("source")).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies")
    )
    joined = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    sums = joined.groupBy().agg(F.sum("used_tokens"), F.sum("available")).first()
    total, wanted = sums[0] or 0, (total_tokens if total_tokens is not None else sums[1]) or 0
    return joined.select(
        "source", "weight", "max_repeats", "available", "budget", "used_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("used_tokens") / F.lit(float(total)) if total else F.lit(0.0)).alias("share"), (F.col("used_tokens") / F.lit(float(wanted)) if wanted else F.lit(0.0)).alias("share_of_budget"),
        (F.col("available") * F.col("max_repeats") < F.col("budget")).alias("short"),
    )
