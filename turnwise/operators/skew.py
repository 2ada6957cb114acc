"""Per-key results over tables in which a few keys hold most rows.

Method: exact offset chunking. Rows are placed by (key, order columns) so that a heavy key spans many partitions,
keys are counted per partition, prefix sums over those counts give each (partition, key) run its offset, offset plus
position numbers every row within its key, and rows are processed in key chunks of equal size. Each chunk leaves one
small ordered state (its first and last row and what lies between); states of a key are merged in chunk order.
No task ever sees more than one chunk of a key at a time, whatever share of the rows the key holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.dates import parse_created_at
from turnwise.session import stash

CHUNK_ROWS = 50_000
POSITION = (1 << 33) - 1  # monotonically_increasing_id keeps the row's position in its partition in the low 33 bits


def number_rows(df: DataFrame, key: str, order: list[str], chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` with ``_rank`` (0-based place within the key) and ``_chunk``; and the counts per key (key, ``n``).

    ``key`` must not be null (fold nulls into a value first). Ties in ``order`` get distinct ranks and, broken at random, also
    spread over partitions, so a value that many rows of a key share is no hot spot either. Extra columns of
    ``df`` pass through; names starting with ``_`` are reserved. An empty table gives two empty tables.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stash(
        df.withColumn("_tie", F.rand(11)).repartitionByRange(n, key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie").withColumn("_mid", F.monotonically_increasing_id()),
        "placed",
    ).withColumns({"_part": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit(POSITION))})
    runs = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_start"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.col("_offset") + F.col("_pos") - F.col("_start")
    numbered = placed.join(runs, [key, "_part"]).withColumn("_rank", rank).withColumn("_chunk", F.floor(F.col("_rank") / chunk_rows))
    return numbered.drop("_mid", "_part", "_pos", "_n", "_start", "_offset"), runs.groupBy(key).agg(F.sum("_n").alias("n"))


def user_activity(df: DataFrame, user: str = "telegram_user_internal_id", gap_seconds: int = 6 * 3600, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per user: rows, transcripts, first and last time, sessions and the longest pause, in order of ``created_at``.

    Columns: user, ``n_rows``, ``n_transcripts`` (rows of one id and time counted once), ``first_at``, ``last_at``,
    ``n_sessions`` (runs of rows without a pause over ``gap_seconds``; 0 if no row has a time), ``max_pause_s``.
    Null and blank users form one group, reported under a null user. Rows with a null or malformed time count
    as rows and transcripts but not in times, sessions and pauses. Repeated rows count as rows. Extra columns are ignored.
    """
    rows = df.select(
        F.when(F.trim(user) == "", "").otherwise(F.coalesce(F.col(user), F.lit(""))).alias("_user"),
        F.unix_timestamp(parse_created_at(F.col("created_at")).cast("timestamp")).alias("_at"),
        F.coalesce(F.col("id"), F.lit("")).alias("_id"),
    )
    numbered, _ = number_rows(rows, "_user", ["_at", "_id"], chunk_rows)
    inside = Window.partitionBy("_user", "_chunk").orderBy("_rank")
    pause = F.col("_at") - F.lag("_at").over(inside)
    same = (F.lag("_id").over(inside) == F.col("_id")) & F.lag("_at").over(inside).eqNullSafe(F.col("_at"))
    states = (
        numbered.withColumns({"_pause": pause, "_same": same})
        .groupBy("_user", "_chunk")
        .agg(
            F.count("*").alias("n"),
            F.count_if("_same").alias("same"),
            F.count_if(F.col("_pause") > gap_seconds).alias("gaps"),
            F.max("_pause").alias("pause"),
            F.min_by(F.struct("_at", "_id"), "_rank").alias("head"),
            F.max_by(F.struct("_at", "_id"), "_rank").alias("tail"),
            F.min("_at").alias("lo"),
            F.max("_at").alias("hi"),
        )
    )
    return _merge_states(states, gap_seconds).select(
        F.when(F.col("_user") != "", F.col("_user")).alias(user),
        "n_rows",
        "n_transcripts",
        F.timestamp_seconds("lo").cast("timestamp_ntz").alias("first_at"),
        F.timestamp_seconds("hi").cast("timestamp_ntz").alias("last_at"),
        "n_sessions",
        "max_pause_s",
    )


def _merge_states(states: DataFrame, gap_seconds: int) -> DataFrame:
    """Folds the ordered chunk states of each user; the boundary between two chunks counts like any pair of neighbours."""
    chunks = Window.partitionBy("_user").orderBy("_chunk")
    before = F.lag("tail").over(chunks)
    edge = F.col("head._at") - before["_at"]
    same = (before["_id"] == F.col("head._id")) & before["_at"].eqNullSafe(F.col("head._at"))
    return (
        states.withColumns({"_edge": edge, "_edge_same": same})
        .groupBy("_user")
        .agg(
            F.sum("n").alias("n_rows"),
            (F.sum("n") - F.sum("same") - F.count_if("_edge_same")).alias("n_transcripts"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.when(F.max("hi").isNull(), F.lit(0)).otherwise(F.sum("gaps") + F.count_if(F.col("_edge") > gap_seconds) + 1).cast("bigint").alias("n_sessions"),
            F.greatest(F.max("pause"), F.max("_edge")).alias("max_pause_s"),
        )
    )


def heavy_users(df: DataFrame, user: str = "telegram_user_internal_id", share: float = 0.02) -> DataFrame:
    """Users, not null or blank, that hold at least ``share`` of all rows (rows without a user count in the total)."""
    activity = stash(user_activity(df, user).select(user, "n_rows"), "activity")
    total = activity.agg(F.sum("n_rows")).first()[0] or 0
    return activity.filter(F.col(user).isNotNull() & (F.col("n_rows") >= share * total)).select(user)


STEPS = 4096  # steps an octave of the coarse places of values


def _coarse(x):
    """A whole number that never falls as ``x`` grows, the same for values within 1/4096 of an octave; null for null, infinity beside the largest."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1024.0)) * STEPS).cast("bigint") + F.lit(2000 * STEPS)
    return F.when(x > 0, size).when(x < 0, -size).when(x == 0, F.lit(0))


def _between(low, high, part):
    """The point ``part`` of the way from ``low`` to ``high``, in the arithmetic of DuckDB's ``quantile_cont``: low * (1 - part) is added
    without being rounded first. Numbers of few places often end up on a tie of the next one, where the last bit tells."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(low.isNotNull() & (part > 0), fused).otherwise(low)


def ranked_quantiles(df: DataFrame, keys: list[str], metrics: list[str], at: tuple[float, ...] = (0.5, 0.25, 0.75), nan_last: bool = False) -> DataFrame:
    """(keys, metric, n_rows, q_0, q_1, ...): exact quantiles with linear interpolation, whatever share of the rows a group holds.

    Equal values of a group are counted before and after the shuffle, so what moves on are distinct values, spread by group and
    value. Their counts are summed by coarse places (a bounded number a group), prefix sums of these say in which places the
    wanted ranks lie, and only values of those places are numbered. A percentile aggregate would gather all distinct values of a
    group in one task instead. Nulls and NaN are ignored (with ``nan_last`` NaN is the largest value); a null key is a group; a metric
    without values has null quantiles. Zeros of a group that are all negative stay so, among others they count as 0.0.
    ``n_rows`` counts all rows of the group. An empty table gives none.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    x = F.col("m.x") if nan_last else F.when(~F.isnan("m.x"), F.col("m.x"))
    minus = F.when(x == 0, F.pow(x, F.lit(-1.0)) < 0)  # only the reciprocal tells -0.0 from 0.0
    long = df.select(*keys, F.explode(entries).alias("m")).select(*keys, "m.metric", (x + 0.0).alias("x"), minus.alias("_minus"))
    group = [*keys, "metric"]
    counts = long.groupBy(*group, "x").agg(F.count("*").alias("_n"), F.every("_minus").alias("_minus")).withColumn("_b", _coarse(F.col("x")))
    places = counts.groupBy(*group, "_b").agg(F.sum("_n").alias("_n_b"))
    whole = Window.partitionBy(*group)
    valued = F.when(F.col("_b").isNotNull(), F.col("_n_b")).otherwise(0)
    upto = F.sum(valued).over(whole.orderBy(F.asc_nulls_first("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = places.withColumns({"_before": upto - valued, "_total": F.sum(valued).over(whole), "n_rows": F.sum("_n_b").over(whole)})
    ranks = [((F.col("_total") - 1) * F.lit(float(q))) for q in at]

    def holds(low, high):
        return [(low <= r) & (r <= high) for p in ranks for r in (F.floor(p), F.ceil(p))]

    def any_of(conditions):
        out = conditions[0]
        for c in conditions[1:]:
            out = out | c
        return out

    last = F.col("_before") + F.col("_n_b") - 1
    # a group without values keeps its place of nulls, so that it is reported
    wanted = summed.filter((F.col("_total") == 0) | F.col("_b").isNotNull() & any_of(holds(F.col("_before"), last))).drop("_n_b")
    named = wanted.withColumnsRenamed({c: f"_w_{c}" for c in (*group, "_b")})
    inside = counts.join(named, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in (*group, "_b")]).drop(*[f"_w_{c}" for c in (*group, "_b")])
    run = F.sum("_n").over(Window.partitionBy(*group, "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = inside.withColumn("_hi", F.col("_before") + run - 1).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    kept = numbered.filter((F.col("_total") == 0) | any_of(holds(F.col("_lo"), F.col("_hi"))))
    ends = []
    for i, p in enumerate(ranks):
        at_rank = lambda r: F.max(F.when((F.col("_lo") <= r) & (r <= F.col("_hi")), F.when(F.col("_minus"), F.lit(-0.0)).otherwise(F.col("x"))))
        ends += [at_rank(F.floor(p)).alias(f"_lo{i}"), at_rank(F.ceil(p)).alias(f"_hi{i}"), F.max(p - F.floor(p)).alias(f"_f{i}")]
    found = kept.groupBy(*group).agg(F.max("n_rows").alias("n_rows"), *ends)
    return found.select(*group, "n_rows", *[_between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")).alias(f"q_{i}") for i in range(len(at))])
