"""Percentiles of very large numeric columns with a guaranteed rank error, combinable across loads and days.

Method: q-digest over a bounded ordered universe, the 64-bit integers. Integers stand for themselves; floating-point numbers
are quantised by their bits, turned so that they keep their order, so negative, fractional and very large values are all
leaves. A digest is a set of nodes of the dyadic tree over the universe with counts: a node of level b covers the 2 ** b
leaves whose value shifted right by b is the node; level ``BITS`` has two nodes, the negative and the other numbers.
Compressing with factor k moves a node's count and its sibling's to their parent while parent, node and sibling together
hold at most n / k. Every inner node then holds at most n / k, so the count on the path above a leaf, which is all that is
uncertain about a rank, is at most BITS * n / k: a deterministic bound of ``error`` * n with k = BITS / error. Digests merge
by adding the counts of equal nodes and compressing again; the bound stays.

A digest is a table (``grp``, ``level``, ``node``, ``n``): level 0 is a leaf. Tasks build digests of their own rows and send
only nodes. Digests of a group are merged in two rounds: those of a share of the tasks first, then what is left, each round
compressing as it reads, so a group with a third of all rows costs one task no more than a bounded number of nodes at a
time. Null and NaN values are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.session import map_batches

BITS = 63
ERROR = 0.005
FLUSH = 2_000_000
FAN = 256  # shares of the tasks that the first round merges
NODES = "grp string, level int, node bigint, n bigint"
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def ordered(values: np.ndarray) -> np.ndarray:
    """Floating-point numbers as 64-bit integers in the same order; both zeros are one value."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def unordered(bits: np.ndarray) -> np.ndarray:
    """What ``ordered`` made of floating-point numbers turned back."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).astype(np.int64).view(np.float64)


def _summed(group: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups, nodes and counts of equal (group, node) pairs added, sorted; and of each given pair its place among them."""
    if not len(group):
        return group, node, n, np.zeros(0, np.int64)
    order = np.lexsort((node, group))
    g, v = group[order], node[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
    at = np.flatnonzero(new)
    place = np.empty(len(group), np.int64)
    place[order] = np.cumsum(new) - 1
    return g[at], v[at], np.add.reduceat(n[order], at), place


def _compress(group: np.ndarray, level: np.ndarray, node: np.ndarray, n: np.ndarray, k: float) -> tuple[np.ndarray, ...]:
    """Adds equal nodes and makes one bottom-up pass over the dyadic trees of all groups at once."""
    size = np.bincount(group, weights=n).astype(np.int64) if len(group) else np.zeros(0, np.int64)
    limit = np.floor(size / k).astype(np.int64)
    order = np.argsort(level, kind="stable")
    group, level, node, n = group[order], level[order], node[order], n[order]
    bounds = np.searchsorted(level, np.arange(BITS + 2))
    at = [(group[a:b], node[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:])]
    kept = []
    carry = (np.zeros(0, np.int64),) * 3
    for b in range(BITS):
        g, v, c, _ = _summed(*(np.concatenate((x, y)) for x, y in zip(at[b], carry)))
        carry = (np.zeros(0, np.int64),) * 3
        small = limit[g] > 0 if len(g) else np.zeros(0, bool)  # small groups keep exact leaves
        if small.any():
            ug, uv, uc = at[b + 1]
            near = np.isin(ug, g[small]) if len(ug) else np.zeros(0, bool)
            # of each parent: what it and its children hold
            _, _, pc, place = _summed(np.concatenate((g[small], ug[near])), np.concatenate((v[small] >> 1, uv[near])), np.concatenate((c[small], uc[near])))
            light = small.copy()
            light[small] = pc[place[: small.sum()]] <= limit[g[small]]
            carry = (g[light], v[light] >> 1, c[light])
            g, v, c = g[~light], v[~light], c[~light]
        kept.append((g, np.full(len(g), b), v, c))
    g, v, c, _ = _summed(*(np.concatenate((x, y)) for x, y in zip(at[BITS], carry)))
    kept.append((g, np.full(len(g), BITS), v, c))
    return tuple(np.concatenate(x) for x in zip(*kept))


class _Merger:
    """Digests of the rows of one task. What is held is compressed whenever it grows over ``FLUSH`` nodes."""

    def __init__(self, k: float, sorted_groups: bool) -> None:
        self.k, self.sorted = k, sorted_groups
        self.codes: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, names: pa.Array, level: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = names.dictionary_encode()
        local = np.array([self.codes.setdefault(x, len(self.codes)) for x in own.dictionary.to_pylist()], dtype=np.int64)
        self.held.append((local[own.indices.to_numpy(zero_copy_only=False)], level, node, n))
        self.count += len(node)
        if self.count > FLUSH:
            self._fold()
            if self.count > FLUSH // 2:  # many groups: all but the last are whole if groups come one after the other
                yield from self.emit(keep_last=self.sorted)

    def _fold(self) -> None:
        self.held = [_compress(*(np.concatenate(x) for x in zip(*self.held)), self.k)]
        self.count = len(self.held[0][0])

    def emit(self, keep_last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._fold()
        g, level, v, c = self.held[0]
        names = list(self.codes)
        last = len(names) - 1 if keep_last else -1
        out = g != last
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(g[out])), pa.array(level[out].astype(np.int32)), pa.array(v[out]), pa.array(c[out])], names=["grp", "level", "node", "n"])
        self.codes = {names[last]: 0} if keep_last else {}
        self.held = [(np.zeros((~out).sum(), np.int64), level[~out], v[~out], c[~out])] if keep_last else []
        self.count = int((~out).sum()) if keep_last else 0


def _compressed(nodes: DataFrame, error: float, sorted_groups: bool = False, task: bool = False) -> DataFrame:
    """Digests of each task's nodes; with ``task`` the share of the tasks they belong to stands beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _Merger(BITS / error, sorted_groups)
        share = TaskContext.get().partitionId() % FAN if task else None

        def marked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                yield b if share is None else b.append_column("share", pa.array(np.full(b.num_rows, share, np.int32)))

        for b in batches:
            if b.num_rows:
                yield from marked(m.add(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()))
        yield from marked(m.emit())

    return map_batches(nodes.select("grp", "level", "node", "n"), run, NODES + (", share int" if task else ""))


def build(df: DataFrame, value: str, group: str, error: float = ERROR) -> DataFrame:
    """Digests (grp, level, node, n) of the numeric column ``value`` per ``group``.

    Integers of up to 64 bits are leaves themselves; other numbers are read as double (``quantiles`` must then be told so).
    Rows with a null or NaN value are not counted; a null group is not reported. An empty table gives an empty digest.
    """
    whole = dict(df.dtypes)[value] in INTEGERS
    x = F.col(value).cast("bigint" if whole else "double")
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), x.alias("x"))
    if whole:
        leaves = rows.select("grp", F.lit(0).alias("level"), F.col("x").alias("node"), F.lit(1).cast("bigint").alias("n"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(n, np.int32)), pa.array(ordered(b.column(1).to_numpy())), pa.array(np.ones(n, np.int64))], names=["grp", "level", "node", "n"])

        leaves = map_batches(rows.filter(~F.isnan("x")), run, NODES)
    return _merged(_compressed(leaves, error, task=True), error)


def _merged(nodes: DataFrame, error: float) -> DataFrame:
    """One digest a group from the digests of tasks (with ``share``): first by group and share, then by group."""
    add = lambda df, *by: df.groupBy("grp", *by, "level", "node").agg(F.sum("n").alias("n"))
    by_share = _compressed(nodes.repartition("grp", "share").sortWithinPartitions("grp"), error, sorted_groups=True)
    return _compressed(add(by_share).repartition("grp").sortWithinPartitions("grp"), error, sorted_groups=True)


def merge(*digests: DataFrame, error: float = ERROR) -> DataFrame:
    """Adds the counts of equal nodes of several digests and compresses again."""
    every = digests[0]
    for d in digests[1:]:
        every = every.unionByName(d)
    return _merged(_compressed(every, error, task=True), error)


def regroup(digest: DataFrame, grp, error: float = ERROR) -> DataFrame:
    """Digests of coarser groups: nodes of each group count for the group named by the expression ``grp``."""
    return merge(digest.withColumn("grp", grp), error=error)


def quantiles(digest: DataFrame, at: tuple[float, ...], error: float = ERROR, floating: bool = False) -> DataFrame:
    """(grp, n, q, value, max_rank_error): for each q the value whose rank differs from q * n by at most ``max_rank_error``.

    ``floating`` says that the digest was built from numbers that are no integers; values then come out as double.
    """
    below = F.expr("CASE WHEN level = 0 THEN 0L ELSE shiftrightunsigned(-1L, 64 - level) END")
    ranked = digest.withColumn("hi", F.expr("shiftleft(node, level)").bitwiseOR(below))
    order = Window.partitionBy("grp").orderBy("hi", "level", "node").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp")
    steps = ranked.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    asked = steps.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).filter(F.col("upto") >= F.col("q") * F.col("total"))
    out = asked.groupBy("grp", "q").agg(F.max("total").alias("n"), F.min("hi").alias("value")).select("grp", "n", "q", "value", F.floor(F.col("n") * error).alias("max_rank_error"))
    if not floating:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(unordered(b.column(3).to_numpy())), b.column(4)], names=["grp", "n", "q", "value", "max_rank_error"])

    return map_batches(out, run, "grp string, n bigint, q double, value double, max_rank_error bigint")
