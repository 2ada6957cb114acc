"""Sources and sinks: multiline CSV of transcripts, Parquet parts, and the small files beside them.

Places are named by text, a plain path or a URI such as ``hdfs://host/a`` or ``s3a://bucket/a``. Tables and small files go through
the same Hadoop file system, so a run may lie wherever the cluster can write.
"""

from __future__ import annotations

import hashlib
import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.session import small

KNOWN = ("id", "telegram_user_internal_id", "telegram_user_id", "created_at", "file_name", "transcription_text")
REQUIRED = ("created_at", "transcription_text")
FINGERPRINT_BYTES = 8 * 1024 * 1024
MAX_PARTITIONS = 1_000_000  # a row a partition is broadcast when rows are numbered
ONE_FILE_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A CSV with header, quoted line ends and doubled quotes; every column is text. ``max_rows`` keeps the first rows in file order.

    A multiline CSV file is one task; ``stage_csv`` turns it into Parquet once, after which everything is parallel.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    df = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return first_rows(df, max_rows)


def first_rows(df: DataFrame, max_rows: int | None) -> DataFrame:
    """The first rows in the order of the source, all for None; rows are numbered by offsets of the partitions, not in one task."""
    if max_rows is None:
        return df
    return with_row_number(df).filter(F.col("source_row_number") <= max_rows).drop("source_row_number") if max_rows > 0 else df.limit(0)


def with_row_number(df: DataFrame) -> DataFrame:
    """Adds ``source_row_number``, 1-based in file order, from per-partition counts and offsets."""
    placed = df.withColumn("_mid", F.monotonically_increasing_id())
    parts = placed.groupBy(F.shiftright("_mid", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    offsets = parts.select("_p", before.alias("_before"))
    return placed.withColumn("_p", F.shiftright("_mid", 33)).join(small(offsets, MAX_PARTITIONS), "_p").withColumn("source_row_number", F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_mid", "_before")


def logical_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV, reading its first column only; 0 without columns."""
    df = read_csv(spark, path)
    return df.select(df.columns[0]).count() if df.columns else 0


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def stage(df: DataFrame, to: str) -> int:
    """Transcripts to Parquet without features; the number of rows written. An empty table writes nothing."""
    if require_columns(df).isEmpty():
        return 0
    write_parts(df, to)
    return df.sparkSession.read.parquet(to).count()


def stage_csv(spark: SparkSession, path: str, to: str) -> int:
    return stage(read_csv(spark, path), to)


def write_parts(df: DataFrame, to: str, rows_a_file: int | None = None) -> None:
    """zstd Parquet, at most ``rows_a_file`` rows in a file if given."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(to)


def write_both(df: DataFrame, to: str, order: list[str] | None = None) -> None:
    """An aggregate as ``to``.parquet and ``to``.csv, in the order of the given columns (by default all before the first number).

    It is computed once; what was written is read back for the CSV, which is one file up to ``ONE_FILE_ROWS`` rows.
    """
    spark = df.sparkSession
    plain = [c for c, t in df.dtypes if t in ("string", "timestamp_ntz", "timestamp", "date")]
    df.orderBy(*(order or plain or df.columns[:1])).write.mode("overwrite").option("compression", "zstd").parquet(f"{to}.parquet")
    done = spark.read.schema(df.schema).parquet(f"{to}.parquet")
    flat = done.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in done.dtypes])
    if done.count() <= ONE_FILE_ROWS:
        flat = flat.coalesce(1)
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{to}.csv")


def write_merged(df: DataFrame, to: str, n_rows: int, cap: int = 200_000) -> bool:
    """One file of all rows if there are at most ``cap``; ``df`` is a stored table, so only the copy is one task."""
    if n_rows > cap:
        return False
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return True


def write_jsonl(df: DataFrame, to: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(to)


def join(base: str, *names: str) -> str:
    return "/".join([str(base).rstrip("/") or "/", *names])


def _hadoop(path: str):
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    at, fs = _hadoop(path)
    return fs.exists(at)


def is_folder(path: str) -> bool:
    at, fs = _hadoop(path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def write_text(path: str, text: str) -> None:
    """A small file, written by the driver; folders above it are made."""
    at, fs = _hadoop(path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str) -> str:
    """A small file as text, without a byte order mark."""
    return bytes(_bytes(path)).decode("utf-8-sig")


def _bytes(path: str, limit: int | None = None) -> bytes:
    at, fs = _hadoop(path)
    n = fs.getFileStatus(at).getLen() if limit is None else min(limit, fs.getFileStatus(at).getLen())
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(int(n)))
    finally:
        stream.close()


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def fingerprint(path: str) -> dict:
    """Path, size and SHA-256 of the first 8 MiB; None for what cannot be read. A folder has a size only."""
    try:
        if is_folder(path):
            at, fs = _hadoop(path)
            return {"path": str(path), "size_bytes": fs.getContentSummary(at).getLength(), "sha256_first_8mib": None}
        at, fs = _hadoop(path)
        return {"path": str(path), "size_bytes": fs.getFileStatus(at).getLen(), "sha256_first_8mib": hashlib.sha256(_bytes(path, FINGERPRINT_BYTES)).hexdigest()}
    except Py4JJavaError:
        return {"path": str(path), "size_bytes": None, "sha256_first_8mib": None}


def resolve_csv(explicit: str | None, folder: str = ".") -> str:
    """The given path, else the only ``*.csv`` of the folder; FileNotFoundError for none, ValueError for several."""
    if explicit:
        if not exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    at, fs = _hadoop(join(folder, "*.csv"))
    found = sorted(join(folder, x.getPath().getName()) for x in fs.globStatus(at) or [] if not x.isDirectory())
    if not found:
        raise FileNotFoundError(f"no CSV in {folder}")
    if len(found) > 1:
        raise ValueError(f"several CSV files in {folder}: {', '.join(p.rsplit('/', 1)[-1] for p in found)}")
    return found[0]


def read_source(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Transcripts from Parquet (a folder, or a name that ends in .parquet) or CSV; ``max_rows`` keeps the first rows."""
    if str(path).endswith(".parquet") or is_folder(path):
        return first_rows(spark.read.parquet(str(path)), max_rows)
    return read_csv(spark, str(path), max_rows)


def resolve_from_manifest(manifest: dict, folder: str = ".") -> str:
    """The input a run was made from: its path, or its name in the folder."""
    named = (manifest.get("input") or {}).get("path") or ""
    for path in (named, join(folder, named), join(folder, named.rsplit("/", 1)[-1])):
        if named and exists(path):
            return path
    raise FileNotFoundError(f"input of the run not found: {named or 'not named'}")


def run_folder(base: str, run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return join(base, run_id)


def packet_metadata(text: str) -> dict:
    """The JSON block under "## Packet Metadata" of a Markdown text; {} if there is none or it does not parse."""
    found = re.search(r"## Packet Metadata\s+```json\s*(.*?)\s*```", text, re.S)
    try:
        value = json.loads(found.group(1)) if found else {}
    except json.JSONDecodeError:
        return {}
    return value if isinstance(value, dict) else {}
