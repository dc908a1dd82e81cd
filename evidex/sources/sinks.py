"""Sinks: JSON lines under a privacy ceiling, audit rows, insert-once tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import joined_hash
from evidex.operators.relational import conflicts, insert_once


def export_jsonl(df: DataFrame, path: str, ceiling: int = 1) -> None:
    """Rows up to a privacy tier as JSON lines."""
    df.where(F.col("privacy_tier") <= ceiling).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def audit_row(df: DataFrame, source: str, *parts: str) -> DataFrame:
    """One row: source, rows and a signature over the hashes of all rows, independent of their order."""
    h = F.conv(F.substring(joined_hash(*(F.col(p) for p in parts)), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("s")).select(F.lit(source).alias("source"), "rows", F.sha2(F.concat_ws("|", F.lit(source), "rows", "s"), 256).alias("signature"))


def input_signature(*parts: str) -> str:
    """SHA-256 over an importer's input identifiers (paths, hashes), separated by NUL."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def refresh(df: DataFrame, path: str) -> DataFrame:
    """A materialized view: df recomputed, written over what was at path, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_once(rows: DataFrame, path: str, keys: list[str], digest: str | None = None) -> None:
    """Append the rows whose key the table at path lacks. Raises if a key comes with another content hash."""
    spark = rows.sparkSession
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(path)
    if not home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        rows.dropDuplicates(keys).write.parquet(path)
        return
    existing = spark.read.parquet(path)
    if digest and not (bad := conflicts(existing, rows, keys, digest)).isEmpty():
        raise ValueError(f"content differs under the same key: {bad.first()}")
    insert_once(existing, rows, keys).write.mode("append").parquet(path)


def report_markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A Markdown table of at most so many rows of a small result."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows) + "\n"
