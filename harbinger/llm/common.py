"""Helpers that several of the text operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.session import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let at most ``rows`` texts go to Python at a time.  Spark's own limit is meant for short rows;
    with whole documents the batches of all tasks would fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder, smaller than a checkpoint and as safe."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, folds: int, kept: int) -> Column:
    """True where crc32 of the key as text leaves ``kept`` (a null key counts as empty text)."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == kept


def lowered_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes, A-Z lowered: just what bytes do by default."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no input column has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_fields(df: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """Add the fields of a struct column.  An input column of the same name gives way."""
    held = free_name(df, "_result")
    taken = {f.lower() for f in fields}
    carried = [c for c in df.columns if c.lower() not in taken]
    return df.withColumn(held, result).select(
        *[F.col(f"`{c}`") for c in carried], *[F.col(held).getField(f).alias(f) for f in fields]
    )
