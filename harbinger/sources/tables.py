"""Reading and writing tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# suffix of a path -> Spark format
FORMATS = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
}


def format_of(path: str) -> str:
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown table suffix {suffix!r} in {path!r}; use one of {sorted(FORMATS)}")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               multi_line: bool = False) -> DataFrame:
    """Typed read chosen by the path suffix.

    CSV needs a schema: inferring one would scan the whole input twice.  CSV whose fields
    hold line breaks needs ``multi_line``; such a file cannot be split and is one task.
    """
    kind = format_of(path)
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        if schema is None:
            raise ValueError("give a schema for CSV input")
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.load(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer splits than there are cores, dealt out to all cores.

    For work that is heavy per row.  A table with enough splits is left alone, so large
    inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_optional_table(spark: SparkSession, path: str | None, schema: StructType | str | None = None,
                        multi_line: bool = False):
    """The table, or None where no path is configured or nothing lies there."""
    if path is None or str(path).lower() in {"", "none", "null"}:
        return None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return read_table(spark, path, schema, multi_line)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, one directory per table, partitioned by the given columns.

    Rows are first rebalanced by the partition columns: small directories share a
    writer, and one that holds a third of the rows has as many as its size asks for.
    """
    cols = partition_by or []
    out = df.hint("rebalance", *cols) if cols else df
    out.write.mode("overwrite").partitionBy(*cols).parquet(path)


def export_records(df: DataFrame, path: str) -> None:
    """Records as CSV or JSON lines, by suffix; any other suffix is an error."""
    kind = format_of(path)
    if kind == "parquet":
        raise ValueError("records are exported as .csv, .jsonl or .ndjson")
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def read_model_results(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame:
    """All models below ``root``, laid out as ``model=<name>/`` by ``write_table``.

    The model name comes from partition discovery, so a filter on ``model`` prunes
    directories.  No model at all is an error.
    """
    pattern = f"{root.rstrip('/')}/model=*"
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    if not glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob):
        raise FileNotFoundError(f"no model results below {root}")
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    out = reader.parquet(pattern)
    return out.withColumn("model", F.col("model").cast("string"))


def attach_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors keyed by ``(model, article_id)`` for the articles that were kept."""
    return vectors.join(articles.select("article_id"), "article_id", "left_semi")


def vectors_by_position(articles: DataFrame, vectors: DataFrame, position: str = "position") -> DataFrame:
    """Import of vectors that carry only the row position of the cleaned article table.

    The position is that of an article after cleaning, sorted by publication time and
    then ``ingest_pos``.  Positions are counted per publication day and shifted by the
    articles of earlier days, so only day totals go through a running sum.
    """
    day = F.to_date("pub").alias("_d")
    totals = articles.groupBy(day).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_d").orderBy("pub", "ingest_pos"))
    placed = (
        articles.select("article_id", "pub", "ingest_pos", day)
        .join(shift, "_d")
        .select("article_id", (F.col("_off") + rank - 1).alias(position))
    )
    return vectors.join(placed, position).drop(position)
