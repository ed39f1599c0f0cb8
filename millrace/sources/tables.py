"""Reading and writing tables: Parquet, raw column files and logs in sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a value, and the SQL that turns its hexadecimal digits, most significant first, into a number.
_WIDTHS = {"int32": 4, "uint32": 4, "int64": 8, "uint64": 8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_column(spark: SparkSession, path: str, kind: str, name: str = "value") -> DataFrame:
    """A file of little-endian numbers without header, as row index and value.

    Each file is one row of binaryFile, so it must fit in a task; a column of
    any size is a folder of such files, numbered in the order of their names.
    uint64 becomes decimal(20,0).
    """
    width = _WIDTHS[kind]
    files = spark.read.format("binaryFile").load(path).select("path", F.hex("content").alias("h"))
    chunks = F.expr(f"transform(sequence(1L, length(h) div {2 * width}), i -> substr(h, int((i - 1) * {2 * width} + 1), {2 * width}))")
    rows = files.where(f"length(h) >= {2 * width}").select("path", F.posexplode(chunks).alias("i", "le"))
    digits = F.concat(*[F.substring("le", 2 * b + 1, 2) for b in reversed(range(width))])
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if kind == "int32":
        value = F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")
    elif kind == "int64":
        value = F.when(value >= F.lit(str(2**63)).cast("decimal(20,0)"), value - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(value).cast("long")
    elif kind == "uint32":
        value = value.cast("long")
    return rows.select("path", "i", value.alias(name))


def write_column(df: DataFrame, column: str, path: str) -> None:
    """A column as Parquet, the engine's own form of a column at rest."""
    df.select(column).write.mode("overwrite").parquet(path)


def log_sections(lines: DataFrame, mark: str = "@@@") -> DataFrame:
    """section, line_no and text of a log's lines (log, line_no, text); a marker line opens a section. A log is sorted as a whole, as its sections are."""
    from pyspark.sql import Window

    opens = F.col("text").startswith(mark)
    w = Window.partitionBy("log").orderBy("line_no")
    named = lines.withColumn("section", F.last(F.when(opens, F.trim(F.substring("text", len(mark) + 1, 2**30))), ignorenulls=True).over(w))
    return named.where(~opens & F.col("section").isNotNull()).select("log", "section", "line_no", "text")
