"""Global positions without a task that sees all rows.

Rows are dealt to ranges of key and ties, the rows of each range are numbered on
their own, and the ranges' sizes, added up in order, give each range its offset.
As the ties are part of a range's bounds, and a hash of the row after them, a key
that very many rows have is split. There are as many ranges as the session has
shuffle partitions, so they grow with what the session is set up for; only their
bounds and sizes, a row a range, meet in one place.

The bounds are quantiles of a sample of bounded size, chosen by hash, which a
first pass takes, as a range exchange does by itself. Here they are taken once and
for all, because rows are read twice, for the sizes and for the numbers, and two
exchanges need not choose the same bounds.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Rows of the sample for each range.
SAMPLE = 20


def _ranged(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """df (with _row, a hash of the row) and each row's _range: how many bounds are below it, looked up in two steps."""
    spark, row = df.sparkSession, F.struct(*by, "_row")
    picked = df.select(*by, "_row").orderBy(F.xxhash64("_row"), *by).limit(SAMPLE * n).orderBy(*by, "_row").collect()
    bounds = [tuple(picked[len(picked) * i // n]) for i in range(1, n)] if picked else []
    wide = isqrt(n) + 1
    fine = [bounds[i : i + wide] for i in range(0, len(bounds), wide)] or [[]]
    one = ArrayType(df.select(*by, "_row").schema)
    table = spark.createDataFrame([([f[-1] for f in fine[:-1]], fine)], StructType([StructField("_coarse", one), StructField("_fine", ArrayType(one))]))
    below = lambda c: F.size(F.filter(c, lambda b: b < row))
    out = df.join(F.broadcast(table)).withColumn("_chunk", below("_coarse"))  # one row, as many values as ranges
    return out.withColumn("_range", F.col("_chunk") * (wide + 1) + below(F.get("_fine", F.col("_chunk")))).drop("_coarse", "_fine", "_chunk")


def with_rank(df: DataFrame, key: str, *ties: str, name: str = "rank") -> DataFrame:
    """df with each row's position, from 0, in the order of key and ties; rows that agree in both are in any order."""
    by = [key, *ties]
    placed = _ranged(df.withColumn("_row", F.xxhash64(*df.columns)), by, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = placed.groupBy(F.col("_range").alias("_r2")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_r2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by, "_row")) - 1
    return placed.withColumn("_own", within).join(offsets, F.col("_range") == F.col("_r2")).withColumn(name, (F.col("_own") + F.col("_offset")).cast("long")).drop("_row", "_range", "_r2", "_own", "_offset")
