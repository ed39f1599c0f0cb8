"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a key from a hash of its id and text: the order within a
source is random but the same on each run. A source's key space is cut into
equal ranges, as many as the table needs for RANGE_ROWS rows each; the hash spreads
rows evenly over them, so each range sorts in a task of its own however large
its source. Sums of the ranges, added up in order, give every range its offset,
and the sum within the range gives every document its exact prefix sum. No task
needs a whole source.

Targets: sources by code point, null last, weigh WEIGHTS repeating, and share
`share` of all sizes; no target exceeds `most` times its source's size, and the
excess goes to the others by weight until none is above. A source takes whole
epochs of itself, then a prefix of the order, cut at the exact word: `mix` gives
the words that are taken of the document that the cut goes through. `mixed`, which
returns rows, takes that document whole or not at all, whichever is nearer.

Defined results: a null text has size 0 and takes 0. A null source is a source
of its own, last in order. Repeated rows count each time; rows that agree in id
and text have one key and are interchangeable, and in `mixed` those at a cut are
taken together. A source without words has target 0. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, numbered

#: Repeating weights of the sources in order.
WEIGHTS = (5, 2, 1)
#: Rows of a key range, about, if all were of one source.
RANGE_ROWS = 10_000
SEED = "mix-1"


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The random key of a document, 32 hexadecimal digits that its id and text decide."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and key."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source and source_size to those and target.

    With sources ordered by the fill level at which they reach their cap
    (cap / weight), the first r of them are capped and the others share what
    is left by weight; r is the first where the next source stays below its
    cap. This is where dealing the excess out again and again ends.
    """
    null_last = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(*null_last)) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * most).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), *null_last)
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    led = caps.withColumns(
        {
            "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
            "w_all": F.sum("w").over(whole),
            "pool": F.sum("source_size").over(whole) * share,
        }
    )
    level = (F.col("pool") - F.col("capped_before")) / (F.col("w_all") - F.col("w_before"))
    led = led.withColumn("level", level).withColumn("free", F.col("w") * F.col("level") < F.col("cap"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True)
    led = led.withColumn("fill", first.over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return led.select("source", "source_size", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("fill"))).alias("target"))


def _placed(docs: DataFrame, scratch: Scratch, rows_a_range: int, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """Rows with words: doc_id, size, key, source, source_size, target, epochs and part (words of the last epoch); and rows without, which take none."""
    rows = scratch.cut(sized(docs, seed))  # narrow; else the texts would be read and counted twice
    n = rows.where("size > 0").agg(F.count(F.lit(1))).first()[0]
    buckets = 1 + n // rows_a_range
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * min(buckets, 1 << 20), 32).cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("size") > 0, bucket).otherwise(-1))
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    totals = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    totals = totals.withColumn("epochs", epochs).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).join(totals, F.col("source").eqNullSafe(F.col("t_source")))
    offsets = scratch.cut(offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset", "source_size", "target", "epochs", "budget"))
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    worded = rows.where("size > 0").withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    empty = rows.where("size = 0").withColumn("ahead", F.lit(0).cast("long"))
    all_ = worded.unionByName(empty).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("offset") - F.col("ahead")))
    return all_.select("doc_id", "size", "key", "source", "source_size", "target", "epochs", part.cast("long").alias("part"))


def mix(docs: DataFrame, rows_a_range: int = RANGE_ROWS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """Every row's part in the mix: doc_id, size, source_size, target, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = _placed(docs, scratch, rows_a_range, weights, share, most, seed)
    return scratch.result(rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("part")).cast("long").alias("taken")))


def mixed(docs: DataFrame, rows_a_range: int = RANGE_ROWS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """The rows of the mix, each as many times as it is taken; documents without words stay as they are.

    Texts stay whole: the one that a source's cut goes through is taken if at
    least half of it is. A row's count follows from its source's epochs and from
    its key, held against the key at the cut, so rows meet a table of a line a
    source and don't move.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    placed = _placed(docs, scratch, rows_a_range, weights, share, most, seed)
    last = F.max(F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), F.col("key")))
    cuts = scratch.cut(placed.groupBy(F.col("source").alias("cut_source")).agg(F.max("epochs").alias("epochs"), last.alias("last")))
    rows, named = numbered(docs)
    worded = F.coalesce(F.regexp_count(named["text"], F.lit(WORD)), F.lit(0)) > 0
    whole = F.col("epochs") + F.coalesce((key_of(named["doc_id"], named["text"], seed) <= F.col("last")).cast("long"), F.lit(0))
    times = F.when(worded, whole).otherwise(1).cast("int")
    out = rows.join(cuts, named["source"].eqNullSafe(F.col("cut_source"))).withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return scratch.result(out.select(*rows.columns).toDF(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
caps AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, ([5, 2, 1])[(place % 3 + 1)::INT]::DOUBLE AS w FROM placed),
filled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS turn
  FROM caps WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill AS (SELECT arg_min(level, turn) AS level FROM filled WHERE w * level < cap),
targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM fill) IS NULL THEN cap ELSE least(cap, w * (SELECT level FROM fill)) END AS target FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sized)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * b.epochs + greatest(0, least(s.size, floor(b.target) - b.epochs * b.source_size - s.ahead)))::BIGINT AS taken
FROM summed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
"""
