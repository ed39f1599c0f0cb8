"""Exact dedup: equal texts keep the row with the largest doc_id.

Three combining stages, each comparing whole texts and not digests alone:
1. local: every task merges the equal texts that it holds (the map side of
   stage 2), so that a text leaves a task as one row however often it is there;
2. salted: (digest, salt, text) groups merge across tasks. The salt of a text
   with more than HOT copies comes from the task, so that its rows meet in
   `salts` places; all others have a single salt, and are settled here;
3. global: the salt winners of the hot texts merge, whole texts compared. The
   others go through it as digests alone.
Which digests are hot is told by a count of digests before, so whole texts move
once, and only the few winners of hot texts twice. The hot digests are written
first, so that Spark knows their size and broadcasts them or not.
The verdicts go back to the documents by digest, again spread for the hot ones.

Different texts with one digest stay apart in every stage, since the text is a
key; on the way back a second hash tells them apart, and should two texts agree
in both, the query stops with an error.

Defined results: a null text counts as empty, and all empty texts are one
group. Rows that repeat a doc_id and its text are members of their group like
any other, so exact_dedup gives each of them kept = true if that doc_id is the
largest; deduplicate returns a single row of each group (of rows with the
largest doc_id that with the largest other columns, written as JSON). A
null doc_id loses to any other; a group of null ids alone has a null keep_id
and is kept. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, numbered, texts

#: Copies from which a text is spread, and places that it is spread over.
HOT, SALTS = 1000, 32


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hot_digests(digests: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """h_digest of the texts with more than `hot` copies, from a column `digest`. The count combines before it is shuffled."""
    return scratch.cut(digests.groupBy(F.col("digest").alias("h_digest")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h_digest"))


def salted(rows: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """rows with their salt: -1, or salt for those of a hot digest."""
    return rows.join(hot, F.col("digest") == F.col("h_digest"), "left").withColumn("salt", F.when(F.col("h_digest").isNotNull(), salt).otherwise(-1)).drop("h_digest")


def groups(docs: DataFrame, hot: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """One row for each text: digest, second (another hash), hot, keep_id, group_size."""
    rows = salted(texts(docs).withColumn("digest", digest(F.col("text"))), hot, F.pmod(F.spark_partition_id(), F.lit(salts)))
    part = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    part = part.select("digest", F.xxhash64("text").alias("second"), (F.col("salt") >= 0).alias("warm"), "keep_id", "n", F.when(F.col("salt") >= 0, F.col("text")).alias("t"))
    whole = part.groupBy("digest", "second").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count_if(~F.col("warm")).alias("cold"), F.bool_or("warm").alias("hot"), F.min("t").alias("least"), F.max("t").alias("most"))
    # Two texts that agree in both hashes can't be told apart on the way back: then stop.
    one = (F.col("hot") & (F.col("cold") == 0) & (F.col("least") == F.col("most"))) | (~F.col("hot") & (F.col("cold") == 1))
    size = F.when(one, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts agree in both hashes")).cast("long"))
    return whole.select("digest", "second", "hot", "keep_id", size.alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = digest_of, hot: int = HOT) -> DataFrame:
    """Every row's verdict: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.cut(texts(docs).select("doc_id", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"), digest_of(F.col("text")).alias("sha")))
    known = hot_digests(rows, scratch, hot)
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1))))
    found = groups(docs, known, salts, digest).select(F.col("digest").alias("g_digest"), F.col("second").alias("g_second"), spread.alias("g_salt"), "keep_id", "group_size")
    back = salted(rows, known, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    out = back.join(found, (F.col("digest") == F.col("g_digest")) & (F.col("second") == F.col("g_second")) & (F.col("salt") == F.col("g_salt")))
    return scratch.result(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


def deduplicate(docs: DataFrame, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """One row of docs for each text, with all its columns, by the same three stages: rows travel with their text."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows, named = numbered(docs)
    text = F.coalesce(named["text"], F.lit(""))
    known = hot_digests(rows.select(digest_of(text).alias("digest")), scratch, hot)
    place = docs.columns.index("text")
    rest = F.struct(*[F.col(c) for i, c in enumerate(rows.columns) if i != place], named["text"].isNull().alias("none"))
    order = F.struct(named["doc_id"].alias("id"), F.to_json(rest).alias("json"))
    rows = salted(rows.select(digest_of(text).alias("digest"), text.alias("text"), rest.alias("rest"), order.alias("order")), known, F.pmod(F.spark_partition_id(), F.lit(salts)))
    best = lambda df, *by: df.groupBy(*by).agg(F.max_by("rest", "order").alias("rest"), F.max("order").alias("order"))
    cold = best(rows.where("salt < 0"), "digest", "text")
    warm = best(best(rows.where("salt >= 0"), "digest", "salt", "text"), "digest", "text")
    kept = cold.unionByName(warm)
    columns = [F.when(~F.col("rest.none"), F.col("text")) if i == place else F.col(f"rest.c{i}") for i in range(len(docs.columns))]
    return scratch.result(kept.select(*columns).toDF(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
