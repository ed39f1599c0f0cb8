"""Vector and text steps, with their DuckDB SQL. Sums are rounded, as their order is free."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .queries import query

TASK = "Given a web search query, retrieve relevant passages that answer the query"
_NORM = "sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]))"


def _wide(c):
    return F.transform(c, lambda x: x.cast("double"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@query("l2_normalize", f"SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / {_NORM}, 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 65))::INT AS i FROM embeddings)")
def l2_normalize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", _wide("embedding").alias("e"))
    norm = rows.withColumn("norm", F.sqrt(_dot(F.col("e"), F.col("e"))))
    return norm.select("vec_id", "norm", F.posexplode("e").alias("pos", "x")).select("vec_id", "pos", (F.round(F.col("x") / F.col("norm"), 6) + 0.0).alias("value"))


@query("cosine_scores", f"WITH e AS (SELECT vec_id, [x::DOUBLE / {_NORM} FOR x IN embedding] AS e FROM embeddings) SELECT q.vec_id AS query_id, e.vec_id, round(100 * list_dot_product(q.e, e.e), 6) + 0.0 AS score FROM e, e q WHERE q.vec_id < 16")
def cosine_scores(spark, d, queries: int = 16):
    """Scores of a batch of `queries` vectors against all; the batch is of fixed size and goes to every task."""
    rows = table(spark, d, "embeddings").select("vec_id", _wide("embedding").alias("e"))
    unit = rows.withColumn("n", F.sqrt(_dot(F.col("e"), F.col("e")))).select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("e"))
    batch = unit.where(F.col("vec_id") < queries).select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"))
    return unit.join(F.broadcast(batch)).select("query_id", "vec_id", (F.round(_dot(F.col("q"), F.col("e")) * 100, 6) + 0.0).alias("score"))


@query("mean_pooling", "SELECT label, i - 1 AS pos, round(sum(CASE WHEN vec_id % 3 <> 0 THEN embedding[i]::DOUBLE ELSE 0 END) / greatest(sum(CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0 END), 1e-9), 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 65))::INT AS i FROM embeddings) GROUP BY ALL")
def mean_pooling(spark, d):
    """The mean of each label's vectors under a mask."""
    rows = table(spark, d, "embeddings").withColumn("m", F.when(F.col("vec_id") % 3 != 0, 1.0).otherwise(0.0))
    each = rows.select("label", "m", F.posexplode(_wide("embedding")).alias("pos", "x"))
    value = F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))
    return each.groupBy("label", "pos").agg((F.round(value, 6) + 0.0).alias("value"))


_LAST_SQL = """
WITH m AS (SELECT label, vec_id, embedding, vec_id % 3 <> 0 AS on_, max(vec_id) OVER (PARTITION BY label) AS last FROM embeddings),
p AS (SELECT label, bool_or(on_ AND vec_id = last) AS left_padded, max(vec_id) AS last, max(vec_id) FILTER (on_) AS last_on FROM m GROUP BY label),
v AS (SELECT p.label, p.left_padded, m.vec_id, m.embedding FROM p JOIN m ON m.label = p.label AND m.vec_id = CASE WHEN (SELECT bool_and(left_padded) FROM p) THEN p.last ELSE p.last_on END)
SELECT label, left_padded, vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, 65))::INT AS i FROM v)
"""


@query("last_token_pool", _LAST_SQL)
def last_token_pool(spark, d):
    """Each label's last vector under a mask, in full. If the mask has every label's last row, rows are padded on the left, and the last row is it as it stands."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 3 != 0).alias("on"))
    each = rows.groupBy("label").agg(
        F.max("vec_id").alias("last"), F.max(F.when(F.col("on"), F.col("vec_id"))).alias("last_on"), F.max_by("embedding", "vec_id").alias("at_last"), F.max_by("embedding", F.when(F.col("on"), F.col("vec_id"))).alias("at_last_on"),
    )
    each = each.withColumn("left_padded", F.coalesce(F.col("last") == F.col("last_on"), F.lit(False)))
    all_left = F.bool_and("left_padded").over(Window.partitionBy())  # a row a label
    each = each.withColumn("all_left", all_left)
    picked = each.select("label", "left_padded", F.when(F.col("all_left"), F.col("last")).otherwise(F.col("last_on")).alias("vec_id"), F.when(F.col("all_left"), F.col("at_last")).otherwise(F.col("at_last_on")).alias("e"))
    return picked.where("vec_id IS NOT NULL").select("label", "left_padded", "vec_id", F.posexplode(_wide("e")).alias("pos", "x")).withColumn("value", F.round("x", 6) + 0.0).drop("x")


@query("text_strip", r"SELECT doc_id, i - 1 AS line_no, md5(trim(line, ' ')) AS stripped FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i, unnest(string_split(text, chr(10))) AS line FROM documents)")
def text_strip(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.md5(F.trim("line").cast("binary")).alias("stripped"))


@query("merge_every_n", "SELECT doc_id // 4 AS grp, count(*) AS n, md5(string_agg(text, ' ' ORDER BY doc_id)) AS merged FROM documents GROUP BY 1")
def merge_every_n(spark, d, n: int = 4):
    rows = table(spark, d, "documents").groupBy(F.expr(f"doc_id div {n}").alias("grp"))
    merged = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), " ")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.md5(merged.cast("binary")).alias("merged"))


@query("prompt_format", f"SELECT item_id, md5('Instruct: {TASK}' || chr(10) || 'Query: ' || text) AS prompt FROM benchmark")
def prompt_format(spark, d, task: str = TASK):
    return table(spark, d, "benchmark").select("item_id", F.md5(F.concat(F.lit(f"Instruct: {task}\nQuery: "), "text").cast("binary")).alias("prompt"))


@query("batch_ids", "SELECT doc_id // 32 AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def batch_ids(spark, d, size: int = 32):
    return table(spark, d, "documents").groupBy(F.expr(f"doc_id div {size}").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("extra_memory", "SELECT range::INT AS sigma, round(1 - least(2.0::DOUBLE / 3, 32.0::DOUBLE / (3 * range)), 9) AS extra FROM range(1, 100)")
def extra_memory(spark, d):
    """The part of memory to spare beyond what covers two thirds, by ratio sigma."""
    return spark.range(1, 100).select(F.col("id").cast("int").alias("sigma"), F.round(1 - F.least(F.lit(2.0 / 3), F.lit(32.0) / (3 * F.col("id"))), 9).alias("extra"))


@query("throughput", "SELECT range::INT AS iterations, round(32 * 512 * range / 7.5::DOUBLE, 6) AS tokens_per_second FROM range(1, 20)")
def throughput(spark, d, batch: int = 32, tokens: int = 512, seconds: float = 7.5):
    return spark.range(1, 20).select(F.col("id").cast("int").alias("iterations"), F.round(F.col("id") * (batch * tokens) / F.lit(seconds), 6).alias("tokens_per_second"))
