"""Scans, filters, joins, sums, sorts, partitions, gathers and generators, each with its DuckDB SQL.

Where an operator works by row number, it uses ids that are dense from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, draw_sql, murmur32, murmur32_sql, scramble, scramble_sql, shift_hash
from ..sources.tables import log_sections, table
from .ranking import with_rank

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def pairs_a(spark: SparkSession, d: str) -> DataFrame:
    """Unique keys with a value each."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("a"))


def pairs_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key2"), cents("l_extendedprice").alias("b"))


def wrapped(c: Column) -> Column:
    """A sum as unsigned 64-bit arithmetic has it: modulo 2^64, written as text."""
    two64 = F.lit(str(2**64)).cast("decimal(38,0)")
    s = F.sum(c.cast("decimal(38,0)")) % two64
    return F.when(s < 0, s + two64).otherwise(s).cast("decimal(38,0)").cast("string")


A_SQL = "SELECT o_orderkey AS key, round(o_totalprice * 100)::BIGINT AS a FROM orders"
B_SQL = "SELECT l_orderkey AS key2, round(l_extendedprice * 100)::BIGINT AS b FROM lineitem"
WRAP = "(((sum({0}::HUGEINT) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616)::VARCHAR"

# ---- scans


@query("scan_columns", "SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def scan_columns(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("cents"))


@query("scan_pruned", "SELECT count(*) AS n, sum(l_suppkey)::BIGINT AS suppkeys FROM lineitem")
def scan_pruned(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_suppkey").alias("suppkeys"))


@query("scan_touch", "SELECT count(value) AS n FROM events")
def scan_touch(spark, d):
    return table(spark, d, "events").agg(F.count("value").alias("n"))


@query("segment_counts", "SELECT event_id // 4096 AS segment, count(*) AS n FROM events GROUP BY 1")
def segment_counts(spark, d):
    return table(spark, d, "events").groupBy(F.expr("event_id div 4096").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_summary",
    """SELECT 'head' AS side, p_partkey, p_size, p_brand FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3)
       UNION ALL SELECT 'tail', p_partkey, p_size, p_brand FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 3)""",
)
def dataset_summary(spark, d):
    """The first and the last three values of columns: a preview, so the limit is the feature."""
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    side = lambda name, order: part.orderBy(order).limit(3).select(F.lit(name).alias("side"), "*")
    return side("head", F.asc("p_partkey")).union(side("tail", F.desc("p_partkey")))


_LOG_SQL = """
WITH l AS (SELECT doc_id AS log, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT log, line_no, CASE WHEN line_no % 5 = 2 THEN '@@@ part ' || line_no ELSE line END AS text FROM l),
s AS (SELECT *, starts_with(text, '@@@') AS opens, last_value(CASE WHEN starts_with(text, '@@@') THEN trim(substr(text, 4)) END IGNORE NULLS) OVER (PARTITION BY log ORDER BY line_no) AS section FROM t)
SELECT log, section, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM s WHERE NOT opens AND section IS NOT NULL GROUP BY ALL
"""


@query("log_sections", _LOG_SQL)
def log_sections_query(spark, d):
    """Documents as logs, each fifth line a marker."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("log"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    number = F.col("i") + 1
    lines = rows.select("log", number.alias("line_no"), F.when(number % 5 == 2, F.concat(F.lit("@@@ part "), number.cast("string"))).otherwise(F.col("line")).alias("text"))
    return log_sections(lines).groupBy("log", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


# ---- filters: name, Spark condition, SQL condition
_FILTERS = {
    "filter_generic": "l_quantity * l_linenumber > 100",
    "filter_and": "l_quantity < 25 AND l_discount > 0.05",
    "filter_or": "l_quantity = 1 OR l_quantity = 50",
    "filter_lt": "l_quantity < 10",
    "filter_gt": "l_quantity > 40",
    "filter_lte": "l_quantity <= 10",
    "filter_gte": "l_quantity >= 40",
    "filter_eq": "l_quantity = 7",
    "filter_between": "l_quantity BETWEEN 26 AND 35",
    "filter_in": "l_quantity IN (3, 5)",
    "filter_fraction": "l_partkey % 8 = 0",
}


def _filtered(condition: str):
    def run(spark, d):
        rows = table(spark, d, "lineitem").where(condition)
        return rows.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"), cents("l_extendedprice").alias("cents"))

    return run


for _name, _condition in _FILTERS.items():
    query(_name, f"SELECT l_orderkey, l_partkey, l_quantity::INT AS quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem WHERE {_condition}")(_filtered(_condition))

_TILE = ["o_totalprice < 250000", "o_orderstatus = 'O'", "o_orderdate >= TIMESTAMP '1998-01-01'"]


@query(
    "tile_pass_counts",
    f"""SELECT count(*) AS tiles, count(*) FILTER (p1) AS pass1, count(*) FILTER (p2) AS pass2, count(*) FILTER (p3) AS pass3
        FROM (SELECT bool_or({_TILE[0]}) AS p1, bool_or({' AND '.join(_TILE[:2])}) AS p2, bool_or({' AND '.join(_TILE)}) AS p3 FROM orders GROUP BY o_orderkey // 16)""",
)
def tile_pass_counts(spark, d):
    """Tiles of 16 rows with a row that passes one, two and three conditions."""
    steps = [F.expr(" AND ".join(_TILE[: i + 1]).replace("TIMESTAMP ", "TIMESTAMP_NTZ ")) for i in range(3)]
    tiles = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 16").alias("tile")).agg(*[F.bool_or(c).alias(f"p{i}") for i, c in enumerate(steps)])
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), *[F.count_if(f"p{i}").alias(f"pass{i + 1}") for i in range(3)])


# ---- joins


@query("semi_join", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def semi_join(spark, d):
    keys = table(spark, d, "part").where("p_size <= 10").select("p_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(keys, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("star_join_payload", "SELECT p_brand, s_nationkey, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <= 25 GROUP BY ALL")
def star_join_payload(spark, d):
    part = table(spark, d, "part").where("p_size <= 25").select("p_partkey", "p_brand")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("p_brand", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("hash_join_aggregate", f"SELECT {WRAP.format('(a + b)')} AS total FROM ({A_SQL}) JOIN ({B_SQL}) ON key = key2")
def hash_join_aggregate(spark, d):
    return pairs_b(spark, d).join(pairs_a(spark, d), F.col("key") == F.col("key2")).agg(wrapped(F.col("a") + F.col("b")).alias("total"))


@query("hash_join_output", f"SELECT a, b FROM ({A_SQL}) JOIN ({B_SQL}) ON key = key2")
def hash_join_output(spark, d):
    return pairs_b(spark, d).join(pairs_a(spark, d), F.col("key") == F.col("key2")).select("a", "b")


@query("hash_join_output_sum", f"SELECT count(*) AS n, {WRAP.format('(a + b)')} AS total FROM ({A_SQL}) JOIN ({B_SQL}) ON key = key2")
def hash_join_output_sum(spark, d):
    """What goes beside the rows of hash_join_output: their number and the wrapped sum of both values, from the same plan."""
    return hash_join_output(spark, d).agg(F.count(F.lit(1)).alias("n"), wrapped(F.col("a") + F.col("b")).alias("total"))


@query("result_row_count", "SELECT count(*) AS n FROM (SELECT l_suppkey, l_partkey % 64 AS part FROM lineitem WHERE l_quantity < 25 GROUP BY ALL)")
def result_row_count(spark, d):
    """Rows of a grouped result."""
    groups = table(spark, d, "lineitem").where("l_quantity < 25").groupBy("l_suppkey", (F.col("l_partkey") % 64).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("n"))


@query("hash_probe_sum", f"SELECT {WRAP.format('(x.a + y.a)')} AS total FROM ({A_SQL} WHERE o_orderkey % 2 = 0) x JOIN ({A_SQL}) y USING (key)")
def hash_probe_sum(spark, d):
    build = pairs_a(spark, d).where("key % 2 = 0").select("key", F.col("a").alias("x"))
    return pairs_a(spark, d).join(build, "key").agg(wrapped(F.col("a") + F.col("x")).alias("total"))


@query("hash_set_membership", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def hash_set_membership(spark, d):
    members = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey").dropDuplicates()
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").join(members, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# ---- partitions: chunks of 2000 keys, bins of the low bits
BINS = 256


def binned(df: DataFrame, key: str = "key", begin: int = 0, end: int = 8) -> DataFrame:
    return df.withColumn("bin", F.shiftrightunsigned(key, begin).bitwiseAND(F.lit((1 << (end - begin)) - 1)).cast("int"))


@query("radix_partition", f"SELECT key // 2000 AS chunk, (key & 255)::INT AS bin, count(*) AS n, sum(a)::BIGINT AS total FROM ({A_SQL}) GROUP BY 1, 2")
def radix_partition(spark, d):
    return binned(pairs_a(spark, d)).groupBy(F.expr("key div 2000").alias("chunk"), "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total"))


@query("bin_offsets", "SELECT b.bin, coalesce(sum(h.n) OVER (ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM (SELECT range::INT AS bin FROM range(4097)) b LEFT JOIN (SELECT (o_custkey & 4095)::INT AS bin, count(*) AS n FROM orders GROUP BY 1) h USING (bin)")
def bin_offsets(spark, d):
    """Where each of 4096 bins begins in rows in bin order; an empty one where the next begins; the last row is the end."""
    sizes = binned(table(spark, d, "orders"), "o_custkey", 0, 12).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_ = spark.range(4097).select(F.col("id").cast("int").alias("bin")).join(sizes, "bin", "left")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return all_.select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_"))


@query(
    "regulate_ranges",
    f"""WITH h AS (SELECT key // 2000 AS chunk, (key & 255)::INT AS bin, count(*) AS n FROM ({A_SQL}) GROUP BY 1, 2)
        SELECT bin, chunk, n, coalesce(sum(n) OVER (PARTITION BY chunk ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_chunk,
               coalesce(sum(n) OVER (PARTITION BY bin ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_bin FROM h""",
)
def regulate_ranges(spark, d):
    """The ranges of chunks and bins, seen from the chunk and, transposed, from the bin."""
    sizes = radix_partition(spark, d).select("chunk", "bin", "n")
    before = lambda part, order: F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("bin", "chunk", "n", before("chunk", "bin").alias("in_chunk"), before("bin", "chunk").alias("in_bin"))


THRESHOLD = 4000


def _bin_sizes(spark, d) -> DataFrame:
    a = binned(pairs_a(spark, d)).groupBy("bin").agg(F.count(F.lit(1)).alias("rows_a"), F.lit(0).cast("long").alias("rows_b"))
    b = binned(pairs_b(spark, d), "key2").groupBy("bin").agg(F.lit(0).cast("long").alias("rows_a"), F.count(F.lit(1)).alias("rows_b"))
    return a.union(b).groupBy("bin").agg(F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b"))


_GROUPS_SQL = f"""
WITH RECURSIVE s AS (
  SELECT bin, count(*) FILTER (side = 'a') AS rows_a, count(*) FILTER (side = 'b') AS rows_b, row_number() OVER (ORDER BY bin) AS i
  FROM (SELECT (o_orderkey & 255)::INT AS bin, 'a' AS side FROM orders UNION ALL SELECT (l_orderkey & 255)::INT, 'b' FROM lineitem) GROUP BY bin),
g AS (
  SELECT i, bin, rows_a, rows_b, 0 AS grp, rows_a + rows_b AS total FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, s.bin, s.rows_a, s.rows_b, CASE WHEN g.total + s.rows_a + s.rows_b < {THRESHOLD} THEN g.grp ELSE g.grp + 1 END,
         CASE WHEN g.total + s.rows_a + s.rows_b < {THRESHOLD} THEN g.total ELSE 0 END + s.rows_a + s.rows_b
  FROM g JOIN s ON s.i = g.i + 1)
"""


@query("partition_groups", _GROUPS_SQL + "SELECT grp, min(bin) AS first_bin, max(bin) AS last_bin, sum(rows_a)::BIGINT AS rows_a, sum(rows_b)::BIGINT AS rows_b FROM g GROUP BY grp")
def partition_groups(spark, d, threshold: int = THRESHOLD):
    """Runs of bins whose rows stay under a threshold; a bin that reaches it alone is a group alone. The sizes of 256 bins are folded in order."""
    sizes = _bin_sizes(spark, d).agg(F.sort_array(F.collect_list(F.struct("bin", "rows_a", "rows_b"))).alias("s"))
    start = F.struct(F.lit(-1).alias("grp"), F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("of"))

    def step(state, x):
        size = x["rows_a"] + x["rows_b"]
        same = (state["grp"] >= 0) & (state["total"] + size < threshold)
        grp = F.when(same, state["grp"]).otherwise(state["grp"] + 1)
        return F.struct(grp.alias("grp"), (F.when(same, state["total"]).otherwise(F.lit(0).cast("long")) + size).alias("total"), F.concat(state["of"], F.array(grp)).alias("of"))

    rows = sizes.select("s", F.aggregate("s", start, step)["of"].alias("of")).select(F.inline(F.arrays_zip("s", "of")))
    return rows.groupBy(F.col("of").alias("grp")).agg(F.min("s.bin").alias("first_bin"), F.max("s.bin").alias("last_bin"), F.sum("s.rows_a").alias("rows_a"), F.sum("s.rows_b").alias("rows_b"))


@query("partition_group_stats", _GROUPS_SQL + "SELECT count(*) AS n_groups, max(bins) AS most_bins, max(a)::BIGINT AS most_a, max(b)::BIGINT AS most_b, ((max(a) + 9999999) // 10000000 * 10000000)::BIGINT AS room_a, ((max(b) + 9999999) // 10000000 * 10000000)::BIGINT AS room_b FROM (SELECT count(*) AS bins, sum(rows_a) AS a, sum(rows_b) AS b FROM g GROUP BY grp)")
def partition_group_stats(spark, d, align: int = 10_000_000):
    """Numbers of groups, their largest sizes, and the room for those in whole steps of `align` rows."""
    g = partition_groups(spark, d)
    room = lambda c: (F.ceil(F.max(c) / align) * align).cast("long")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.max(F.col("last_bin") - F.col("first_bin") + 1).cast("long").alias("most_bins"), F.max("rows_a").alias("most_a"), F.max("rows_b").alias("most_b"), room("rows_a").alias("room_a"), room("rows_b").alias("room_b"))


@query("exchange_roundtrip", "SELECT count(*) AS n, 0::BIGINT AS lost, 0::BIGINT AS gained FROM events")
def exchange_roundtrip(spark, d):
    """Rows before and after an exchange, compared as bags: of each two 64-bit hashes of the row, summed up by 256 groups of the first."""
    before = table(spark, d, "events").select("event_id", "user_id", "event_type", cents("value").alias("cents"))
    moved = before.repartition("user_id")

    def sums(df: DataFrame, sign: int) -> DataFrame:
        hashes = df.select(F.xxhash64(*df.columns).alias("h"), F.hash(*df.columns).cast("decimal(38,0)").alias("g"))
        return hashes.groupBy(F.pmod("h", F.lit(256)).alias("grp")).agg((F.count(F.lit(1)) * sign).alias("n"), (F.sum(F.col("h").cast("decimal(38,0)")) * sign).alias("h"), (F.sum("g") * sign).alias("g"))

    both = sums(before, 1).union(sums(moved, -1))
    rows = F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n")
    each = both.groupBy("grp").agg(rows, F.sum("n").alias("more"), ((F.sum("h") != 0) | (F.sum("g") != 0)).alias("differs"))
    # Sums that differ at equal counts: at least a row of the group was lost and another gained.
    some = F.when(F.col("differs") & (F.col("more") == 0), 1).otherwise(0)
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.greatest(F.col("more"), some)), F.lit(0)).cast("long").alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("more"), some)), F.lit(0)).cast("long").alias("gained"))


# ---- sums


@query("sum_selective", "SELECT coalesce(sum(round(value * 100)::BIGINT) FILTER (event_id % 64 = 0), 0)::BIGINT AS total FROM events")
def sum_selective(spark, d, divisor: int = 64):
    return table(spark, d, "events").agg(F.coalesce(F.sum(F.when(F.col("event_id") % divisor == 0, cents("value"))), F.lit(0)).alias("total"))


@query("sum_selective_sweep", "SELECT s.range::INT AS divisor, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events, range(64, 128, 2) s WHERE event_id % s.range = 0 GROUP BY 1")
def sum_selective_sweep(spark, d):
    """All divisors in one scan: a row goes on once for each divisor that selects it."""
    hit = F.filter(F.sequence(F.lit(64), F.lit(126), F.lit(2)), lambda s: F.col("event_id") % s == 0)
    return table(spark, d, "events").select(F.explode(hit).alias("divisor"), cents("value").alias("v")).groupBy("divisor").agg(F.sum("v").alias("total"))


@query("column_checksums", f"SELECT (SELECT {WRAP.format('a')} FROM ({A_SQL})) AS sum_a, (SELECT {WRAP.format('b')} FROM ({B_SQL})) AS sum_b")
def column_checksums(spark, d):
    return pairs_a(spark, d).agg(wrapped(F.col("a")).alias("sum_a")).join(pairs_b(spark, d).agg(wrapped(F.col("b")).alias("sum_b")))


@query("filtered_checksum", f"SELECT {WRAP.format('a')} AS total FROM ({A_SQL}) WHERE key % 2 = 0")
def filtered_checksum(spark, d):
    return pairs_a(spark, d).where("key % 2 = 0").agg(wrapped(F.col("a")).alias("total"))


# ---- hashes


@query("murmur32", f"SELECT o_orderkey, {murmur32_sql('o_orderkey')} AS h FROM orders")
def murmur32_query(spark, d):
    return table(spark, d, "orders").select("o_orderkey", murmur32(F.col("o_orderkey")).alias("h"))


@query("shift_hash", f"SELECT o_orderkey, {scramble_sql('o_orderkey')} >> 24 AS h FROM orders")
def shift_hash_query(spark, d):
    return table(spark, d, "orders").select("o_orderkey", shift_hash(scramble(F.col("o_orderkey"))).alias("h"))


# ---- sorts; each row's place is a column, as a result has no order
SCRAMBLED = f"SELECT {scramble_sql('o_orderkey')} AS key, round(o_totalprice * 100)::BIGINT AS val, o_orderkey FROM orders"


def scrambled(spark, d) -> DataFrame:
    """Distinct, sparse keys in no order."""
    return table(spark, d, "orders").select(scramble(F.col("o_orderkey")).alias("key"), cents("o_totalprice").alias("val"), "o_orderkey")


@query("sort_keys", f"SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({SCRAMBLED})")
def sort_keys(spark, d):
    return with_rank(scrambled(spark, d).select("key"), "key")


#: Keys of four integer types from a scrambled 32-bit one: Spark's column, its SQL.
_TYPES = {
    "i32": (lambda k: (k - 2**31).cast("int"), "(key - 2147483648)::INT"),
    "u32": (lambda k: k, "key"),
    "i64": (lambda k: (k - 2**31) * 2**31, "(key - 2147483648) * 2147483648"),
    "u64": (lambda k: k.cast("decimal(20,0)") * 2**32 + 7, "(key::HUGEINT * 4294967296 + 7)::DECIMAL(38,0)"),
}


def _sorted_as(kind: str):
    column, sql = _TYPES[kind]

    def run(spark, d):
        keys = scrambled(spark, d).select(column(F.col("key")).alias("key"))
        return with_rank(keys, "key").select(F.col("key").cast("string").alias("key"), "rank")

    query(f"sort_keys_{kind}", f"SELECT key::VARCHAR AS key, row_number() OVER (ORDER BY key) - 1 AS rank FROM (SELECT {sql} AS key FROM ({SCRAMBLED}))")(run)


for _kind in _TYPES:
    _sorted_as(_kind)


@query("sort_pairs", f"SELECT key, val, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({SCRAMBLED})")
def sort_pairs(spark, d):
    return with_rank(scrambled(spark, d).select("key", "val"), "key")


@query("sort_pairs_bits", f"SELECT key, val, (key >> 4) & 255 AS bits, row_number() OVER (ORDER BY (key >> 4) & 255, o_orderkey) - 1 AS rank FROM ({SCRAMBLED})")
def sort_pairs_bits(spark, d):
    """Order by some bits of the key; equal bits keep the input's order."""
    rows = scrambled(spark, d).withColumn("bits", F.shiftrightunsigned("key", 4).bitwiseAND(F.lit(255)))
    return with_rank(rows, "bits", "o_orderkey").drop("o_orderkey")


@query("sort_chunks", f"SELECT o_orderkey // 2000 AS chunk, key, row_number() OVER (PARTITION BY o_orderkey // 2000 ORDER BY key) - 1 AS rank FROM ({SCRAMBLED})")
def sort_chunks(spark, d):
    rows = scrambled(spark, d).withColumn("chunk", F.expr("o_orderkey div 2000"))
    return rows.select("chunk", "key", (F.row_number().over(Window.partitionBy("chunk").orderBy("key")) - 1).cast("long").alias("rank"))


@query("sort_external", "SELECT cents, event_id, row_number() OVER (ORDER BY cents, event_id) - 1 AS rank FROM (SELECT round(value * 100)::BIGINT AS cents, event_id FROM events)")
def sort_external(spark, d):
    """A total sort with ties."""
    return with_rank(table(spark, d, "events").select(cents("value").alias("cents"), "event_id"), "cents", "event_id")


def _runs(spark, d, n: int) -> DataFrame:
    return scrambled(spark, d).select("key", (F.col("o_orderkey") % n).cast("int").alias("run"))


def _runs_sql(n: int) -> str:
    return f"SELECT key, (o_orderkey % {n})::INT AS run FROM ({SCRAMBLED})"


@query("merge_sorted", f"SELECT key, run, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({_runs_sql(2)})")
def merge_sorted(spark, d):
    return with_rank(_runs(spark, d, 2), "key")


@query("merge_levels", f"SELECT key, run, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({_runs_sql(8)})")
def merge_levels(spark, d):
    return with_rank(_runs(spark, d, 8), "key")


@query("value_bounds", f"SELECT run, count(*) FILTER (key < 2147483648) AS lower, count(*) FILTER (key <= 2147483648) AS upper FROM ({_runs_sql(8)}) GROUP BY run")
def value_bounds(spark, d, value: int = 2**31):
    """Rows of each run below a value, and not above it."""
    return _runs(spark, d, 8).groupBy("run").agg(F.count_if(F.col("key") < value).alias("lower"), F.count_if(F.col("key") <= value).alias("upper"))


@query("rank_pivots", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({_runs_sql(8)})) SELECT run, count(*) FILTER (rank < 700) AS split, (SELECT min(key) FROM r WHERE rank >= 700) AS pivot FROM r GROUP BY run")
def rank_pivots(spark, d, count: int = 700):
    """How many rows of each run are among the first `count` of all, and the first key that isn't."""
    rows = with_rank(_runs(spark, d, 8), "key")
    each = rows.groupBy("run").agg(F.count_if(F.col("rank") < count).alias("split"), F.min(F.when(F.col("rank") >= count, F.col("key"))).alias("own"))
    return each.select("run", "split", F.min("own").over(Window.partitionBy()).alias("pivot"))  # a row a run


@query("merge_groups", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({_runs_sql(8)})) SELECT rank // 500 AS grp, run, count(*) AS n, min(key) AS first_key FROM r GROUP BY 1, 2")
def merge_groups(spark, d, size: int = 500):
    """The rows of each run that go to each group of `size` consecutive rows of the whole."""
    return with_rank(_runs(spark, d, 8), "key").groupBy(F.expr(f"rank div {size}").alias("grp"), "run").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query("merge_path", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({_runs_sql(2)})) SELECT t.target, count(*) FILTER (run = 0) AS left_, count(*) FILTER (run = 1) AS right_ FROM r, (VALUES (250), (500), (1000)) t(target) WHERE rank < t.target GROUP BY 1")
def merge_path(spark, d, targets: tuple[int, ...] = (250, 500, 1000)):
    """How many rows of each of two inputs are before each of some places of their merge."""
    rows = with_rank(_runs(spark, d, 2), "key").where(F.col("rank") < max(targets))
    rows = rows.select("run", F.explode(F.filter(F.array(*map(F.lit, targets)), lambda t: F.col("rank") < t)).alias("target"))
    return rows.groupBy("target").agg(F.count_if(F.col("run") == 0).alias("left_"), F.count_if(F.col("run") == 1).alias("right_"))


@query("even_divide", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS rank, count(*) OVER () AS n FROM ({_runs_sql(2)})) SELECT rank * 16 // n AS piece, run, count(*) AS n FROM r GROUP BY 1, 2")
def even_divide(spark, d, pieces: int = 16):
    rows = _runs(spark, d, 2)
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    return with_rank(rows, "key").join(F.broadcast(n)).groupBy(F.expr(f"rank * {pieces} div total").alias("piece"), "run").agg(F.count(F.lit(1)).alias("n"))


# ---- gathers: C[i] = source[index(i)], by a join on the row number


def _source(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), cents("o_totalprice").alias("val"))


def _indexed(spark, d) -> DataFrame:
    n = table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i")).join(F.broadcast(n))


_GATHER = "WITH s AS (SELECT o_orderkey AS row, round(o_totalprice * 100)::BIGINT AS val FROM orders), n AS (SELECT max(o_orderkey) + 1 AS n FROM orders) "


@query("gather", _GATHER + f"SELECT o_orderkey AS i, val FROM orders, n JOIN s ON s.row = {draw_sql('o_orderkey')} % n")
def gather(spark, d):
    at = _indexed(spark, d).select("i", (draw(F.col("i")) % F.col("n")).alias("at"))
    return at.join(_source(spark, d), F.col("at") == F.col("row")).select("i", "val")


@query("gather_bounded", _GATHER + f"SELECT o_orderkey AS i, val FROM orders, n JOIN s ON s.row = {draw_sql('o_orderkey')} % 1000")
def gather_bounded(spark, d, bound: int = 1000):
    at = _indexed(spark, d).select("i", (draw(F.col("i")) % bound).alias("at"))
    return at.join(_source(spark, d), F.col("at") == F.col("row")).select("i", "val")


@query(
    "gather_blocked",
    _GATHER + f"SELECT g, count(*) AS n, sum(val)::BIGINT AS total, sum(val * (i % 97))::BIGINT AS mixed FROM (SELECT o_orderkey AS i, g, (({draw_sql('(o_orderkey // g)')} % n) // g) * g + o_orderkey % g AS spot FROM orders, n, (VALUES (1), (2), (4), (8), (16), (32), (64)) t(g)) JOIN s ON s.row = spot GROUP BY g",
)
def gather_blocked(spark, d, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64)):
    """Gathers of whole blocks, for some sizes of them; sums that depend on every row's place."""
    rows = _indexed(spark, d).select("i", "n", F.explode(F.array(*map(F.lit, sizes))).alias("g"))
    at = ((draw(F.expr("i div g")) % F.col("n")) / F.col("g")).cast("long") * F.col("g") + F.col("i") % F.col("g")
    found = rows.withColumn("at", at).join(_source(spark, d), F.col("at") == F.col("row"))
    return found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"), F.sum(F.col("val") * (F.col("i") % 97)).alias("mixed"))


# ---- generators: no input; the folder only names the session's tables


@query("gen_random", f"SELECT range AS i, {murmur32_sql('range + 666')} AS value FROM range(10000)")
def gen_random(spark, d, n: int = 10_000, seed: int = 666):
    return spark.range(n).select(F.col("id").alias("i"), murmur32(F.col("id") + seed).alias("value"))


@query("gen_random_64", f"SELECT range AS i, range // 1000 AS chunk, ({murmur32_sql('range % 1000 + (666 + range // 1000) * 7919')}::HUGEINT * 2147483648 + ({murmur32_sql('range % 1000 + (666 + range // 1000) * 104729')} >> 1))::BIGINT AS value FROM range(10000)")
def gen_random_64(spark, d, n: int = 10_000, chunk: int = 1000, seed: int = 666):
    """63 random bits a row, chunk by chunk: a chunk's rows depend on seed + chunk alone, so any chunk can be made by itself."""
    at, own = (F.col("id") / chunk).cast("long"), F.col("id") % chunk
    high, low = murmur32(own + (at + seed) * 7919), F.shiftright(murmur32(own + (at + seed) * 104729), 1)
    return spark.range(n).select(F.col("id").alias("i"), at.alias("chunk"), (high * 2**31 + low).alias("value"))


def _unique(n: int) -> str:
    return f"SELECT {murmur32_sql('range * 2654435761 + 13')} AS key FROM range({n})"


@query("unique_keys", f"SELECT key, row_number() OVER (ORDER BY {murmur32_sql('key + 5')}, key) - 1 AS rank FROM ({_unique(5000)})")
def unique_keys(spark, d, n: int = 5000):
    """n distinct 32-bit keys in a seeded order. The keys are an odd multiple of the row number through a one-to-one mixing, so none repeats and none has to be dropped."""
    if n > 2**32:
        raise ValueError(f"there are 2^32 keys of 32 bits, not {n}")
    keys = spark.range(n).select(murmur32(scramble(F.col("id")) + 13).alias("key"))
    return with_rank(keys.withColumn("turn", murmur32(F.col("key") + 5)), "turn", "key").select("key", "rank")


@query("permutation", f"SELECT range AS i, row_number() OVER (ORDER BY {murmur32_sql('range + 777')}, range) - 1 AS rank FROM range(10000)")
def permutation(spark, d, n: int = 10_000):
    return with_rank(spark.range(n).select(F.col("id").alias("i"), murmur32(F.col("id") + 777).alias("turn")), "turn", "i").select("i", "rank")
