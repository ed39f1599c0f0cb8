import pytest

from millrace.registry import FLAGSHIP, QUERIES, SQL

from .oracle import same

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    same(spark, MORE if name.startswith("ssb") else SMALL, QUERIES[name], SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["ssb_q21", "ssb_q41", "hash_join_output"])
@pytest.mark.parametrize("how", ["broadcast", "merge", "shuffle"])
def test_join_strategies_agree(spark, name, how):
    """The same rows whichever joins are picked, as of the three variants of each query."""
    want = sorted(map(tuple, QUERIES[name](spark, SMALL).collect()))
    conf = {"broadcast": {"spark.sql.autoBroadcastJoinThreshold": "64m"}, "merge": {"spark.sql.autoBroadcastJoinThreshold": "-1"}, "shuffle": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "false"}}[how]
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, QUERIES[name](spark, SMALL).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_probe_sum_is_twice_the_checksum(spark):
    one = lambda n: int(QUERIES[n](spark, SMALL).first()[0])
    assert one("hash_probe_sum") == 2 * one("filtered_checksum")


def test_sorted_and_complete(spark):
    rows = sorted(QUERIES["sort_external"](spark, SMALL).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert [(r.cents, r.event_id) for r in rows] == sorted((r.cents, r.event_id) for r in rows)


def test_murmur_of_known_values(spark):
    from pyspark.sql import functions as F

    from millrace.functions.hashing import murmur32

    def plain(h):
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ (h >> shift)) * by) & 0xFFFFFFFF
        return h ^ (h >> 16)

    values = [0, 1, 2, 65535, 65536, 2**31, 2**32 - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(murmur32(F.col("v")).alias("h")).collect()
    assert [r.h for r in got] == list(map(plain, values))


def test_raw_columns(spark, tmp_path):
    import numpy as np

    from millrace.sources.tables import read_column

    for kind, values in (("int32", [0, -1, 2**31 - 1, -(2**31)]), ("uint32", [0, 2**32 - 1]), ("int64", [-1, 2**63 - 1, -(2**63)]), ("uint64", [0, 2**64 - 1])):
        np.array(values, dtype=kind).tofile(tmp_path / kind)
        got = read_column(spark, str(tmp_path / kind), kind).orderBy("i").collect()
        assert [int(r.value) for r in got] == values


def test_stream_gives_the_tables_windows(spark, tmp_path):
    from millrace.streaming.events import stream_windows

    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, QUERIES["event_windows"](spark, SMALL).collect()))
    assert sorted(map(tuple, stream_windows(spark, str(tmp_path)).collect())) == want


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_lt"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,10.0)" in plan and "l_shipdate" not in plan


def test_ranges_split_one_key(spark):
    """A table of one key is ranked in several tasks, by its ties or, without any, by its rows."""
    from pyspark.sql import functions as F

    from millrace.operators.ranking import _ranged, with_rank

    rows = spark.range(20000).select(F.lit(7).alias("key"), (F.col("id") * 7919 % 20011).alias("tie"))
    for by in (["key", "tie"], ["key"]):
        sizes = [r["count"] for r in _ranged(rows.withColumn("_row", F.xxhash64("key", "tie")), by, 100).groupBy("_range").count().collect()]
        assert len(sizes) == 100 and max(sizes) < 600
    for ties in (["tie"], []):
        got = with_rank(rows, "key", *ties).collect()
        assert sorted(r["rank"] for r in got) == list(range(20000))
        assert not ties or [r["tie"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["tie"] for r in got)


def test_rank_of_joined_rows_at_many_ranges(spark):
    from millrace.operators.ranking import with_rank
    from millrace.sources.tables import table

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        lines = table(spark, MORE, "lineitem").join(table(spark, MORE, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("l_partkey", "l_orderkey", "l_extendedprice")
        got = [(r["rank"], r["l_partkey"], r["l_orderkey"]) for r in with_rank(lines, "l_partkey", "l_orderkey").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[0] for r in sorted(got)] == list(range(len(got)))
    assert [r[1:] for r in sorted(got)] == sorted(r[1:] for r in got)


@pytest.mark.parametrize("name", ["ssb_q21", "ssb_q31", "ssb_q41", "ssb_q43"])
def test_dimensions_are_joined_before_orders(spark, name):
    """The uppermost join is that of lines and orders; the lines below it are filtered by a dimension."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert "o_orderkey" in joins[0] and len(joins) > 1
    assert not any("o_orderkey" in x for x in joins[1:])
