"""What the physical plans of some queries must look like."""

import re

import pytest

from tidemark.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    frame = QUERIES[name](spark, SF)
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "message_count_running")
    assert "PushedFilters: [In(event_type, [click,error,purchase])]" in text
    assert all("value" not in s for s in re.findall(r"ReadSchema: struct<[^>]*>", text))


def test_unused_columns_are_not_read(spark):
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "event_counts_by_type")))
    assert schema == "event_type:string"


def test_rankings_keep_k_rows_a_task(spark):
    assert "TakeOrderedAndProject" in plan(spark, "simple_top20_spammers")
    assert "WindowGroupLimit" in plan(spark, "top_spammers_asof")


@pytest.mark.parametrize("name", ["rule3_email_share", "rule4_ramp_up", "word_sliding_per_message"])
def test_sliding_windows_are_dealt_by_time(spark, name):
    windows = re.findall(r"windowspecdefinition\(([^A]*)", plan(spark, name))
    assert windows and all("__bucket" in w for w in windows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_simple", "stream_daily_counts", "stream_ip", "stream_ip_lagged", "stream_word_window", "embeddings_cosine", "embeddings_cosine_wide", "powerlaw_ols", "tf_idf_search"}))
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "critical_path":
        assert "Python" not in text and "InPandas" not in text


def test_a_hot_key_is_dealt_by_time(spark):
    """All rows of one key: the running window's rows are spread over the partitions."""
    from pyspark.sql import functions as F

    from tidemark.operators import state

    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = state.running(rows, ["k"], {"n": ("count", F.lit(1))}, split_ms=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.5 * 20_000
        assert out.where("n != ts + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["simple_spam_messages", "ip_spam_messages", "full_spam_score", "popularity", "avg_response_time", "votes_received_since_voted", "program_popularity"])
def test_reads_upon_reads_start_from_a_table(spark, name):
    """Only what was settled is used twice, and rows are dealt once a read: windows and joins share a shuffle."""
    text = plan(spark, name)
    assert "events.parquet" not in text
    assert text.count("FileScan parquet") == 2 and text.count("Exchange hashpartitioning") <= 5
    rows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[ts", text)
    assert rows and all("__bucket" in r for r in rows)


def test_joins_of_running_reads_are_plain_equalities(spark):
    assert "<=>" not in plan(spark, "message_count_running") and "coalesce(isnull" not in plan(spark, "message_count_running")


def test_states_without_keys_are_dealt_by_time(spark):
    from pyspark.sql import functions as F

    from tidemark.plans.program import Program, Read, State, Write

    p = Program(State("all", "count", split_ms=100)).rule("w", "e", writes=[Write("all")]).rule("r", "e", {"n": Read("all", default=0)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = p.run({"e": spark.range(20_000).select(F.col("id").alias("ts"))}).rows["r"]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.5 * 20_000 and out.where("n != ts + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
