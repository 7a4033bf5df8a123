"""Plans that matter at scale: hot keys are split, vectors stay out of shuffles, scans are pruned."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from dishlens.operators import joins
from dishlens.plans import search as S
from dishlens.operators.spread import estimated_bytes, spread_small


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_key_spreads_over_tasks(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "SMALL_SIDE_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big = spark.range(0, 30_000).select(
            "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k")
        )
        unique = big.filter("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = joins.join_unique(big, unique, ["k"], how, ["id"])
        hot = joined.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()
        assert len(hot) >= 4 and max(r["count"] for r in hot) < 8_000
        plain = big.join(unique, ["k"], how)
        assert joined.exceptAll(plain).count() == 0 and joined.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_vectors_never_enter_a_shuffle(spark):
    path = "/root/testdata/sf0.001"
    from dishlens.suite import search as suite

    ranked = S.rank_businesses(suite._chunks(spark, path), suite._reviews(spark, path), [0.1] * 64, 5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange" in line]
    assert shuffles and not any("embedding" in line for line in shuffles)
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" in plan


def test_scans_read_only_what_is_needed(spark):
    plan = driver.queries()["anti_bot_failures"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in text and "o_orderdate" not in text


def test_page_parser_runs_once(spark):
    text = driver.queries()["sub_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_large_inputs_are_not_repartitioned(spark):
    df = spark.range(1000)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(spread_small(df)) and "Repartition" not in plan(spread_small(df, limit=100))


def test_entry_runs_in_a_plain_session_elsewhere(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('entry', r'{repo}/__spark_entry__.py')\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', m.entry(s).count(), m.queries()['html_to_markdown'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 10 50" in out.stdout or "ROWS 8 50" in out.stdout, out.stderr[-2000:]


def test_spread_gives_no_task_too_much(spark, tmp_path):
    """tasks of a spread table follow its size, not the number of cores alone."""
    from dishlens.operators import spread

    path = str(tmp_path / "t")
    spark.range(6_000_000).select(F.xxhash64("id").alias("a")).write.parquet(path)
    table = spark.read.parquet(path)
    size, cores = spread.estimated_bytes(table), spark.sparkContext.defaultParallelism
    assert spread.spread_small(table).rdd.getNumPartitions() == -(-size // spread.SPREAD_BYTES) > cores
    assert spread.spread_small(spark.range(10)).rdd.getNumPartitions() == cores


def test_no_broadcast_of_what_is_small_only_compressed(spark, tmp_path, monkeypatch):
    """copies that compress to a few bytes a row are counted before a join may gather them in the driver."""
    for name, size in (("TINY_BYTES", 2 << 10), ("HELD_BYTES", 256 << 10)):  # a smaller driver
        monkeypatch.setattr(joins, name, size, raising=False)
    source = "/root/testdata/sf0.001"
    folder = str(tmp_path)
    copies = {"lineitem": (None, 1), "part": ("p_partkey", 30), "supplier": ("s_suppkey", 600)}
    for name, (key, n) in copies.items():
        rows = spark.read.parquet(f"{source}/{name}.parquet")
        if key:  # numbers that no line item names
            step = rows.agg(F.max(key)).first()[0] + 1
            shifted = (F.col(key) + F.col("copy") * step).alias(key)
            rows = spark.range(n).withColumnRenamed("id", "copy").join(rows.hint("broadcast")).select(
                shifted, *[c for c in rows.columns if c != key]
            )
        rows.repartition(1).write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    part, supplier = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("part", "supplier"))
    assert max(map(estimated_bytes, (part, supplier))) < joins.SMALL_SIDE_BYTES
    events = spark.range(10).select(F.col("id").alias("event_id"), F.col("id").alias("p_partkey"))
    plan = joins.join_unique(events, part, ["p_partkey"], "left", ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    few, many = (driver.queries()["menu_item_upsert"](spark, at) for at in (source, folder))
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert few.count() == many.count() and few.exceptAll(many).isEmpty()
