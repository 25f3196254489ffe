"""Pictures made from a short table: many tasks make them, and no join takes them through the driver."""

import pytest

import __spark_entry__
from loomgrid.plans import grid as plans

QUERIES = ["a13_label_means", "a14_vivid_label_means", "f12_transparency_lock", "r5_outline", "u2_invert", "p10_distinct_then_map", "r6_delete_pixels"]


@pytest.mark.parametrize("name", QUERIES)
def test_pictures_are_not_broadcast(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


def test_pictures_come_from_many_tasks(spark, sf_dir):
    made = plans.pixels(spark, sf_dir)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert made.count() == suppliers * plans.W * plans.H
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tasks_follow_the_rows(spark):
    from loomgrid.operators import grid

    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert grid.dealt(rows, "k", 10).rdd.getNumPartitions() == 100
    assert grid.dealt(rows.limit(0), "k", 10).count() == 0
