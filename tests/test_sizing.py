from pyspark.sql import functions as F

from helpers import SF_SMALL
from eventlens.plans import bindings as B
from eventlens.plans.sizing import balance, measured_size, sized_side
from eventlens.session import clear_scratch, scratch_path, scratch_root, shared_dir


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_size_is_one_partial_aggregation(spark):
    df = spark.range(1000).repartition(8).select("id", F.array("id", "id").alias("a"))
    rows, size = measured_size(df)
    assert rows == 1000 and size > 1000 * (16 + 8)  # nested values count with their content
    plan = _plan(df.agg(F.count("*"), F.sum("id")))
    assert "partial_count" in plan and "GlobalLimit" not in plan


def test_sized_side_broadcasts_only_under_bound(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 7)
    small = spark.range(7).withColumnRenamed("id", "k")
    joined = big.join(sized_side(small, max_rows=10), "k")
    assert "BroadcastHashJoin" in _plan(joined) and joined.count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        over = big.join(sized_side(small, max_rows=3), "k")
        assert "BroadcastHashJoin" not in _plan(over) and over.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_byte_bound_stops_wide_sides(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    rows, size = measured_size(wide)
    assert rows == 10 and size >= 10 * 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.range(10).join(sized_side(wide, max_rows=100, max_bytes=5000), "id")
        assert "BroadcastHashJoin" not in _plan(j) and j.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_balance_only_when_scan_is_coarse(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert "REPARTITION_BY_NUM" in _plan(balance(docs, "doc_id", 4))
    assert balance(docs, "doc_id", 1) is docs
    assert "REPARTITION_BY_NUM" in _plan(balance(spark.range(0, 100, 1, 65), "id", 200))  # 65 splits, 200 cores
    assert "REPARTITION_BY_NUM" not in _plan(B.table(spark, SF_SMALL, "orders"))


def test_shared_folder_paths(spark):
    base = shared_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(base.rstrip("/")) and a != b


def test_scratch_is_cleared_for_this_application_only(spark):
    import os
    import uuid
    root, foreign = scratch_root(spark), f"{shared_dir(spark)}/eventlens/app-other/{uuid.uuid4().hex}"
    assert spark.sparkContext.applicationId in root
    spark.range(3).write.parquet(scratch_path(spark, "t-clear"))
    spark.range(3).write.parquet(foreign)
    here = lambda p: os.path.exists(p.removeprefix("file:"))
    assert here(root) and here(foreign)
    assert clear_scratch(spark) and not here(root) and here(foreign)
