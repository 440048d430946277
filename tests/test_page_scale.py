"""Pages are read in even parts, and their parts are worked out once."""

import pytest
from pyspark.sql import functions as F

from keystead.functions import html
from keystead.operators import extract
from keystead.plans import testbed


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_split_are_dealt_out(spark, tmp_path):
    """As many splits as cores, all rows in one: a large file of one row group."""
    orders = spark.range(4000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for _ in range(8):
        orders.filter("o_orderkey < 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    table = testbed.table(spark, str(tmp_path), "orders")
    assert table.count() == 4000 and max(_sizes(table)) <= 1000
    assert {r["o_orderkey"] for r in table.collect()} == set(range(4000))


@pytest.mark.parametrize("rows", [0, 1, 100])
def test_partitions_follow_the_rows(spark, rows):
    cores = spark.sparkContext.defaultParallelism
    dealt = testbed._dealt(spark.range(rows), rows, 4)
    assert dealt.rdd.getNumPartitions() % cores == 0 and sum(_sizes(dealt)) == rows
    assert max(_sizes(dealt), default=0) <= 4 + 1


def test_arrays_are_worked_out_once(spark):
    """The first entry per key, with the array in the plan once, whatever reads it."""
    rows = spark.createDataFrame([("b=1,a=2,b=3,a=2",), ("",), (None,)], "x string")
    split = F.transform(F.split("x", ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("v")))
    out = rows.select(F.transform(html.first_by(split, "k"), lambda p: p["v"]).alias("v"))
    assert [r["v"] for r in out.collect()] == [["b=1", "a=2"], [""], None]
    assert _plan(out).count("split(") == 1


def test_attributes_and_running_text_are_matched_once(spark):
    rows = spark.createDataFrame([("<p><img SRC=' ' alt=\"a &amp; b\"><img data-src=\"2.png\"><img src=''></p>",), ("<i>築年 : 2001</i>",), (None,)], "m string")
    out = rows.select(html.images("m").alias("i"), html.free_text_value("m", "築年").alias("t"))
    got = out.collect()
    assert [tuple(x) for x in got[0]["i"]] == [(" ", "a & b"), ("2.png", "")] and [r["t"] for r in got] == [None, "築年 : 2001", None]
    plan = _plan(out)
    assert plan.count(r"\sdata-src\s") == 1 and plan.count("築年") <= 3


def test_labels_are_not_worked_out_for_every_name(spark):
    page = "<table><tr><th>物件名</th><td>-</td></tr><tr><th>建物名</th><td>甲</td></tr></table><h1>乙</h1>"
    rows = spark.createDataFrame([(1, page), (2, "<h1>乙</h1>"), (3, None)], "page_id long, html string")
    out = extract.label_rows(rows).select("page_id", extract.property_name().alias("name"))
    assert sorted((r["page_id"], r["name"]) for r in out.collect()) == [(1, "甲"), (2, "乙"), (3, None)]
    # the marks of the cells are set in a column of their own or in a bound value, not under a lambda over the names
    plan = _plan(out)
    assert plan.count(html._OTHER_TAGS) == 1 and "lambda x" in plan
    at = plan.index("物件名")
    assert html._OTHER_TAGS not in plan[at:plan.index("breadcrumb", at)]
