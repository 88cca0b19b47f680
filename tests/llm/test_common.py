import pytest
from pyspark.sql import functions as F

from provenir.llm import common, warc


@pytest.fixture
def plain_shuffles(spark):
    """No adaptive change of partitions, so that tasks can be told apart by them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def loads(df):
    counts = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return counts[-1], counts[len(counts) // 2]


def test_a_hot_key_is_dealt_out(spark, plain_shuffles):
    common.prepare(spark)
    rows = spark.range(100_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))
    small = rows.where("id % 7 <> 1").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).checkpoint()
    got = common.dealt_join(rows, small, ["key"], F.col("id"))
    assert got.columns == ["key", "id", "least"] and got.count() == 100_000
    most, median = loads(got)
    assert most <= 2 * median
    assert got.exceptAll(rows.join(small, "key", "left").select("key", "id", "least")).count() == 0
    inner = common.dealt_join(rows, small.where("key <> 'hot'"), ["key"], F.col("id"), "inner")
    assert inner.count() == rows.where("key <> 'hot'").count()
    assert common.dealt_join(rows, small.limit(0), ["key"], F.col("id")).where("least is null").count() == 100_000


def test_pages_of_one_payload_are_dealt_out(spark, plain_shuffles):
    common.prepare(spark)
    pages = spark.range(100_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("error page").alias("html"))
    got = warc.with_references(pages)
    most, median = loads(got)
    assert most <= 2 * median and got.where("refers_to is not null").count() == 89_999


def test_columns_are_compared_without_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Kept int, `a``b` int, `x.y` int, Other int")
    assert df.select(*common.prefixed(df)).select(*common.carried(df, ("kept", "OTHER"))).collect()[0].asDict() == {"a`b": 2, "x.y": 3}
