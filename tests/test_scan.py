import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slidewatch.functions import scan


def rows_with_hot_key(seed=1, n=1500):
    """A third of all rows on one key, many equal times."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        out.append((key, rng.randrange(400), i, float(rng.randrange(100))))
    return out


def frame(spark):
    return spark.createDataFrame(rows_with_hot_key(), "k string, t int, id int, v double")


def test_sliced_scans_equal_plain_windows(spark):
    df = frame(spark)
    slice_by = F.floor(F.col("t") / 25)
    w = Window.partitionBy("k").orderBy("t", "id")
    got = scan.running_total(df, ["k"], ["t", "id"], F.col("v"), slice_by, "total")
    got = scan.row_position(got, ["k"], ["t", "id"], slice_by, "pos")
    got = scan.previous_row(got, ["k"], ["t", "id"], ["id", "v"], slice_by, "before")
    got = scan.next_row(got, ["k"], ["t", "id"], ["id"], slice_by, "after")
    want = df.select(
        "*", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.row_number().over(w).cast("long").alias("pos"),
        F.lag(F.struct("id", "v")).over(w).alias("before"), F.lead(F.struct("id")).over(w).alias("after"),
    )
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_window_sees_the_whole_hot_key(spark):
    df = frame(spark).withColumn("s", F.floor(F.col("t") / 25))
    biggest = df.groupBy("k", "s").count().agg(F.max("count")).first()[0]
    assert biggest < 0.15 * df.where("k = 'hot'").count()


def test_decimals_keep_their_scale(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(40)], "k string, t int, id int")
    cost = F.lit("0.0000000123").cast("decimal(28,10)")
    got = scan.running_total(df, ["k"], ["t", "id"], cost, F.floor(F.col("t") / 7), "total")
    assert str(got.agg(F.max("total")).first()[0]) == "4.920E-7"


def test_rank_with_ties_nulls_and_one_value(spark):
    rng = random.Random(2)
    rows = [(f"SEG-{i:07d}", rng.choice([5.0, 5.0, 5.0, float(rng.randrange(1000)), None])) for i in range(800)]
    df = spark.createDataFrame(rows, "segment_id string, risk double")
    got = scan.rank_by_value(df, "risk", "segment_id", "r", partitions=5)
    w = Window.orderBy(F.col("risk").desc_nulls_last(), F.col("segment_id").asc())
    want = df.withColumn("r", F.row_number().over(w).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    same = df.withColumn("risk", F.lit(1.0))
    got = scan.rank_by_value(same, "risk", "segment_id", "r")
    assert [r["segment_id"] for r in got.orderBy("r").collect()] == sorted(r[0] for r in rows)


def test_one_outlier_does_not_put_all_rows_into_one_range(spark):
    df = spark.range(20000).selectExpr("cast(id as string) as segment_id", "if(id = 7, 1e12, cast(id % 1000 as double)) as risk")
    got = scan.rank_by_value(df, "risk", "segment_id", "r", partitions=16)
    assert got.agg(F.max("r"), F.countDistinct("r")).first()[:] == (20000, 20000)
    sizes = df.repartitionByRange(16, F.col("risk").desc_nulls_last(), F.col("segment_id")).groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 20000 / 5


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "segment_id string, risk double")
    assert scan.rank_by_value(empty, "risk", "segment_id", "r").count() == 0
