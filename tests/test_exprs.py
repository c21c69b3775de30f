import datetime

import pytest
from pyspark.sql import functions as F

from slidewatch.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_at_risk_of_the_reference_case(spark):
    got = value(spark, X.at_risk(F.lit(420000), F.lit(0.013), F.lit("sliding")))
    assert got == pytest.approx(524160.0)
    assert value(spark, X.at_risk(F.lit(420000), F.lit(0.013), F.lit("healthy"))) == 0.0


def test_net_value_of_the_reference_case(spark):
    got = value(spark, X.net_value(F.lit(0.018012460321187973), F.lit(420000), F.lit(5000.0)))
    assert got == pytest.approx(721262.4001502991, abs=1e-9)


def test_rollout_forecast(spark):
    assert value(spark, X.rollout_forecast(F.lit(0.03), F.lit(0.02), F.lit(25))) == pytest.approx(0.035)


@pytest.mark.parametrize(
    ("drop", "rate", "band"),
    [(0.01, 0.0319, "sliding"), (0.01, 0.032, "watch"), (0.0099, 0.01, "watch"), (0.005, 0.9, "watch"), (0.0049, 0.0, "healthy"), (-1.0, 0.0, "healthy")],
)
def test_bands_at_their_edges(spark, drop, rate, band):
    assert value(spark, X.conv_band(F.lit(drop), F.lit(rate))) == band


def test_drop_is_rounded_before_banding(spark):
    drop = X.conversion_drop(F.lit(0.042), F.lit(0.032))  # 0.010000000000000002 - noise either way
    assert value(spark, drop) == 0.01


def test_every_drop_and_rate_has_one_band(spark):
    grid = spark.range(0, 60).selectExpr("id / 2000.0 - 0.005 AS d").crossJoin(spark.range(0, 50).selectExpr("id / 1000.0 AS r"))
    bands = {r["b"] for r in grid.select(X.conv_band("d", "r").alias("b")).distinct().collect()}
    assert bands == {"sliding", "watch", "healthy"}


def test_long_numbers_keep_their_digits(spark):
    assert value(spark, X.format_id("SEG-", F.lit(214), 7)) == "SEG-0000214"
    assert value(spark, X.format_id("SEG-", F.lit(1234567890), 7)) == "SEG-1234567890"


def test_ramp_runs_from_start_to_end(spark):
    got = [value(spark, X.ramp(F.lit(d), 14, 0.042, -0.013)) for d in (13, 0)]
    assert got == [0.042, 0.029]


def test_percentage_guards_zero_and_null(spark):
    assert value(spark, X.percentage(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, X.percentage(F.lit(3), F.lit(None))) == 0.0
    assert value(spark, X.percentage(F.lit(1), F.lit(3))) == 33.3


def test_numeric_text(spark):
    cells = spark.createDataFrame([("12",), ("-3.5",), ("1e5",), ("2024-01-01",), ("",), (None,), ("7.",)], "c string")
    got = [r["c_num"] for r in X.coerce_numeric(cells, ["c"]).collect()]
    assert got == [12.0, -3.5, None, None, None, None, None]


def test_bounded():
    assert [X.bounded(n, 40) for n in (-3, 0, 1, 40, 400)] == [1, 1, 1, 40, 40]


def test_texts(spark):
    text = X.experiment_description(F.lit("checkout"), F.lit("variant_a"), F.lit("gen_z"), F.lit("android"), F.lit(True), F.lit(0.0225))
    assert value(spark, text).startswith("Experiment on the checkout flow, variant_a, tested on gen_z / android. WON: lifted conversion by 2.25 points.")
    assert value(spark, X.experiment_name(F.lit("checkout"), F.lit("variant_a"), F.lit("gen_z"))) == "Checkout variant_a [gen_z]"


def test_days_before_and_choices(spark):
    assert value(spark, X.days_before(F.lit("2024-03-01").cast("date"), F.lit(1))) == datetime.date(2024, 2, 29)
    assert value(spark, X.pick(["x", "y"], F.lit(1))) == "y"
    assert value(spark, X.case_assign([(F.lit(False), "a"), (F.lit(True), "b")], "c")) == "b"
    assert value(spark, X.in_set(F.lit(3), [1, 3])) is True
