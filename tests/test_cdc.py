import datetime

from pyspark.sql import functions as F

from slidewatch.operators import cdc

SCHEMA = "k string, _pg_change_type string, _pg_lsn bigint, _sort_by int, _timestamp timestamp_ntz, status string"


def ts(ms):
    return datetime.datetime(2026, 8, 27, 5, 19, 47, ms * 1000)


def changes(spark):
    return spark.createDataFrame(
        [
            ("C", "insert", 35930432, 0, ts(391), "proposed"),
            ("C", "update_preimage", 35931312, 1, ts(395), "proposed"),
            ("C", "update_postimage", 35931312, 2, ts(395), "approved"),
            ("D", "insert", 35930000, 0, ts(100), "proposed"),
            ("D", "delete", 35990000, 0, ts(200), "proposed"),
            ("D", "insert", 35990001, 0, ts(300), "again"),
            ("E", "insert", 35930001, 0, ts(100), "proposed"),
            ("E", "delete", 39930001, 0, ts(150), "proposed"),
        ],
        SCHEMA,
    )


def test_history_of_the_captured_case(spark):
    rows = cdc.scd2(changes(spark), "k").where("k = 'C'").orderBy("_pg_lsn").collect()
    assert [(r["status"], r["valid_from"], r["valid_to"], r["is_current"]) for r in rows] == [
        ("proposed", ts(391), ts(395), False), ("approved", ts(395), None, True),
    ]


def test_delete_closes_a_version(spark):
    rows = cdc.scd2(changes(spark), "k", F.floor(F.col("_pg_lsn") / 10)).where("k <> 'C'").orderBy("k", "_pg_lsn").collect()
    assert [(r["k"], r["status"], r["valid_to"], r["is_current"]) for r in rows] == [
        ("D", "proposed", ts(200), False), ("D", "again", None, True), ("E", "proposed", ts(150), False),
    ]


def test_current_and_as_of(spark):
    current = {(r["k"], r["status"]) for r in cdc.current_from_cdc(changes(spark), "k").collect()}
    assert current == {("C", "approved"), ("D", "again")}
    history = cdc.scd2(changes(spark), "k")
    at = lambda t: {(r["k"], r["status"]) for r in cdc.state_as_of(history, t.isoformat(" ")).collect()}
    assert at(ts(150)) == {("D", "proposed")}
    assert at(ts(395)) == {("C", "approved"), ("D", "again")}
    assert at(ts(50)) == set()


def test_versions_of_a_key_never_overlap(spark, tables):
    history = cdc.scd2(tables.changes, "business_key", F.floor(F.col("_pg_lsn") / (10**12 * 30)))
    a, b = history.alias("a"), history.alias("b")
    clash = a.join(
        b,
        (F.col("a.business_key") == F.col("b.business_key")) & (F.col("a._pg_lsn") < F.col("b._pg_lsn"))
        & (F.col("a.valid_to").isNull() | (F.col("a.valid_to") > F.col("b.valid_from"))),
    )
    assert clash.count() == 0
