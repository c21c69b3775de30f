import pytest
from pyspark.sql import functions as F

from slidewatch import session
from slidewatch.sources import versions
from slidewatch import session
from slidewatch.functions.schema import struct
from slidewatch.operators import quality
from slidewatch.sources import named_queries, tables

SCHEMA = struct(k="string", v="long")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_raw_names(spark, tmp_path):
    assert tables.raw_path("/data/", "raw_events", ".parquet") == "/data/events.parquet"
    row = tables.save_verified(frame(spark, [("a", 1), ("b", 2)]), f"{tmp_path}/events").first()
    assert row["row_count"] == 2
    assert tables.read_raw(spark, str(tmp_path), "raw_events", SCHEMA).count() == 2


@pytest.mark.parametrize("rows", [[("a", 1), ("a", 2)], [("a", 1), (None, 2)]])
def test_publish_refuses_bad_keys(spark, tmp_path, rows):
    with pytest.raises(ValueError, match="values of k"):
        tables.publish(frame(spark, rows), f"{tmp_path}/t", {"k": None, "v": None}, "k")


def test_publish_projects_and_casts(spark, tmp_path):
    out = tables.publish(frame(spark, [("a", 1)]), f"{tmp_path}/t", {"k": None, "v": "double"}, "k")
    assert out.dtypes == [("k", "string"), ("v", "double")]


def test_sync_once_and_append(spark, tmp_path):
    path = f"{tmp_path}/mirror"
    assert tables.sync_once(frame(spark, []), path) is True
    assert tables.sync_once(frame(spark, [("a", 1)]), path) is True  # still empty
    assert tables.sync_once(frame(spark, [("b", 1)]), path) is False
    out = tables.append_new(frame(spark, [("a", 9), ("b", 2), ("b", 2)]), path, "k")
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2)]
    assert tables.sync_once(frame(spark, [("z", 0)]), path, force=True) is True
    assert spark.read.parquet(path).count() == 1


def test_optional_source(spark, tmp_path):
    assert tables.read_optional(spark, f"{tmp_path}/missing", SCHEMA).count() == 0
    assert tables.read_optional(spark, "no_such_table", SCHEMA).dtypes == [("k", "string"), ("v", "bigint")]


def test_reset_empties_decisions_and_fills_mirrors(spark, tmp_path):
    decisions, mirror = f"{tmp_path}/decisions", f"{tmp_path}/mirror"
    frame(spark, [("d", 1)]).write.parquet(decisions)
    frame(spark, [("old", 1)]).write.parquet(mirror)
    assert tables.reset_mirrors(spark, {"m": frame(spark, [("new", 1)])}, {"m": mirror}, decisions, SCHEMA) == ["m"]
    assert spark.read.schema(SCHEMA).parquet(decisions).count() == 0
    assert [r["k"] for r in spark.read.parquet(mirror).collect()] == ["new"]


def test_named_queries_are_a_closed_list(spark):
    with pytest.raises(KeyError):
        named_queries.run_query(spark, "drop_everything")
    spark.createDataFrame([("ring", 2.0), ("ring", 3.0)], "product_name string, refund_amount_usd double").createOrReplaceTempView("silver_returns")
    assert named_queries.run_query(spark, "returns_by_product").first()["total_refund_usd"] == 5.0


def test_the_shared_folder_is_that_of_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert session.work_root(spark) == root and session.work_path(spark, "x").startswith(root)
    assert session.work_path(spark, "x") != session.work_path(spark, "x")


def test_key_and_orphan_checks(spark):
    bad = frame(spark, [("a", 1), ("a", 2), (None, 3)])
    assert tuple(quality.check_keys(bad, "k").first()) == ("unique_k", False, 2.0)
    parent = frame(spark, [("b", 1)])
    assert tuple(quality.check_orphans(bad, parent, "k").first()) == ("orphans_k", False, 2.0)
    assert quality.check_orphans(parent, parent, "k").first()["passed"] is True
    assert quality.check_keys(frame(spark, []), "k").first()["passed"] is True


def test_checks_on_an_empty_position(tables):
    empty = tables.position.where(F.lit(False))
    names = [quality.check_domains(empty), quality.check_signal(empty), quality.check_reconcile(empty)]
    assert all(df.count() == 1 for df in names)
    assert quality.check_domains(empty).first()["passed"] is False


def test_a_failed_version_leaves_the_former_one_readable(spark, tmp_path):
    root = f"{tmp_path}/serving"
    rows = lambda *ids: spark.createDataFrame([(i, f"v{k}") for k, i in enumerate(ids)], "id string, v string")
    columns = {"id": None, "v": None}
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root)
    assert versions.publish_version(rows("a", "b"), root, columns, "id").count() == 2
    for bad in (rows("a", "a"), rows("a", None)):
        with pytest.raises(ValueError):
            versions.publish_version(bad, root, columns, "id")
        assert versions.read_version(spark, root).count() == 2
    # A write that was torn off is data without a pointer, and its number is not used again.
    rows("x").write.parquet(f"{root}/data/v=7")
    assert versions.read_version(spark, root).count() == 2
    versions.publish_version(rows("a", "b", "c"), root, {"id": "string"}, "id")
    assert versions.read_version(spark, root).columns == ["id"] and versions.read_version(spark, root, 0).count() == 2
    assert list(versions.published(spark, root)) == [0, 8]
    # A pointer without the mark of a finished write is not followed.
    spark.range(1).write.parquet(f"{root}/live/v=9")
    versions.remove(spark, f"{root}/live/v=9/_SUCCESS")
    assert versions.read_version(spark, root).count() == 3


def test_a_cluster_needs_a_shared_folder():
    assert session.shared_root("hdfs://a/c", "file:/w", "yarn") == "hdfs://a/c"
    assert session.shared_root(None, "hdfs://a/w/", "yarn") == "hdfs://a/w/slidewatch-work"
    assert session.shared_root(None, "file:/w", "local[4]") == "file:/w/slidewatch-work"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError):
            session.shared_root(None, warehouse, "spark://host:7077")
