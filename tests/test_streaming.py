import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slidewatch.operators import cdc, silver, usage
from slidewatch.plans.sample_data import GATEWAYS, Tables
from slidewatch.session import work_path
from slidewatch.sources import versions
from slidewatch.streaming import keyed, log, mirror, rollups, stateful
from tests.test_decisions import T0, check_move, random_log


def land(df, path, order, files):
    """Writes ``files`` parquet files one after the other, in order, so that each becomes its own micro-batch."""
    ordered = df.withColumn("_slot", F.ntile(files).over(Window.orderBy(*order)))
    for i in range(1, files + 1):
        ordered.where(F.col("_slot") == i).drop("_slot").coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_daily_rollup_over_many_batches_equals_batch(spark, tables, tmp_path):
    path = f"{tmp_path}/in"
    land(tables.raw("events"), path, ["event_id"], 5)
    stream = rollups.file_stream(spark, path, tables.raw("events").schema, files_per_trigger=1)
    out = f"{tmp_path}/out"
    log.run_available(rollups.stream_silver_events(Tables.sessions(stream)), out, f"{tmp_path}/c")
    got = log.read_latest(spark, out, rollups.SILVER_SCHEMA, ["segment_id", "event_date"])
    columns = ["segment_id", "event_date", "sessions", "conversions"]
    want = silver.silver_events(tables.events, tables.segments)
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert log.read_log(spark, out, rollups.SILVER_SCHEMA).agg(F.countDistinct("batch")).first()[0] > 1


def test_each_batch_joins_the_segments_of_its_time(spark, tmp_path):
    """A renamed segment shows its new columns from the next batch on; a day that came before its segment gets them when read."""
    schema = "segment_id string, event_time timestamp, converted boolean, revenue_usd double"
    now = {"rows": [("a", "old", "ios", "eu")]}
    segments = lambda session: session.createDataFrame(now["rows"], "segment_id string, cohort string, platform string, region string")
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [[("a", T0, True, 1.0), ("b", T0, False, 0.0)], [("a", T0 + datetime.timedelta(days=1), False, 0.0)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = rollups.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
        rollups.run_silver_events(rollups.stream_silver_events(stream), segments, out, f"{tmp_path}/c")
        now["rows"] = [("a", "new", "ios", "eu"), ("b", "late", "web", "us")]
    got = rollups.read_silver_events(spark, out, segments(spark))
    assert sorted((r["segment_id"], r["event_date"].day, r["cohort"], r["conversion_rate"]) for r in got.collect()) == [
        ("a", 1, "old", 1.0), ("a", 2, "new", 0.0), ("b", 1, "late", 0.0),
    ]


def test_hourly_usage_over_many_batches_equals_batch(spark, tables, tmp_path):
    path = f"{tmp_path}/in"
    land(tables.raw("events"), path, ["event_id"], 3)
    stream = rollups.file_stream(spark, path, tables.raw("events").schema, files_per_trigger=1)
    base = usage.usage_base(Tables.usage_rows(stream), GATEWAYS)
    out = f"{tmp_path}/out"
    log.run_available(rollups.stream_usage_hourly(mirror.as_ltz(base, "event_time")), out, f"{tmp_path}/c")
    got = log.read_latest(spark, out, rollups.HOURLY_SCHEMA, ["hour", "gateway"])
    got = got.select("gateway", F.col("hour").cast("string").alias("hour"), "total_tokens", "requests", F.round("cost", 6).cast("double").alias("est_cost_usd"))
    want = usage.usage_hourly(tables.usage_base).withColumn("hour", F.col("hour").cast("string")).select(got.columns)
    assert rows(got) == rows(want)


def test_decision_state_survives_batches_and_restarts(spark, tables, tmp_path):
    """The second run starts from the checkpoint of the first."""
    path, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c"
    events = tables.decision_events
    early, late = events.where("event_id < 400"), events.where("event_id >= 400")
    for part in (early, late):
        land(part, path, ["event_id"], 2)
        stream = rollups.file_stream(spark, path, events.schema, files_per_trigger=1)
        stateful.stream_decisions(stream, out, checkpoint, buckets=3)
    got = log.read_log(spark, out, stateful.DECISION_OUTPUT)
    assert got.select("batch").distinct().count() == 4
    from slidewatch.operators.decisions import life_cycle

    columns = ["decision_id", "event_id", "action", "valid", "status", "reason"]
    assert rows(got.select(columns)) == rows(life_cycle(events).select(columns))


def test_decisions_apply_in_order_of_arrival(spark, tmp_path):
    """A hot decision, late events and missing approvers, against a step-by-step walk of batch after batch; then expiry."""
    events = random_log(7, 900)
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "decision_id string, at timestamp, event_id bigint, action string, by string, rollout_pct int"
    state, want = {}, []
    for k in range(3):
        part = events[k * 300 : (k + 1) * 300]
        spark.createDataFrame([(r[0], r[2], r[3], r[5], r[4], r[9]) for r in part], schema).coalesce(1).write.mode("append").parquet(path)
        stream = rollups.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
        stateful.stream_decisions(stream, out, f"{tmp_path}/c", buckets=2)
        for r in sorted(part, key=lambda r: (r[0], r[2], r[3])):
            status, approver, reason = check_move(*state.get(r[0], ("none", None)), r[5], r[4], r[9])
            state[r[0]] = (status, approver)
            want.append((r[3], status, reason))
    got = log.read_log(spark, out, stateful.DECISION_OUTPUT)
    assert sorted((r["event_id"], r["status"], r["reason"]) for r in got.collect()) == sorted(want)
    kept = {r["decision_id"]: (r["status"], r["approver"]) for r in stateful.decision_table(spark, out, 2).read().collect()}
    assert kept == state

    late = T0 + datetime.timedelta(days=400)
    done = sorted(d for d, (status, _) in state.items() if status == "committed")[:2]
    open_ = sorted(d for d, (status, _) in state.items() if status == "proposed")[:1]
    rows_ = [(d, late, 10_000 + k, "proposed", "ana", 50) for k, d in enumerate([*done, *open_])]
    spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
    stream = rollups.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    stateful.stream_decisions(stream, out, f"{tmp_path}/c", buckets=2)
    got = log.read_log(spark, out, stateful.DECISION_OUTPUT).where("event_id >= 10000")
    assert done and open_
    assert {r["decision_id"]: r["valid"] for r in got.collect()} == {**{d: True for d in done}, **{d: False for d in open_}}


def test_state_streams_run_no_python(spark, tables, tmp_path, capsys):
    from slidewatch.operators.decisions import life_cycle

    events = tables.decision_events.select("decision_id", "at", "event_id", "action", "by", "rollout_pct").withColumn("stored", F.lit(False))
    led = stateful._led(spark.createDataFrame([("d", "approved", "ana", T0)], stateful.DECISION_STATE), "timestamp_ntz")
    life_cycle(events.unionByName(led)).explain()
    assert "Python" not in capsys.readouterr().out and [r["action"] for r in led.orderBy("event_id").collect()] == ["proposed", "approved"]


def test_budget_alerts_over_batches_equal_batch(spark, tables, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(tables.raw("events"), path, ["event_id"], 3)
    stream = rollups.file_stream(spark, path, tables.raw("events").schema, files_per_trigger=1)
    base = mirror.as_ltz(usage.usage_base(Tables.usage_rows(stream), GATEWAYS), "event_time")
    stateful.stream_budget_alerts(base, {"alert": 0.03, "block": 0.05}, out, f"{tmp_path}/c", buckets=3)
    assert stateful.spent_table(spark, out, 3).version() == 2
    got = log.read_log(spark, out, stateful.BUDGET_OUTPUT)
    states = usage.budget_state(tables.usage_base)
    want = states.where("alert_request_id IS NOT NULL").select("requester", F.lit("alert").alias("limit_name"), F.col("alert_request_id").alias("request_id"))
    want = want.unionByName(states.where("blocked_request_id IS NOT NULL").select("requester", F.lit("block").alias("limit_name"), F.col("blocked_request_id").alias("request_id")))
    assert want.count() > 0
    assert rows(got.select(want.columns)) == rows(want)


def change_rows(spark, seed=8, n=400):
    rng, t0 = random.Random(seed), datetime.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(30)}"
        kind = rng.choice(["insert", "update_preimage", "update_postimage", "update_postimage", "delete"])
        data.append((key, kind, i, 0, t0 + datetime.timedelta(minutes=i), f"s{i}"))
    return spark.createDataFrame(data, "k string, _pg_change_type string, _pg_lsn bigint, _sort_by int, _timestamp timestamp, status string")


def test_mirror_follows_a_shuffled_feed(spark, tmp_path):
    changes = change_rows(spark)
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(changes.unionByName(changes), path, [F.xxhash64("_pg_lsn", "status")], 4)
    stream = rollups.file_stream(spark, path, changes.schema, files_per_trigger=1)
    mirror.sync_changes(stream, "k", out, f"{tmp_path}/c")
    want = rows(cdc.current_from_cdc(changes, "k"))
    assert rows(mirror.read_mirror(spark, out, changes.schema, "k")) == want
    assert rows(mirror.compact_mirror(spark, out, changes.schema, "k", f"{tmp_path}/plain")) == want


def test_a_mirror_stays_small_and_takes_a_batch_once(spark, tmp_path):
    """Twenty batches with a hot key: few runs a bucket, rows as many as keys, replays and torn batches without effect."""
    changes = change_rows(spark, n=600)
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(changes, path, [F.xxhash64("_pg_lsn", "status")], 20)
    stream = rollups.file_stream(spark, path, changes.schema, files_per_trigger=1)
    mirror.sync_changes(stream, "k", out, f"{tmp_path}/c", buckets=4, most_runs=3)
    table = mirror.mirror_table(spark, out, changes.schema, "k", 4, 3)
    want = rows(cdc.current_from_cdc(changes, "k"))
    read = lambda: rows(mirror.read_mirror(spark, out, changes.schema, "k", 4, 3))
    assert table.version() == 19 and read() == want
    assert all(len(r) <= 3 for r in table.runs().values())
    assert table.raw().count() <= 3 * changes.select("k").distinct().count()

    before = table.runs()
    for number in (19, 3):
        table.merge(mirror.newest_changes(change_rows(spark, seed=9), "k"), number)
    assert table.runs() == before and read() == want
    # A batch that was torn off before its manifest leaves the former version; written again, it counts once.
    table._write(table.fold(changes.withColumn("_version", F.lit(20).cast("long"))), "20")
    assert table.version() == 19 and read() == want
    table.merge(mirror.newest_changes(changes, "k"), 20)
    assert table.version() == 20 and read() == want

    gone = table.clean(keep_versions=1)
    assert gone and read() == want
    assert {n.removeprefix("run=") for n in versions.names_in(spark, f"{out}/rows")} == {r for own in table.runs().values() for r in own}


def test_deletes_are_forgotten_only_where_told(spark, tmp_path):
    schema = "k string, _pg_change_type string, _pg_lsn bigint, _sort_by int, _timestamp timestamp, status string"
    batches = [[("a", "insert", 1), ("b", "insert", 2)], [("a", "delete", 3)], [("b", "update_postimage", 500)], [("a", "update_postimage", 2)]]
    for keep, want in ((None, ["b"]), (100, ["a", "b"])):
        out = f"{tmp_path}/out{keep}"
        path = f"{tmp_path}/in{keep}"
        for k, batch in enumerate(batches):
            data = [(key, kind, lsn, 0, T0, f"s{lsn}") for key, kind, lsn in batch]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
            stream = rollups.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
            mirror.sync_changes(stream, "k", out, f"{tmp_path}/c{keep}", buckets=1, most_runs=1, keep_deletes=keep)
        got = mirror.read_mirror(spark, out, stream.schema, "k", 1, 1)
        assert sorted(r["k"] for r in got.collect()) == want


def test_sums_of_a_keyed_table(spark, tmp_path):
    keys = ["requester", "epoch"]
    table = keyed.KeyedTable(spark, f"{tmp_path}/t", stateful.SPENT, keys, keyed.summed(keys, ["units"]), ["requester"], 2, 2)
    assert table.version() is None and table.read().count() == 0
    for number in range(5):
        table.merge(spark.createDataFrame([("r", T0, number), ("r", T0, 1), ("s", T0, 1)], stateful.SPENT), number)
        table.merge(spark.createDataFrame([("r", T0, 100)], stateful.SPENT), number)
    table.merge(spark.createDataFrame([], stateful.SPENT), 9)
    assert sorted((r["requester"], r["units"]) for r in table.read().collect()) == [("r", 15), ("s", 5)] and table.version() == 9


def test_batches_overwrite_themselves(spark, tmp_path):
    write = log.batch_writer(f"{tmp_path}/log")
    for _ in range(2):
        write(spark.range(5), 0)
    write(spark.range(5, 7), 1)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 7


def test_history_follows_late_and_repeated_changes(spark, tmp_path):
    """In order, shuffled, and delivered twice: always the history of all changes, from intervals that are stored."""
    changes = change_rows(spark)
    want = rows(cdc.scd2(changes, "k"))
    slices = F.floor(F.col("_pg_lsn") / 50)
    for name, order in (("in_order", ["_pg_lsn"]), ("late", [F.xxhash64("_pg_lsn", "status")])):
        path, out = f"{tmp_path}/in-{name}", f"{tmp_path}/out-{name}"
        land(changes.unionByName(changes), path, order, 4)
        stream = rollups.file_stream(spark, path, changes.schema, files_per_trigger=1)
        mirror.stream_cdc_history(stream, out, f"{tmp_path}/c-{name}", "k", slices, buckets=2, most_runs=2)
        got = mirror.read_history(spark, out, changes.schema, "k", 2, 2)
        assert rows(got.select(*cdc.scd2(changes, "k").columns)) == want


def test_history_writes_only_the_intervals_a_batch_touches(spark, tmp_path):
    changes = change_rows(spark, n=300)
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first, tail = changes.where("_pg_lsn < 295"), changes.where("_pg_lsn >= 295")
    for part in (first, tail, tail):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = rollups.file_stream(spark, path, changes.schema, files_per_trigger=1)
        mirror.stream_cdc_history(stream, out, f"{tmp_path}/c", "k", buckets=1, most_runs=9)
    written = [spark.read.schema(mirror.history_table(spark, out, changes.schema, "k", 1, 9).schema).parquet(f"{out}/rows/run={n}").count() for n in range(2)]
    new = cdc.images(tail).count()
    assert written[0] == cdc.images(first).count() and new <= written[1] <= new + tail.select("k").distinct().count()
    # The repeated batch has nothing to write.
    assert mirror.history_table(spark, out, changes.schema, "k", 1, 9).version() == 2
    assert not [n for n in versions.names_in(spark, f"{out}/rows/run=2") if n.startswith("bucket=")]


def test_a_batch_of_history_is_shuffled_once_for_its_scan_and_not_folded_again(spark, tmp_path, monkeypatch):
    folds, scans = [], []
    make, scan = keyed.newest, mirror.next_row
    monkeypatch.setattr(keyed, "newest", lambda *a: lambda rows: folds.append(1) or make(*a)(rows))

    def next_row(*args):
        out = scan(*args)
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
        return out

    monkeypatch.setattr(mirror, "next_row", next_row)
    changes = change_rows(spark, n=60)
    changes.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rollups.file_stream(spark, f"{tmp_path}/in", changes.schema, files_per_trigger=1)
    mirror.stream_cdc_history(stream, f"{tmp_path}/out", f"{tmp_path}/c", "k", buckets=2)
    assert not folds and scans == [0]  # what is shuffled is held, so no use of it asks for a shuffle of its own


def test_nothing_available_gives_an_empty_result(spark, tables):
    path = work_path(spark, "empty")
    tables.raw("events").where(F.lit(False)).write.parquet(path)
    stream = rollups.file_stream(spark, path, tables.raw("events").schema)
    out = work_path(spark, "empty-out")
    log.run_available(rollups.stream_silver_events(Tables.sessions(stream)), out, work_path(spark, "c"))
    assert log.read_latest(spark, out, rollups.SILVER_SCHEMA, ["segment_id", "event_date"]).count() == 0
