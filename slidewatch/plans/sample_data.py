"""Maps the given star-schema tables onto the growth data model.

Every rule is deterministic and covers whole tables. Dates are taken from the data's event month; see DATA_MODEL.md.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidewatch.functions import exprs as X
from slidewatch.functions.scan import previous_row
from slidewatch.operators import decisions as D
from slidewatch.operators import gold, silver
from slidewatch.operators.usage import usage_base
from slidewatch.session import apply_settings, work_path
from slidewatch.settings import ACTIONS, FEATURE_AREAS, NOTE_LABELS, PLATFORMS, BandRule

DAY0 = "2024-01-01"
AS_OF = "2024-01-30"
ANCHOR = "2024-01-31"
SCORED_AT = "2024-02-01 00:00:00"
SNAPSHOT_DAYS = 10
BANDS = BandRule(sliding_drop=0.10, sliding_rate=0.15, watch_drop=0.05)
COHORTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
GATEWAYS = {"svc.app_gateway": "App Gateway", "svc.coding_agent_gateway": "Coding Agent Gateway"}


def slot(n: Column) -> Column:
    return n.cast("int")


# Paths of tables written by this application: (application, data folder, table) -> path.
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Tables:
    """Frames of the data model over one data folder.

    Raw and silver frames are lazy. Tables that many jobs read (silver rollups, gold, decisions) are written once
    per application to the shared work folder and read back from there, as a serving layer would: later jobs start
    from the small table, not from the raw events, and a lost executor costs no recomputation of the chain.
    """

    def __init__(self, spark: SparkSession, folder: str):
        apply_settings(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")

    def written(self, name: str, build: Callable[[], DataFrame], cluster_by: str | None = None) -> DataFrame:
        """The table of that name; rows are laid out by ``cluster_by`` so that filters on it skip files."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            df = build()
            if cluster_by is not None:
                df = df.repartitionByRange(cluster_by, "segment_id").sortWithinPartitions(cluster_by)
            path = work_path(self.spark, name)
            df.write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- growth tables -------------------------------------------------------------------------------------------

    @cached_property
    def segments(self) -> DataFrame:
        key = F.col("c_custkey")
        platform = X.pick(PLATFORMS, F.col("c_nationkey") % 3)
        nations = self.raw("nation").select("n_nationkey", "n_regionkey")
        regions = self.raw("region").select("r_regionkey", "r_name")
        rows = (
            self.raw("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return rows.select(
            key.alias("user_id"),
            X.format_id("SEG-", key + 1, 7).alias("segment_id"),
            F.col("c_mktsegment").alias("cohort"),
            platform.alias("platform"),
            F.col("r_name").alias("region"),
            (20000 + (key * 7919) % 400000).cast("int").alias("mau"),
            X.segment_summary(F.col("c_mktsegment"), platform, F.col("r_name"), key % 3 == 0).alias("segment_summary"),
            F.lit(True).alias("is_active"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.sessions(self.raw("events"))

    @staticmethod
    def sessions(events: DataFrame) -> DataFrame:
        bought = F.col("event_type") == "purchase"
        return events.select(
            X.format_id("SEG-", F.col("user_id") + 1, 7).alias("segment_id"),
            F.to_date("ts").alias("event_date"),
            F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("session_id"),
            bought.alias("converted"),
            F.when(bought, F.col("value")).otherwise(F.lit(0.0)).alias("revenue_usd"),
            F.col("ts").cast("timestamp").alias("event_time"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """One snapshot per user and ten days, dated on the tenth. The rate is rounded in whole numbers."""
        bucket = F.floor(F.datediff(F.to_date("ts"), F.lit(DAY0).cast("date")) / SNAPSHOT_DAYS)
        counted = (
            self.raw("events")
            .select("user_id", bucket.alias("b"), (F.col("event_type") == "purchase").cast("long").alias("p"))
            .groupBy("user_id", "b")
            .agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
        )
        note = slot((F.col("user_id") * 5 + F.col("b") * 3) % 8)
        phrases = F.array(*[F.lit(x) for x in NOTE_LABELS], F.lit(None).cast("string"))
        return counted.select(
            X.format_id("SEG-", F.col("user_id") + 1, 7).alias("segment_id"),
            F.date_add(F.lit(DAY0).cast("date"), (F.col("b") * SNAPSHOT_DAYS + SNAPSHOT_DAYS - 1).cast("int")).alias("snapshot_date"),
            (F.expr("(20000 * p + n) div (2 * n)") / 10000.0).alias("conversion_rate"),
            F.col("n").cast("int").alias("sessions"),
            F.element_at(phrases, note + 1).alias("pm_note_text"),
        )

    @cached_property
    def experiments(self) -> DataFrame:
        key = F.col("p_partkey")
        area = X.pick(FEATURE_AREAS, key % 4)
        variant = F.concat(F.lit("variant_"), X.pick(["a", "b", "c"], key % 3))
        cohort = X.pick(COHORTS, key % 5)
        platform = X.pick(PLATFORMS, F.floor(key / 5) % 3)
        won = (F.col("p_size") <= 22) & (platform != "web")
        lift = F.when(won, F.col("p_size") / 1000.0).otherwise(F.lit(-0.002))
        rows = self.raw("part").select(
            X.format_id("EXP-", key + 1, 7).alias("experiment_id"),
            variant.alias("variant"), area.alias("feature_area"), cohort.alias("tested_cohort"),
            platform.alias("tested_platform"), won.alias("won"), lift.alias("observed_lift"),
        )
        c = F.col
        return rows.select(
            "experiment_id",
            X.experiment_name(c("feature_area"), c("variant"), c("tested_cohort")).alias("experiment_name"),
            "variant", "feature_area", "tested_cohort", "tested_platform", "won", "observed_lift",
            X.experiment_description(
                c("feature_area"), c("variant"), c("tested_cohort"), c("tested_platform"), c("won"), c("observed_lift")
            ).alias("description"),
            F.lit(True).alias("is_active"),
        )

    @cached_property
    def flags(self) -> DataFrame:
        """Two generations of a flag per segment and area, made inside the row. A small file of segments is spread first."""
        places = F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(area).alias("feature_area"), F.lit(v).alias("v"))
              for a, area in enumerate(FEATURE_AREAS) for v in (0, 1)]
        )
        u, a, v = F.col("user_id"), F.col("a"), F.col("v")
        segments = self.segments.select("segment_id", "user_id").hint("rebalance", "segment_id")
        return segments.select("segment_id", "user_id", F.inline(places)).select(
            X.format_id("FLAG-", u * 8 + a * 2 + v + 1, 5).alias("flag_id"),
            "segment_id", "feature_area",
            F.concat("feature_area", F.lit("_flow")).alias("flag_key"),
            X.pick(["control", "variant_a", "variant_b"], (u + a + v) % 3).alias("variant"),
            X.pick([0, 25, 50, 100], (F.floor(u / 3) + a) % 4).alias("rollout_pct"),
            X.days_before(F.lit(ANCHOR).cast("date"), (u * (a + 1)) % 90 + v * 30).alias("updated_date"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Shipped items as experiment outcomes of the customer's segment."""
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        items = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_shipdate"
        )
        action = X.pick(ACTIONS, F.col("l_linenumber") % 3)
        matched = F.col("l_returnflag") == "R"
        bonus = F.when((F.col("l_linenumber") % 3 == 0) & matched, F.lit(0.012)).otherwise(F.lit(0.0))
        cost = F.when(F.col("l_linenumber") % 3 == 1, F.lit(500.0)).otherwise(F.lit(5000.0))
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            X.format_id("SEG-", F.col("o_custkey") + 1, 7).alias("segment_id"),
            action.alias("action_type"),
            matched.alias("had_matching_experiment"),
            F.round(0.025 + F.col("l_tax") / 10.0, 4).alias("conversion_at_action"),
            F.to_date("l_shipdate").alias("initiated_date"),
            cost.alias("ship_cost_usd"),
            F.round(F.col("l_discount") / 5.0 + bonus, 4).alias("conversion_lift"),
            (F.col("l_quantity") * 1000).cast("int").alias("users_recovered"),
        )

    # -- silver and gold -----------------------------------------------------------------------------------------

    @cached_property
    def notes(self) -> DataFrame:
        return silver.note_slide_flags(self.snapshots)

    @cached_property
    def silver_events(self) -> DataFrame:
        return silver.silver_events(self.events, self.segments)

    @cached_property
    def silver_conv(self) -> DataFrame:
        notes = self.written("note_flags", lambda: self.notes)
        return silver.silver_conv(self.snapshots, self.segments, notes)

    @cached_property
    def silver_flags(self) -> DataFrame:
        return silver.silver_flags(self.flags)

    @cached_property
    def silver_outcomes(self) -> DataFrame:
        return silver.silver_outcomes(self.outcomes, self.segments)

    @cached_property
    def daily(self) -> DataFrame:
        return self.written("silver_events", lambda: self.silver_events, "event_date")

    @cached_property
    def conv(self) -> DataFrame:
        return self.written("silver_conv", lambda: self.silver_conv, "snapshot_date")

    def build_position(self) -> DataFrame:
        return gold.segment_position(self.conv, self.daily, AS_OF, rule=BANDS)

    @cached_property
    def position(self) -> DataFrame:
        return self.written("gold_segment_position", self.build_position)

    def build_open(self) -> DataFrame:
        return gold.open_sliding(self.position, self.experiments, self.silver_flags, self.segments)

    @cached_property
    def open_rows(self) -> DataFrame:
        return self.written("gold_open_sliding", self.build_open)

    @cached_property
    def recs(self) -> DataFrame:
        return self.written("gold_action_recommendations", lambda: gold.recommendations(self.open_rows, SCORED_AT))

    # -- decisions -----------------------------------------------------------------------------------------------

    @cached_property
    def decision_events(self) -> DataFrame:
        """Events read as requests to move a decision; most requests are out of turn."""
        e = F.col("event_id")
        bucket = F.floor(F.datediff(F.to_date("ts"), F.lit(DAY0).cast("date")) / SNAPSHOT_DAYS).cast("string")
        kind = F.col("event_type")
        action = (
            F.when(kind == "signup", "investigating").when(kind == "error", "investigation_failed")
            .when(kind == "click", "approved").when(kind == "purchase", "committed")
            .when(e % 3 == 0, "redrafted").otherwise("proposed")
        )
        rows = self.raw("events").select(
            F.concat(F.lit("DEC-"), F.col("user_id").cast("string"), F.lit("-"), bucket).alias("decision_id"),
            X.format_id("SEG-", F.col("user_id") + 1, 7).alias("segment_id"),
            F.col("ts").alias("at"), "event_id",
            F.when(e % 11 != 0, F.concat(F.lit("user-"), (e % 5).cast("string"))).alias("by"),
            action.alias("action"), kind.alias("notes"),
            F.concat(F.lit("decision_"), action).alias("tool"),
            F.concat(F.lit("run-"), e.cast("string")).alias("assist_run_id"),
            (e % 103).cast("int").alias("rollout_pct"),
            X.pick(ACTIONS, e % 3).alias("action_type"),
            X.format_id("EXP-", e % 50 + 1, 7).alias("target_experiment_id"),
            F.lit("checkout_flow").alias("flag_key"),
            F.concat(F.lit("variant_"), X.pick(["a", "b", "c"], e % 3)).alias("variant"),
            F.concat(F.lit("note "), e.cast("string")).alias("drafted_note"),
            ((e % 40) / 1000.0).alias("predicted_conversion_lift"),
        )
        return rows

    @cached_property
    def valid_events(self) -> DataFrame:
        return self.written("accepted_events", lambda: D.split_transitions(self.decision_events)[0])

    @cached_property
    def decisions(self) -> DataFrame:
        return self.written("feature_decisions", lambda: D.fold_decisions(self.valid_events))

    @cached_property
    def trails(self) -> DataFrame:
        return D.audit_trail(self.valid_events)

    def live(self, segment_id: str | None = None, limit: int | None = D.LIVE_PAGE) -> DataFrame:
        return D.live_view(self.position, self.open_rows, self.recs, self.decisions, segment_id, limit)

    @cached_property
    def changes(self) -> DataFrame:
        """Orders as row changes of their customer: the first inserts, later ones update, cancelled ones delete."""
        lsn = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 10**12 + F.col("o_orderkey")
        orders = self.raw("orders").select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("business_key"),
            lsn.alias("_pg_lsn"), F.col("o_orderkey").alias("_pg_xid"), F.col("o_orderdate").alias("_timestamp"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
        )
        with_previous = previous_row(
            orders, ["business_key"], ["_pg_lsn"], ["status", "amount"], F.floor(F.col("_pg_lsn") / (10**12 * 30)), "_old"
        )
        new = F.struct(
            F.when(F.col("_old").isNull(), F.lit("insert"))
            .when(F.col("_pg_xid") % 50 == 0, F.lit("delete")).otherwise(F.lit("update_postimage")).alias("_pg_change_type"),
            F.lit(2).alias("_sort_by"), F.col("status").alias("status"), F.col("amount").alias("amount"),
        )
        old = F.struct(
            F.lit("update_preimage").alias("_pg_change_type"), F.lit(1).alias("_sort_by"),
            F.col("_old.status").alias("status"), F.col("_old.amount").alias("amount"),
        )
        both = F.when(F.col("_old").isNull(), F.array(new)).otherwise(F.array(old, new))
        return with_previous.select("business_key", "_pg_lsn", "_pg_xid", "_timestamp", F.inline(both))

    # -- AI usage ------------------------------------------------------------------------------------------------

    @staticmethod
    def usage_rows(events: DataFrame) -> DataFrame:
        u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
        service = F.when(F.col("value") > 60, F.lit("svc.other")).when(u % 2 == 0, F.lit("svc.app_gateway")).otherwise(F.lit("svc.coding_agent_gateway"))
        tokens_in, tokens_out = F.floor(F.col("value") * 130), F.floor(F.col("value") * 35)
        k = F.get_json_object("props", "$.k").cast("int")
        bucket = F.floor(F.datediff(F.to_date("ts"), F.lit(DAY0).cast("date")) / SNAPSHOT_DAYS).cast("string")
        decision = F.concat(F.lit("DEC-"), u.cast("string"), F.lit("-"), bucket)
        return events.select(
            F.col("ts").alias("event_time"),
            F.when(e % 5 != 0, service).alias("service_name"),
            service.alias("endpoint_name"),
            F.when(kind != "view", kind).alias("destination_model"),
            F.when((kind != "view") | (e % 2 == 1), F.concat(F.lit("dest-"), kind)).alias("destination_name"),
            F.when(e % 3 == 0, F.create_map(F.lit("decision_id"), decision)).when(
                e % 3 == 1, F.create_map(F.lit("application"), F.lit("growth-app"))
            ).alias("request_tags"),
            F.when(e % 2 == 0, F.create_map(F.lit("application"), F.lit("endpoint-app"))).alias("endpoint_tags"),
            F.when((kind == "error") & (k > 80), F.lit(403)).otherwise(F.lit(200)).alias("status_code"),
            F.concat(F.lit("user-"), u.cast("string")).alias("requester"),
            e.alias("request_id"),
            F.when(e % 17 != 0, tokens_in).alias("input_tokens"),
            tokens_out.alias("output_tokens"),
            F.when(e % 10 != 0, F.coalesce(F.when(e % 17 != 0, tokens_in), F.lit(0)) + tokens_out).alias("total_tokens"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.usage_rows(self.raw("events"))

    @cached_property
    def usage_base(self) -> DataFrame:
        return usage_base(self.usage, GATEWAYS)

    @cached_property
    def spend(self) -> DataFrame:
        names = ["svc.app_gateway", "svc.coding_agent_gateway", "svc.other"]
        quantity = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.000001").cast("decimal(7,6)")
        return self.raw("orders").select(
            quantity.alias("usage_quantity"),
            F.struct(X.pick(names, F.col("o_orderkey") % 3).alias("endpoint_name")).alias("usage_metadata"),
        )

    @cached_property
    def payload(self) -> DataFrame:
        """Conversation turns as captured gateway calls. Some requests carry a marker or an unbounded-read phrase."""
        c, t = F.col("conv_id"), F.col("turn")
        asked = (
            F.when(c % 5 == 0, F.concat(F.lit("Please run an UNLIMITED-query now. "), F.col("text")))
            .when(c % 5 == 1, F.concat(F.lit("MARK-"), (c % 50).cast("string"), F.lit(" "), F.col("text")))
            .otherwise(F.col("text"))
        )
        user = F.col("role") == "user"
        start = F.unix_micros(F.lit(f"{DAY0} 00:00:00").cast("timestamp"))
        moment = F.timestamp_micros(start + (c * 600 + t * 60) * 1000000)
        return self.raw("conversations").select(
            F.concat(F.lit("req-"), c.cast("string"), F.lit("-"), t.cast("string")).alias("request_id"),
            moment.cast("timestamp_ntz").alias("event_time"),
            F.when(user, asked).otherwise(F.lit("")).alias("request"),
            F.when(user, F.lit("")).otherwise(F.col("text")).alias("response"),
            F.when((c % 11 == 0) & user, F.lit(403)).otherwise(F.lit(200)).alias("status_code"),
            F.length("text").cast("long").alias("latency_ms"),
            F.concat(F.lit("user-"), (c % 20).cast("string")).alias("requester"),
            F.concat(F.lit("/v1/"), F.col("role")).alias("api_type"),
        )

    # -- commerce ------------------------------------------------------------------------------------------------

    def items(self) -> DataFrame:
        """Order items with their lot, and region of the supplier."""
        place = self.places.select("s_suppkey", "region")
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("lot_id"), "l_suppkey",
            F.col("l_quantity").cast("long").alias("quantity"),
        )
        return lines.join(place, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")

    @cached_property
    def places(self) -> DataFrame:
        nations = self.raw("nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("facility"))
        regions = self.raw("region").select("r_regionkey", F.col("r_name").alias("region"))
        return (
            self.raw("supplier").select("s_suppkey", "s_nationkey")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "facility", "region")
        )

    def returns(self, product: bool = False, place: bool = False, customer: bool = False) -> DataFrame:
        """Returned lines; the joins for product, place and customer are added only when asked for."""
        o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        text = lambda c: c.cast("string")
        rows = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        rows = rows.select(
            F.concat_ws("-", text(o), text(n), text(p), text(s)).alias("return_id"),
            o.alias("order_id"), p.alias("lot_id"), s.alias("_supplier"),
            F.to_date("l_shipdate").alias("return_date"),
            F.round(price, 4).cast("decimal(18,4)").alias("refund_amount_usd"),
            F.col("l_quantity").cast("long").alias("quantity"),
            X.pick(["pending", "approved", "rejected", "escalated"], (o + n) % 4).alias("status"),
            F.round(F.col("l_tax") * 10, 1).alias("anger_score"),
            F.lit(None).cast("int").alias("coupon_pct_applied"),
            F.array().cast("array<struct<at:timestamp_ntz,by:string,action:string,notes:string>>").alias("audit_trail"),
            F.lit(None).cast("timestamp_ntz").alias("decided_at"),
        )
        if product:
            names = self.raw("part").select(F.col("p_partkey").alias("lot_id"), F.col("p_name").alias("product_name"))
            rows = rows.join(names, "lot_id")
        if place:
            rows = rows.join(self.places.withColumnRenamed("s_suppkey", "_supplier"), "_supplier")
        if customer:
            owner = self.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
            rows = rows.join(owner, "order_id")
        return rows.drop("_supplier")

    @cached_property
    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("country"))
        has_place = k % 13 != 0
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            k.alias("customer_id"), "country",
            F.concat(F.lit("CITY-"), F.col("c_nationkey").cast("string"), F.lit("-"), (k % 4).cast("string")).alias("city"),
            F.when(has_place, F.col("c_nationkey") * 2.0 + (k % 10) / 10.0).alias("customer_lat"),
            F.when(has_place, F.col("c_nationkey") * 3.0 - (k % 10) / 10.0).alias("customer_lng"),
        )

    @cached_property
    def tiers(self) -> DataFrame:
        k, balance = F.col("c_custkey"), F.col("c_acctbal")
        return self.raw("customer").where(balance >= -500.0).select(
            k.alias("customer_id"),
            F.round((balance + 1000.0) / 11000.0, 4).alias("premium_prob"),
            F.when(balance >= 4500.0, F.lit("premium")).otherwise(F.lit("standard")).alias("final_tier"),
            F.when(k % 3 == 0, F.when(balance >= 4500.0, F.lit("premium")).otherwise(F.lit("not_premium"))).alias("premium_status_labeled"),
        )

    @cached_property
    def lots(self) -> DataFrame:
        """Parts as production lots; the facility is that of the supplier with the same number."""
        suppliers = self.raw("supplier").agg(F.count(F.lit(1)).alias("_n"))
        part = self.raw("part").select(F.col("p_partkey").alias("lot_id"), F.col("p_partkey").alias("product_id"))
        placed = part.withColumn("s_suppkey", F.col("lot_id") % suppliers.scalar())
        return placed.join(self.places, "s_suppkey").select("lot_id", "product_id", "facility")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("total_usd"),
            F.col("o_orderstatus").alias("status"),
        )

    # -- chat ----------------------------------------------------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        return self.raw("conversations").select(
            F.concat(F.lit("m-"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id"),
            c.alias("conversation_id"), "role", F.col("text").alias("content"), t.alias("position"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        c = F.col("conv_id")
        day0 = F.lit(DAY0).cast("date")
        return self.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
            c.alias("id"),
            F.concat(F.lit("user-"), (c % 20).cast("string"), F.lit("@example.com")).alias("user_email"),
            F.concat(F.lit("Conversation "), c.cast("string")).alias("title"),
            F.date_add(day0, (c % 28).cast("int")).alias("created_at"),
            F.date_add(day0, (c % 28 + F.col("n")).cast("int")).alias("updated_at"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """Long messages are liked and short ones are not; those in between get no vote."""
        c, t, size = F.col("conv_id"), F.col("turn"), F.length("text")
        votes = self.raw("conversations").where((size > 300) | (size < 200))
        return votes.select(
            F.concat(F.lit("f-"), c.cast("string"), F.lit("-"), t.cast("string")).alias("id"),
            F.concat(F.lit("m-"), c.cast("string"), F.lit("-"), t.cast("string")).alias("message_id"),
            F.when(size > 300, F.lit("up")).otherwise(F.lit("down")).alias("value"),
        )

    # -- search --------------------------------------------------------------------------------------------------

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")

    @cached_property
    def query_vector(self) -> DataFrame:
        """The vector with the smallest id, as a one-row frame."""
        return self.raw("embeddings").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
