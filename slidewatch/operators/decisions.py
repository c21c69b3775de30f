"""Decision state as table operators: an append-only event log is the data, the current state is derived from it.

Event columns: decision_id, segment_id, at, event_id, by, action, notes, tool, assist_run_id, rollout_pct,
action_type, target_experiment_id, flag_key, variant, drafted_note, predicted_conversion_lift.
Events of a decision are ordered by (at, event_id).

Accepted moves: a first event may be ``investigating`` or ``proposed``; ``investigating`` may become
``investigation_failed`` or ``proposed``; ``investigation_failed`` may become ``investigating`` or ``proposed``;
``proposed`` may be ``redrafted`` or ``approved`` (rollout 1 to 100); ``approved`` may be ``committed`` when an
approver is recorded. A rejected event leaves the state as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.functions.exprs import count_if
from slidewatch.functions.scan import row_position
from slidewatch.operators.gold import parse_ranking
from slidewatch.operators.rank import latest_per_key, rank_candidates, rank_of_one, risk_rank
from slidewatch.settings import ACTIONS, DECISION_STATUSES

ORDER = ["at", "event_id"]
DRAFT_COLUMNS = ["action_type", "target_experiment_id", "flag_key", "variant", "drafted_note", "predicted_conversion_lift"]
#: Rows of a page of the live view, unless the caller asks for another number.
LIVE_PAGE = 40


def _moment() -> Column:
    return F.struct(F.col("at"), F.col("event_id"))


def _is(action: str) -> Column:
    return F.col("action") == action


def rollout_in_range(pct: Column) -> Column:
    return F.coalesce((pct >= 1) & (pct <= 100), F.lit(False))


def _stages(events: DataFrame, slice_unit: str) -> tuple[DataFrame, DataFrame]:
    """Events with their slice, and one row per (decision, slice) with what is known of the whole decision.

    The life cycle never returns from ``proposed``, so its stages are first moments: the first proposal is always
    accepted; the approval is the first one in range after it; the commit is the first one after that, if an approver is
    recorded. Events are shuffled once, on decision and slice. A slice tells its first proposal, its first approval and
    commit, and the first ones after the proposal or approval that falls into the slice itself; from these short rows the
    stages of the decision follow, however many events it has.
    """
    sliced = events.withColumn("_slice", F.date_trunc(slice_unit, "at"))
    here = Window.partitionBy("decision_id", "_slice")
    moment = _moment()
    approval = F.when(_is("approved") & rollout_in_range(F.col("rollout_pct")), F.struct("at", "event_id", "by", "rollout_pct"))
    commit = F.when(_is("committed"), moment)
    after = lambda name: moment > F.struct(F.col(f"{name}.at"), F.col(f"{name}.event_id"))
    early = F.when(F.col("action").isin("investigating", "investigation_failed"), F.struct("at", "event_id", "action"))
    known = sliced.select(
        "decision_id", "_slice", "at", "event_id", "action", approval.alias("_approval"), commit.alias("_commit"), early.alias("_early"),
        F.min(F.when(_is("proposed"), moment)).over(here).alias("_proposal"),
    )
    known = known.withColumns(
        {"_first": F.min("_approval").over(here), "_next": F.min(F.when(after("_proposal"), F.col("_approval"))).over(here)}
    )
    slices = known.groupBy("decision_id", "_slice").agg(
        F.min("_proposal").alias("_proposal"), F.min("_first").alias("_first"), F.min("_next").alias("_next"),
        F.min(F.when(_is("investigating"), moment)).alias("_opened"),
        F.min("_commit").alias("_commit"), F.min(F.when(after("_first"), F.col("_commit"))).alias("_commit_first"),
        F.min(F.when(after("_next"), F.col("_commit"))).alias("_commit_next"), F.max("_early").alias("_edge"),
    )
    whole = Window.partitionBy("decision_id")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = F.date_trunc(slice_unit, F.col("proposed_at.at"))
    slices = slices.withColumn("proposed_at", F.min("_proposal").over(whole))
    slices = slices.withColumn(
        "_chosen", F.min(F.when(F.col("_slice") == start, F.col("_next")).when(F.col("_slice") > start, F.col("_first"))).over(whole)
    )
    given = F.date_trunc(slice_unit, F.col("_chosen.at"))
    own = F.when(F.col("_slice") == start, F.col("_commit_next")).otherwise(F.col("_commit_first"))
    last = F.when(F.col("_slice") == given, own).when(F.col("_slice") > given, F.col("_commit"))
    return sliced, slices.select(
        "decision_id", "_slice", "proposed_at",
        F.when(F.col("_chosen").isNotNull(), F.struct("_chosen.at", "_chosen.event_id")).alias("approved_at"),
        F.col("_chosen.by").alias("approved_by"),
        F.min(F.when(F.col("_chosen.by").isNotNull(), last)).over(whole).alias("committed_at"),
        F.last("_edge.action", ignorenulls=True).over(earlier).alias("_carried"), F.min("_opened").over(whole).alias("opened_at"),
    )


def validate_transitions(events: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Every event with ``valid`` and, for rejected ones, ``reason``."""
    return life_cycle(events, slice_unit).select(*events.columns, "valid", "reason")


def life_cycle(events: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Every event with ``valid``, for rejected ones ``reason``, and ``status``, the decision's after the event.

    Before the proposal only ``investigating`` and ``investigation_failed`` alternate, so each is accepted exactly
    when the preceding one of the two differs (a first failure is rejected). Events are shuffled once, on decision
    and time slice; what is known of a decision and of its earlier slices comes as one row per slice.
    """
    sliced, per_slice = _stages(events, slice_unit)
    early = F.col("action").isin("investigating", "investigation_failed")
    inside = Window.partitionBy("decision_id", "_slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.withColumn("_local", F.last(F.when(early, F.col("action")), ignorenulls=True).over(inside)).join(
        per_slice, ["decision_id", "_slice"]
    )
    before = F.coalesce("_local", "_carried")
    flip = F.when(_is("investigating"), F.coalesce(before != "investigating", F.lit(True))).otherwise(
        F.coalesce(before == "investigating", F.lit(False))
    )
    moment = _moment()
    before_proposal = F.col("proposed_at").isNull() | (moment < F.col("proposed_at"))
    drafting = (moment > F.col("proposed_at")) & (F.col("approved_at").isNull() | (moment < F.col("approved_at")))
    valid = (
        F.when(early, flip & before_proposal)
        .when(_is("proposed"), moment == F.col("proposed_at"))
        .when(_is("redrafted"), drafting)
        .when(_is("approved"), moment == F.col("approved_at"))
        .when(_is("committed"), moment == F.col("committed_at"))
        .otherwise(F.lit(False))
    )
    reason = (
        F.when(F.col("valid"), F.lit(None).cast("string"))
        .when(_is("approved") & drafting & ~rollout_in_range(F.col("rollout_pct")), F.lit("rollout_pct must be between 1 and 100"))
        .when(
            _is("committed") & (moment > F.col("approved_at")) & F.col("approved_by").isNull(),
            F.lit("an approver is required before commit"),
        )
        .otherwise(F.lit("invalid transition"))
    )
    # Stages never go back, so the status is the last stage reached; before the proposal, the last move of an opened investigation.
    status = (
        F.when(moment >= F.col("committed_at"), F.lit("committed"))
        .when(moment >= F.col("approved_at"), F.lit("approved"))
        .when(moment >= F.col("proposed_at"), F.lit("proposed"))
        .when(moment >= F.col("opened_at"), F.when(early, F.col("action")).otherwise(before))
        .otherwise(F.lit("none"))
    )
    out = joined.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("reason", reason).withColumn("status", status)
    return out.select(*events.columns, "valid", "reason", "status")


def split_transitions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events and rejected events (side output)."""
    checked = validate_transitions(events)
    return checked.where("valid").drop("valid", "reason"), checked.where("NOT valid")


def fold_decisions(valid_events: DataFrame) -> DataFrame:
    """Accepted events to current decision rows."""
    moment = _moment()
    # What the first event says of the draft holds until a proposal replaces it.
    started = [c for c in DRAFT_COLUMNS if c != "drafted_note"]
    first = F.min(F.struct("at", "event_id", "segment_id", "action", *started)).alias("_first")
    status_events = F.when(~_is("redrafted"), F.struct("at", "event_id", "action"))
    draft = F.when(_is("proposed"), F.struct("at", "event_id", *DRAFT_COLUMNS))
    redraft = F.when(_is("redrafted"), F.struct("at", "event_id", "drafted_note"))
    approval = F.when(_is("approved"), F.struct("at", "event_id", "by", "rollout_pct"))
    commit = F.when(_is("committed"), F.col("at"))
    folded = valid_events.groupBy("decision_id").agg(
        first, F.max(status_events).alias("_status"), F.max(draft).alias("_draft"),
        F.max(redraft).alias("_redraft"), F.max(approval).alias("_approval"), F.max(commit).alias("decided_at"),
        F.count(moment).alias("accepted_events"),
    )
    return folded.select(
        "decision_id", F.col("_first.segment_id").alias("segment_id"), F.col("_status.action").alias("status"),
        *[F.coalesce(f"_draft.{c}", f"_first.{c}").alias(c) for c in started],
        F.coalesce("_redraft.drafted_note", "_draft.drafted_note").alias("drafted_note"),
        # A case opened by an investigation starts at full rollout until a person approves another share.
        F.coalesce(
            F.col("_approval.rollout_pct"), F.when(F.col("_first.action") == "investigating", F.lit(100))
        ).alias("rollout_pct"),
        F.col("_approval.by").alias("approved_by"),
        F.col("_first.at").alias("created_at"), "decided_at", "accepted_events",
    )


def audit_entries(valid_events: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """The trail as rows: one per accepted event, with its position in the decision."""
    rows = valid_events.select(
        "decision_id", "segment_id", "at", "event_id", "by", "action", "notes", "tool", "assist_run_id"
    )
    return row_position(rows, ["decision_id"], ORDER, F.date_trunc(slice_unit, "at"), "position")


def audit_trail(valid_events: DataFrame, page_rows: int = 1000) -> DataFrame:
    """The trail as ordered arrays, in pages of ``page_rows`` entries; nearly every decision has the one page 0.

    Pages keep an array, and the group that makes it, bounded however long a trail gets; no entry is left out.
    """
    entry = F.struct("position", "at", "by", "action", "notes", "tool", "assist_run_id")
    paged = audit_entries(valid_events).withColumn("page", F.floor((F.col("position") - 1) / page_rows))
    return paged.groupBy("decision_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("position")).alias("audit_trail")
    )


def assist_run(trails: DataFrame) -> DataFrame:
    """Run id recorded by the first ``proposed`` entry of each decision."""
    proposed = F.filter("audit_trail", lambda e: e["action"] == "proposed")
    first = trails.select("decision_id", "page", F.get(proposed, 0).alias("entry")).where(F.col("entry").isNotNull())
    return first.groupBy("decision_id").agg(F.min_by(F.col("entry.assist_run_id"), "page").alias("assist_run_id"))


def activity(trails: DataFrame, n: int = 25, emails: DataFrame | None = None) -> DataFrame:
    """Newest entries over all trails, with e-mails (decision_id, at, by, subject) merged in when given."""
    feed = trails.select("decision_id", F.explode("audit_trail").alias("e")).select(
        F.lit("audit").alias("kind"), "decision_id", "e.at", "e.by", F.col("e.action").alias("what")
    )
    if emails is not None:
        feed = feed.unionByName(
            emails.select(F.lit("email").alias("kind"), "decision_id", "at", "by", F.col("subject").alias("what"))
        )
    return feed.orderBy(F.col("at").desc(), "decision_id", "kind", "what").limit(n)


def decision_rules() -> dict[str, Column]:
    """Row rules of stored decisions, for ``silver.expect``."""
    return {
        "action_type": F.coalesce(F.col("action_type").isin(ACTIONS), F.lit(False)),
        "status": F.col("status").isin(DECISION_STATUSES),
        "rollout_pct": F.col("rollout_pct").isNull() | F.col("rollout_pct").between(0, 100),
        "approved_rollout_pct": ~F.col("status").isin("approved", "committed") | rollout_in_range(F.col("rollout_pct")),
    }


def apply_redrafts(decisions: DataFrame, redrafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New notes for decisions that are still proposed: (decisions, trail entries, refused redrafts).

    ``redrafts``: decision_id, at, drafted_note, assist_run_id. The latest redraft of a decision sets its note; every
    accepted one, not only the latest, is an entry for the trail (see ``extend_trail``).
    """
    latest = latest_per_key(redrafts, "decision_id", ["at", "assist_run_id"]).select(
        "decision_id", F.col("drafted_note").alias("_note"), F.col("at").alias("_at")
    )
    proposed = decisions.where(F.col("status") == "proposed").select("decision_id", "segment_id")
    open_to_change = (F.col("status") == "proposed") & F.col("_at").isNotNull()
    applied = decisions.join(latest, "decision_id", "left").select(
        *[c for c in decisions.columns if c != "drafted_note"],
        F.when(open_to_change, F.col("_note")).otherwise(F.col("drafted_note")).alias("drafted_note"),
    )
    entries = redrafts.join(proposed, "decision_id").select(
        "decision_id", "segment_id", "at", F.lit(None).cast("string").alias("by"), F.lit("redrafted").alias("action"),
        F.col("drafted_note").alias("notes"), F.lit("redraft").alias("tool"), "assist_run_id",
    )
    return applied, entries, redrafts.join(proposed, "decision_id", "left_anti")


def extend_trail(entries: DataFrame, more: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """The trail as rows with further entries in it, numbered anew by time; nothing that was there is lost."""
    columns = ["decision_id", "segment_id", "at", "by", "action", "notes", "tool", "assist_run_id"]
    rows = entries.select(*columns).unionByName(more.select(*columns))
    return row_position(
        rows, ["decision_id"], ["at", "action", "assist_run_id"], F.date_trunc(slice_unit, "at"), "position"
    )


def latest_decision(decisions: DataFrame) -> DataFrame:
    return latest_per_key(decisions, "segment_id", ["created_at", "decision_id"])


def live_view(
    positions: DataFrame,
    open_rows: DataFrame,
    recs: DataFrame,
    decisions: DataFrame,
    segment_id: str | None = None,
    limit: int | None = LIVE_PAGE,
) -> DataFrame:
    """Position, risk rank, recommendation and latest decision of the open segments, by rank.

    ``limit`` is the page size, any positive number; None gives the whole view. A page takes its rows first and ranks
    only those; one segment's rank is one more than the number of segments ahead of it.
    """
    if limit is not None and limit < 1:
        raise ValueError("a page has at least one row")
    if segment_id is not None:
        ranked = rank_of_one(open_rows, "conversion_at_risk_usd", "segment_id", segment_id, "risk_rank")
    elif limit is not None:
        ranked = rank_candidates(open_rows, "conversion_at_risk_usd", "segment_id", limit).withColumnRenamed("rank", "risk_rank")
    else:
        ranked = risk_rank(open_rows)
    ranked = ranked.select(
        "segment_id", "risk_rank", "has_matching_experiment", "matching_experiment_id",
        "matching_experiment_lift", "neighbor_flag_key",
    )
    latest = latest_decision(decisions).select(
        "decision_id", "segment_id", F.col("action_type").alias("decided_action"), "target_experiment_id",
        "flag_key", "variant", "rollout_pct", F.col("status").alias("decision_status"), "approved_by",
        F.col("created_at").alias("decision_created_at"), "decided_at",
    )
    if segment_id is not None:
        positions, ranked, recs, latest = (
            d.where(F.col("segment_id") == segment_id) for d in (positions, ranked, recs, latest)
        )
    view = (
        positions.drop("sessions")
        .join(ranked, "segment_id")
        .join(recs, "segment_id", "left")
        .join(latest, "segment_id", "left")
        .orderBy("risk_rank")
    )
    return view


def cases(open_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every open segment that has a decision, with the latest one, newest first. No page and no rank is involved."""
    latest = latest_decision(decisions).select(
        "segment_id", "decision_id", F.col("status").alias("decision_status"), "decided_at",
        F.col("created_at").alias("decision_created_at"), "action_type", "flag_key", "predicted_conversion_lift",
    )
    newest = F.coalesce("decided_at", "decision_created_at")
    return open_rows.select("segment_id").join(latest, "segment_id").orderBy(newest.desc_nulls_last(), "segment_id")


def case_detail(
    decisions: DataFrame, live: DataFrame, experiments: DataFrame, trails: DataFrame, decision_id: str | None = None
) -> DataFrame:
    """Decision with its live metrics, target experiment and its text, and audit trail.

    All decisions of open segments when no id is given. A trail longer than a page gives one row per page.
    """
    if decision_id is not None:
        decisions = decisions.where(F.col("decision_id") == decision_id)
    metric = live.select(
        "segment_id", "cohort", "platform", "risk_rank", "conversion_rate", "conversion_drop",
        "conversion_at_risk_usd", "recommended_action",
    )
    target = experiments.select(
        F.col("experiment_id").alias("target_experiment_id"), "experiment_name", "observed_lift",
        F.col("description").alias("experiment_text"),
    )
    found = decisions.join(metric, "segment_id").join(target, "target_experiment_id", "left")
    return found.join(trails, "decision_id", "left")


def next_cases(open_rows: DataFrame, recs: DataFrame, decisions: DataFrame, n: int = 1) -> DataFrame:
    """Segments most at risk that have no decision yet, with the values a new case starts from."""
    free = open_rows.join(decisions.select("segment_id"), "segment_id", "left_anti")
    top = free.orderBy(F.col("conversion_at_risk_usd").desc_nulls_last(), "segment_id").limit(n)
    wanted = recs.select("segment_id", "recommended_action", "predicted_conversion_lift")
    return top.join(wanted, "segment_id", "left").select(
        "segment_id", "conversion_at_risk_usd",
        F.coalesce("recommended_action", F.lit("ship_proven_variant")).alias("action_type"),
        F.coalesce("neighbor_flag_key", F.lit("")).alias("flag_key"),
        F.lit(100).alias("rollout_pct"), "predicted_conversion_lift", F.lit("investigating").alias("status"),
    )


def kpi_after_decisions(positions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sliding count and value at risk before and after leaving out segments whose decision is committed."""
    shipped = latest_decision(decisions).where(F.col("status") == "committed").select("segment_id", F.lit(True).alias("_shipped"))
    rows = positions.join(shipped, "segment_id", "left")
    open_now = F.col("_shipped").isNull()
    sliding = F.col("conv_band") == "sliding"
    risk = F.col("conversion_at_risk_usd")
    return rows.agg(
        count_if(sliding).alias("sliding_before"),
        count_if(sliding & open_now).alias("sliding_after"),
        F.round(F.sum(risk), 4).alias("at_risk_before"),
        F.round(F.sum(F.when(open_now, risk).otherwise(F.lit(0.0))), 4).alias("at_risk_after"),
    )


def cycle_times(valid_events: DataFrame) -> DataFrame:
    """Seconds from creation to approval and from approval to commit, per decision."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    times = valid_events.groupBy("decision_id").agg(
        F.min("at").alias("created_at"),
        F.min(F.when(_is("approved"), F.col("at"))).alias("approved_at"),
        F.min(F.when(_is("committed"), F.col("at"))).alias("committed_at"),
    )
    return times.select(
        "decision_id",
        ((micros(F.col("approved_at")) - micros(F.col("created_at"))) / 1000000.0).alias("seconds_to_approval"),
        ((micros(F.col("committed_at")) - micros(F.col("approved_at"))) / 1000000.0).alias("seconds_to_commit"),
    )


def freshness(view: DataFrame, decisions: DataFrame, read_at: str) -> DataFrame:
    """Whether a view read at ``read_at`` shows each committed decision that is its segment's latest."""
    seen = view.select("segment_id", F.col("decision_id").alias("seen_decision_id"))
    committed = latest_decision(decisions).where(F.col("decided_at").isNotNull())
    return committed.join(seen, "segment_id").select(
        "segment_id", "decision_id",
        ((F.col("decision_id") == F.col("seen_decision_id")) & (F.col("decided_at") <= F.lit(read_at).cast("timestamp_ntz")))
        .alias("fresh"),
    )


def reset_decisions(decisions: DataFrame, segment_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The decisions that remain after a reset (all of them go when no segment is given) and the number deleted."""
    gone = F.lit(True) if segment_id is None else F.col("segment_id") == segment_id
    return decisions.where(~gone), decisions.agg(count_if(gone).alias("deleted_count"))


def top_option(recs_text: DataFrame, column: str = "action_ranking") -> DataFrame:
    """First entry of a ranking that arrives as text."""
    first = F.get(parse_ranking(F.col(column)), 0)
    return recs_text.select("segment_id", first["action_type"].alias("action_type"), first["net_value_usd"].alias("net_value_usd"))


