"""Point-in-time history features.

A join of every invoice with every earlier invoice of its customer grows with the square of a customer's rows. Instead:

* full history: events (invoice became known) and query points are reduced to one row per customer and day, and running
  totals over those rows give the history before each day. Rows per customer are bounded by the calendar;
* recent windows: events are reduced to (customer, due day, known day) cells and joined with distinct query days inside
  a bucket as long as the window, so the join is bounded by calendar days, never by rows of a customer;
* the part of the cutoff's own day before its time of day comes from a running total inside (customer, day).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, floor_days, money, plus_days, ratio, to_ntz
from duewise.operators.prefix import before, strict_prefix

SUMS = ["n", "paid", "written_off", "delay", "cents", "promises", "kept", "escalations"]
BASE = ["customer_id", "invoice_number", "amount", "issue_date", "due_date", "status", "paid_at"]
WINDOW_SUMS = ["n", "paid", "late", "delay", "promises", "kept"]


def resolved_at() -> Column:
    """When an invoice's outcome became knowable; NULL if never. Write-offs count only after the safe bound."""
    due = to_ntz(F.col("due_date"))
    paid = (F.col("status") == "paid") & F.col("paid_at").isNotNull()
    return F.when(paid, F.greatest(due, F.col("paid_at"))).when(
        F.col("status") == "written_off", plus_days(due, P.WRITE_OFF_KNOWN_AFTER_DAYS)
    )


def touch_counts(promises: DataFrame, actions: DataFrame) -> DataFrame:
    """Promises and escalations per invoice, aggregated before any join so nothing fans out."""
    promised = promises.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("promises"), F.count_if(F.col("status") == "kept").alias("kept")
    )
    escalated = (
        actions.filter(F.col("action_type") == "escalate")
        .groupBy("invoice_id").agg(F.count(F.lit(1)).alias("escalations"))
    )
    return promised.join(escalated, "invoice_id", "full_outer")


def history_facts(invoices: DataFrame, promises: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per invoice with everything its customer's later invoices may learn from it."""
    due = to_ntz(F.col("due_date"))
    paid = F.col("status") == "paid"
    off = F.col("status") == "written_off"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    touches = touch_counts(promises, actions).withColumnRenamed("invoice_id", "id")
    return invoices.join(touches, "id", "left").select(
        F.col("id").alias("invoice_id"), *BASE, resolved_at().alias("resolved_at"),
        F.lit(1).cast("bigint").alias("n"),
        paid.cast("bigint").alias("paid"),
        off.cast("bigint").alias("written_off"),
        (off | (paid & (F.col("paid_at") > due))).cast("bigint").alias("late"),
        F.when(paid, floor_days(due, F.col("paid_at"))).otherwise(F.lit(0)).cast("bigint").alias("delay"),
        cents(F.col("amount")).alias("cents"),
        zero("promises"), zero("kept"), zero("escalations"),
    )


def query_points(facts: DataFrame, cutoff: Column, query_id: str = "invoice_id", keep: list[str] = ()) -> DataFrame:
    """Query points about invoices of ``facts`` themselves; the own measures ride along to be taken out later."""
    return facts.select(
        F.col(query_id).alias("query_id"), "invoice_id", *BASE, *keep, cutoff.alias("cutoff"),
        *[F.col(c).alias(f"own_{c}") for c in ["resolved_at", "late", *SUMS]],
    )


def _largest_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Largest and second largest amount per group; the rank filter trims every map side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cents").desc()))
    top = rows.select(*keys, "cents").withColumn("_rank", rank).filter(F.col("_rank") <= 2)
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("cents"))).alias("top"),
        F.max(F.when(F.col("_rank") == 2, F.col("cents"))).alias("second"),
    )


def _event_totals(resolved: DataFrame, keys: list[str], own_may_be_known: bool, extra: list[str] = ()) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in [*SUMS, *extra]]
    if not own_may_be_known:
        top = [F.max("cents").alias("top"), F.lit(None).cast("bigint").alias("second")]
        return resolved.groupBy(*keys).agg(*sums, *top)
    return resolved.groupBy(*keys).agg(*sums).join(_largest_two(resolved, keys), keys)


def _day_timeline(points: DataFrame, facts: DataFrame, resolved: DataFrame, own_may_be_known: bool) -> DataFrame:
    """History before each query day: one row per customer and query day."""
    events = _event_totals(resolved, ["customer_id", "day"], own_may_be_known)
    issued = facts.groupBy("customer_id", F.col("issue_date").alias("day")).agg(F.count(F.lit(1)).alias("issued"))
    asked = points.select("customer_id", "day").distinct().withColumn("asked", F.lit(1))
    parts = [events, issued, asked]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one_per_day = rows.groupBy("customer_id", "day").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*SUMS, "issued"]],
        F.max("top").alias("top"), F.max("second").alias("second"), F.max("asked").alias("asked"),
    )
    dated = one_per_day.select(
        "*", F.when(F.col("issued") > 0, F.col("day")).alias("last_issue"),
        F.when(F.col("issued") > 1, F.col("day")).alias("prev_issue"),
    )
    running = strict_prefix(
        dated, ["customer_id"], "day", sums=[*SUMS, "issued"],
        top_two=[("top", "second"), ("last_issue", "prev_issue")],
    )
    same_day = ["issued", "last_issue", "prev_issue"]
    return running.filter("asked = 1").select(
        "customer_id", "day",
        *[F.col(before(c)).alias(f"h_{c}") for c in [*SUMS, "issued", "top", "second", "last_issue", "prev_issue"]],
        *[F.col(c).alias(f"h_same_{c}") for c in same_day],
    )


def _recent_windows(points: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over events due inside the last 90 / 180 days and known before the query day."""
    span = P.RECENT_LONG_DAYS
    cells = resolved.groupBy("customer_id", "due_date", "day").agg(*[F.sum(c).alias(c) for c in WINDOW_SUMS]).select(
        "customer_id", F.col("due_date").alias("due"), F.col("day").alias("known"), *WINDOW_SUMS,
        F.floor(F.unix_date("due_date") / span).cast("int").alias("bucket"),
    )
    asked = points.select(*keys).distinct()
    late_cut = F.col("late_cut") if "late_cut" in keys else F.lit(0)
    home = F.floor(F.unix_date("day") / span).cast("int")
    buckets = asked.withColumn("bucket", F.explode(F.array(home, home - 1)))
    joined = buckets.join(cells, ["customer_id", "bucket"]).filter(
        (F.col("known") < F.col("day")) & (F.col("due") >= F.date_sub(F.col("day"), F.lit(span) - late_cut))
    )
    short = F.col("due") >= F.date_sub(F.col("day"), F.lit(P.RECENT_SHORT_DAYS) - late_cut)
    return joined.groupBy(*keys).agg(
        *[F.sum(c).alias(f"h_long_{c}") for c in WINDOW_SUMS],
        *[F.sum(F.when(short, F.col(c)).otherwise(0)).alias(f"h_short_{c}") for c in ["n", "paid", "late"]],
    )


def _own_day_part(points: DataFrame, resolved: DataFrame, own_may_be_known: bool) -> DataFrame:
    """Events of the cutoff's own day that came before its time of day."""
    width = {"long": P.RECENT_LONG_DAYS, "short": P.RECENT_SHORT_DAYS}
    flagged = resolved
    extra = []
    for name, days in width.items():
        inside = F.col("due_date") >= F.date_sub(F.col("day"), days - 1)
        for c in WINDOW_SUMS if name == "long" else ["n", "paid", "late"]:
            flagged = flagged.withColumn(f"{name}_{c}", F.when(inside, F.col(c)).otherwise(0))
            extra.append(f"{name}_{c}")
    timed = points.filter("late_cut = 1")
    days = timed.select("customer_id", "day").distinct()
    near = flagged.join(days, ["customer_id", "day"], "left_semi").withColumnRenamed("resolved_at", "at")
    keys = ["customer_id", "day", "at"]
    events = _event_totals(near, keys, own_may_be_known, extra)
    asked = timed.select("customer_id", "day", F.col("cutoff").alias("at")).distinct().withColumn("asked", F.lit(1))
    sums = [*SUMS, *extra]
    rows = events.unionByName(asked, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.max("top").alias("top"), F.max("second").alias("second"), F.max("asked").alias("asked"),
    )
    running = strict_prefix(rows, ["customer_id", "day"], "at", sums=sums, top_two=[("top", "second")])
    return running.filter("asked = 1").select(
        "customer_id", "day", F.col("at").alias("cutoff"),
        *[F.col(before(c)).alias(f"h_near_{c}") for c in [*sums, "top", "second"]],
    )


def known_history(points: DataFrame, facts: DataFrame, *, midnight: bool, own_may_be_known: bool) -> DataFrame:
    """Points with raw history measures (``h_`` columns), own invoice taken out.

    ``midnight`` says every cutoff is a date, which drops the own-day part. ``own_may_be_known`` must be true unless the
    cutoff is the invoice's own due date, where the own outcome cannot be known yet.
    """
    day = F.to_date("cutoff")
    marked = points.select("*", day.alias("day"), (F.col("cutoff") > to_ntz(day)).cast("int").alias("late_cut"))
    resolved = facts.filter(F.col("resolved_at").isNotNull()).withColumn("day", F.to_date("resolved_at"))
    timeline = _day_timeline(marked, facts, resolved, own_may_be_known)
    by_day = ["customer_id", "day"]
    if midnight:
        # Both parts are one row per customer and day; joined first, they cost the wide points one shuffle.
        out = marked.join(timeline.join(_recent_windows(marked, resolved, by_day), by_day, "left"), by_day)
    else:
        recent = _recent_windows(marked, resolved, [*by_day, "late_cut"])
        out = marked.join(timeline, by_day).join(recent, [*by_day, "late_cut"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    h = lambda c: F.col(f"h_{c}")
    wide = [f"long_{c}" for c in WINDOW_SUMS] + [f"short_{c}" for c in ["n", "paid", "late"]]
    if not midnight:
        out = out.join(_own_day_part(marked, resolved, own_may_be_known), ["customer_id", "day", "cutoff"], "left")
        both = F.when(h("top").isNotNull() & h("near_top").isNotNull(), F.least(h("top"), h("near_top")))
        timed = F.col("late_cut") == 1
        had = timed & (h("same_issued") > 0)
        out = out.withColumns({
            **{f"h_{c}": zero(f"h_{c}") + zero(f"h_near_{c}") for c in [*SUMS, *wide]},
            "h_second": F.greatest(both, h("second"), h("near_second")),
            "h_top": F.greatest(h("top"), h("near_top")),
            "h_prev_issue": F.when(had, F.coalesce(h("same_prev_issue"), h("last_issue"))).otherwise(h("prev_issue")),
            "h_last_issue": F.when(had, h("same_last_issue")).otherwise(h("last_issue")),
            "h_issued": F.when(timed, h("issued") + h("same_issued")).otherwise(h("issued")),
        })
    else:
        out = out.withColumns({f"h_{c}": zero(f"h_{c}") for c in wide})
    return _without_own(out, own_may_be_known)


def _without_own(out: DataFrame, own_may_be_known: bool) -> DataFrame:
    own_issued = to_ntz(F.col("issue_date")) < F.col("cutoff")
    last = F.col("h_last_issue")
    changes = {
        "h_last_issue": F.when(own_issued & (F.col("issue_date") == last), F.col("h_prev_issue")).otherwise(last),
        "h_issued": F.col("h_issued") - own_issued.cast("int"),
    }
    if own_may_be_known:
        known = F.coalesce(F.col("own_resolved_at") < F.col("cutoff"), F.lit(False))
        less = lambda h, when, c: F.col(h) - F.when(when, F.col(f"own_{c}")).otherwise(0)
        changes |= {f"h_{c}": less(f"h_{c}", known, c) for c in SUMS}
        for name, days in {"long": P.RECENT_LONG_DAYS, "short": P.RECENT_SHORT_DAYS}.items():
            inside = known & (to_ntz(F.col("due_date")) >= F.col("cutoff") - F.make_dt_interval(F.lit(days)))
            for c in WINDOW_SUMS if name == "long" else ["n", "paid", "late"]:
                changes[f"h_{name}_{c}"] = less(f"h_{name}_{c}", inside, c)
        top = F.col("h_top")
        changes["h_top"] = F.when(known & (F.col("own_cents") == top), F.col("h_second")).otherwise(top)
    return out.withColumns(changes)


def rolling_columns() -> dict[str, Column]:
    """Feature columns from the raw measures; also needs ``cutoff`` and ``relationship_start_date``."""
    h = lambda c: F.col(f"h_{c}")
    n, paid = h("n"), h("paid")
    some = n > 0
    months = floor_days(to_ntz(F.col("relationship_start_date")), F.col("cutoff")) / 30.0
    return {
        "has_prior_history": some,
        "prior_invoice_count": n,
        "prior_paid_count": paid,
        "prior_written_off_count": h("written_off"),
        "prior_payment_rate": ratio(paid, n),
        "prior_avg_delay_days": ratio(h("delay"), paid),
        "prior_avg_amount": ratio(h("cents"), n) / 100.0,
        "prior_total_amount": money(h("cents")),
        "prior_max_amount": F.when(some, money(h("top"))),
        "prior_promise_count": h("promises"),
        "prior_promise_kept_rate": ratio(h("kept"), h("promises")),
        "prior_escalation_touches_avg": ratio(h("escalations"), n),
        "prior_days_since_last_invoice": floor_days(to_ntz(h("last_issue")), F.col("cutoff")).cast("double"),
        "customer_invoice_frequency": F.when(months > 0, h("issued") / months),
        "recent_90d_payment_rate": ratio(h("short_paid"), h("short_n")),
        "recent_90d_late_rate": ratio(h("short_late"), h("short_n")),
        "recent_180d_payment_rate": ratio(h("long_paid"), h("long_n")),
        "recent_180d_avg_delay_days": ratio(h("long_delay"), h("long_paid")),
        "recent_180d_ptp_keep_rate": ratio(h("long_kept"), h("long_promises")),
    }
