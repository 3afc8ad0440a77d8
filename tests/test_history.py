"""Point-in-time history against a row-by-row reading of the rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duewise.operators import features as FE
from duewise.operators.history import history_facts, known_history, query_points, rolling_columns
from duewise.sources.schema import TABLES
from duewise.sources.tables import Domain

DAY = dt.timedelta(days=1)


def frame(spark, table, rows):
    return spark.createDataFrame(rows, TABLES[table])


def domain(spark, invoices, promises=(), actions=(), payments=(), customers=((1, dt.date(2023, 1, 1)),)):
    tables = {
        "merchants": [(1, "retail", "SMB", dt.date(2020, 1, 1))],
        "customers": [(c, 1, f"C{c}", "tech", "SMB", d, "chronic_late", 0.5, 0.5) for c, d in customers],
        "invoices": list(invoices), "payments": list(payments), "payment_promises": list(promises), "recovery_actions": list(actions),
    }
    names = {"promises": "payment_promises", "actions": "recovery_actions"}
    return Domain(lambda t: frame(spark, names.get(t, t), tables[names.get(t, t)]))


def invoice(i, customer, issue, due, status, paid_at=None, amount="100.00", cause="oversight"):
    from decimal import Decimal

    return (i, customer, f"INV-{i}", Decimal(amount), issue, due, status, paid_at, cause)


def promise(i, inv, status, promised=dt.date(2024, 1, 1)):
    from decimal import Decimal

    return (i, inv, Decimal("1.00"), promised, "voice", 0.5, status, dt.datetime(2024, 1, 1))


def action(i, inv, kind, at):
    return (i, inv, kind, 0.0, None, "allowed", "sent", at)


def days(start, end):
    return (end - start) // DAY


def midnight(d):
    return dt.datetime(d.year, d.month, d.day)


def known_at(inv):
    due = midnight(inv[5])
    if inv[6] == "paid" and inv[7] is not None:
        return max(due, inv[7])
    return due + 150 * DAY if inv[6] == "written_off" else None


def expected(own, cutoff, invoices, promises, actions, start):
    others = [v for v in invoices if v[1] == own[1] and v[0] != own[0]]
    prior = [v for v in others if known_at(v) is not None and known_at(v) < cutoff]
    issued = [v for v in others if midnight(v[4]) < cutoff]
    n, paid = len(prior), [v for v in prior if v[6] == "paid"]
    touched = lambda rows: [p for p in promises if p[1] in {v[0] for v in rows}]
    rate = lambda a, b: a / b if b else None
    delay = lambda rows: rate(sum(days(midnight(v[5]), v[7]) for v in rows), len(rows))
    kept = lambda ps: rate(sum(p[6] == "kept" for p in ps), len(ps))
    inside = lambda w: [v for v in prior if midnight(v[5]) >= cutoff - w * DAY]
    short, long = inside(90), inside(180)
    long_paid = [v for v in long if v[6] == "paid"]
    late = [v for v in short if v[6] == "written_off" or v[7] > midnight(v[5])]
    months = days(midnight(start), cutoff) / 30.0
    esc = [a for a in actions if a[2] == "escalate" and a[1] in {v[0] for v in prior}]
    return {
        "has_prior_history": n > 0, "prior_invoice_count": n, "prior_paid_count": len(paid),
        "prior_written_off_count": n - len(paid), "prior_payment_rate": rate(len(paid), n), "prior_avg_delay_days": delay(paid),
        "prior_avg_amount": rate(sum(float(v[3]) for v in prior), n), "prior_total_amount": sum(float(v[3]) for v in prior),
        "prior_max_amount": max((float(v[3]) for v in prior), default=None), "prior_promise_count": len(touched(prior)),
        "prior_promise_kept_rate": kept(touched(prior)), "prior_escalation_touches_avg": rate(len(esc), n),
        "prior_days_since_last_invoice": days(midnight(max(v[4] for v in issued)), cutoff) if issued else None,
        "customer_invoice_frequency": len(issued) / months if months > 0 else None,
        "recent_90d_payment_rate": rate(sum(v[6] == "paid" for v in short), len(short)), "recent_90d_late_rate": rate(len(late), len(short)),
        "recent_180d_payment_rate": rate(len(long_paid), len(long)), "recent_180d_avg_delay_days": delay(long_paid),
        "recent_180d_ptp_keep_rate": kept(touched(long)),
    }


def random_case(seed, n=120):
    rng = random.Random(seed)
    invoices = []
    for i in range(n):
        issue = dt.date(2023, 1, 1) + rng.randrange(500) * DAY
        due = issue + rng.choice([30, 45, 60]) * DAY
        status = rng.choice(["paid", "paid", "written_off", "open"])
        paid_at = midnight(due) + dt.timedelta(days=rng.randrange(-5, 70), hours=rng.randrange(24)) if status == "paid" else None
        invoices.append(invoice(i, rng.choice([1, 1, 1, 2]), issue, due, status, paid_at, f"{rng.choice([100, 250, 250, 400]) + rng.randrange(3)}.50"))
    promises = [promise(i, rng.randrange(n), rng.choice(["kept", "broken", "open"])) for i in range(60)]
    actions = [action(i, rng.randrange(n), rng.choice(["escalate", "email"]), dt.datetime(2023, 6, 1) + rng.randrange(600) * DAY) for i in range(60)]
    return rng, invoices, promises, actions


STARTS = ((1, dt.date(2022, 6, 1)), (2, dt.date(2023, 8, 1)))


def rolled(spark, invoices, promises, actions, cutoffs, **kind):
    d = domain(spark, invoices, promises, actions, customers=STARTS)
    facts = history_facts(d.invoices, d.promises, d.actions)
    asked = spark.createDataFrame(cutoffs, "qid BIGINT, invoice_id BIGINT, cutoff TIMESTAMP_NTZ")
    points = query_points(facts.join(asked, "invoice_id"), F.col("cutoff"), "qid")
    starts = spark.createDataFrame(STARTS, "customer_id BIGINT, relationship_start_date DATE")
    known = known_history(points, facts, **kind).join(starts, "customer_id")
    out = known.select("query_id", *[c.alias(n) for n, c in rolling_columns().items()])
    return {row["query_id"]: row.asDict() for row in out.collect()}


def assert_same(got, want, note):
    for name, value in want.items():
        assert got[name] == (pytest.approx(value) if isinstance(value, float) else value), (note, name, got[name], value)


@pytest.mark.parametrize("seed", [1, 2])
def test_due_date_cutoffs_equal_the_row_by_row_rules(spark, seed):
    _, invoices, promises, actions = random_case(seed)
    cutoffs = [(v[0], v[0], midnight(v[5])) for v in invoices]
    got = rolled(spark, invoices, promises, actions, cutoffs, midnight=True, own_may_be_known=False)
    assert len(got) == len(invoices)
    for own in invoices:
        assert_same(got[own[0]], expected(own, midnight(own[5]), invoices, promises, actions, dict(STARTS)[own[1]]), own)


@pytest.mark.parametrize("seed", [3, 4])
def test_timed_cutoffs_equal_the_row_by_row_rules(spark, seed):
    rng, invoices, promises, actions = random_case(seed)
    cutoffs = []
    for i in range(150):
        own = rng.choice(invoices)
        other = rng.choice(invoices)
        at = midnight(other[5]) + dt.timedelta(days=rng.choice([-3, 0, 1, 20, 90, 160]), hours=rng.choice([0, 0, 9, 23]))
        if rng.random() < 0.3 and other[7]:
            at = other[7] + dt.timedelta(hours=rng.choice([0, 1]))
        cutoffs.append((i, own[0], at))
    got = rolled(spark, invoices, promises, actions, cutoffs, midnight=False, own_may_be_known=True)
    by_id = {v[0]: v for v in invoices}
    assert len(got) == len(cutoffs)
    for qid, inv, at in cutoffs:
        own = by_id[inv]
        assert_same(got[qid], expected(own, at, invoices, promises, actions, dict(STARTS)[own[1]]), (qid, own, at))


def two_invoices():
    first = invoice(1, 1, dt.date(2024, 1, 5), dt.date(2024, 2, 1), "paid", dt.datetime(2024, 2, 3), "10000.00")
    second = invoice(2, 1, dt.date(2024, 5, 1), dt.date(2024, 6, 1), "paid", dt.datetime(2024, 6, 10), "20000.00")
    promises = [promise(1, 1, "kept"), promise(2, 2, "kept")]
    actions = [action(1, 1, "escalate", dt.datetime(2024, 1, 20)), action(2, 2, "escalate", dt.datetime(2024, 5, 15))]
    return [first, second], promises, actions


def test_own_promise_and_action_are_not_seen(spark):
    rows = {r.invoice_id: r for r in FE.recovery_features(domain(spark, *two_invoices())).collect()}
    assert (rows[2].prior_invoice_count, rows[2].prior_promise_count, rows[2].prior_escalation_touches_avg) == (1, 1, 1.0)
    first = rows[1]
    assert first.has_prior_history is False and first.prior_invoice_count == 0 and first.prior_payment_rate is None
    assert first.customer_invoice_frequency == 0.0 and first.prior_total_amount == 0.0


def test_write_off_is_known_only_after_the_bound_and_payment_strictly_before(spark):
    off = invoice(1, 1, dt.date(2023, 1, 1), dt.date(2023, 2, 1), "written_off")
    at = midnight(off[5])
    paid = invoice(2, 1, dt.date(2023, 1, 1), dt.date(2023, 2, 1), "paid", at + 9 * DAY)
    lost = invoice(3, 1, dt.date(2023, 1, 1), dt.date(2023, 2, 1), "paid", None)
    asks = [invoice(4, 1, dt.date(2023, 1, 1), dt.date(2024, 1, 1), "open")]
    cutoffs = [(1, 4, at + 150 * DAY), (2, 4, at + 151 * DAY), (3, 4, at + 9 * DAY), (4, 4, at + 10 * DAY)]
    got = rolled(spark, [off, paid, lost, *asks], [], [], cutoffs, midnight=False, own_may_be_known=True)
    assert [got[i]["prior_invoice_count"] for i in (1, 2, 3, 4)] == [1, 2, 0, 1]


def test_future_rows_change_nothing(spark):
    _, invoices, promises, actions = random_case(5, 60)
    last = max(v[5] for v in invoices)
    later = [invoice(1000 + i, 1, last + 10 * DAY, last + (20 + i) * DAY, "paid", midnight(last) + 300 * DAY) for i in range(20)]
    columns = ["invoice_id", *[c for c in FE.P.NUMERIC_FEATURES]]
    before = FE.recovery_features(domain(spark, invoices, promises, actions, customers=STARTS)).select(*columns)
    after = FE.recovery_features(domain(spark, invoices + later, promises, actions, customers=STARTS)).filter("invoice_id < 1000").select(*columns)
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_recent_short_payment_rate_is_one_or_null(spark):
    _, invoices, promises, actions = random_case(6, 150)
    rates = FE.recovery_features(domain(spark, invoices, promises, actions, customers=STARTS)).select("recent_90d_payment_rate").distinct()
    assert {r[0] for r in rates.collect()} <= {1.0, None}


def test_simulated_resolutions_leave_the_training_rows(spark):
    from decimal import Decimal

    invoices, promises, actions = two_invoices()
    payments = [(1, Decimal("1.00"), dt.date(2024, 2, 3), "attribution_simulation", "completed")]
    rows = FE.recovery_features(domain(spark, invoices, promises, actions, payments)).collect()
    assert [r.invoice_id for r in rows] == [2] and rows[0].prior_invoice_count == 0


def test_cutoff_before_the_relationship_gives_null(spark):
    invoices, promises, actions = two_invoices()
    d = domain(spark, invoices, promises, actions, customers=((1, dt.date(2025, 1, 1)),))
    row = FE.recovery_features(d).filter("invoice_id = 2").first()
    assert row.customer_relationship_days_at_cutoff is None and row.customer_invoice_frequency is None


def test_root_cause_label_rejects_disputed_rows(spark):
    d = domain(spark, [invoice(1, 1, dt.date(2024, 1, 1), dt.date(2024, 2, 1), "paid", dt.datetime(2024, 2, 2), cause="dispute")])
    with pytest.raises(Exception, match="disputed row"):
        d.invoices.select(FE.root_cause_label()).collect()
    assert FE.root_cause_table(d).count() == 0
