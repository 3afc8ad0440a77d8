"""Decision-log shapes, stored reads, writers and quality rules."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import ntz
from duewise.operators import audit, quality, reads
from duewise.session import new_path
from duewise.sources import keyed, sinks
from duewise.sources.schema import TABLES
from duewise.sources.tables import Domain, read_domain
from duewise.streaming.accounts import with_empty_round

ROUND = (
    "event_id BIGINT, invoice_id BIGINT, event_type STRING, payload MAP<STRING,STRING>, occurred_at TIMESTAMP_NTZ, is_disputed BOOLEAN, "
    "is_actually_paid BOOLEAN, state_transition_path ARRAY<STRING>, next_state STRING, selected_action STRING, policy_result STRING, "
    "policy_reason STRING, ptp_probability DOUBLE, recovery_probability DOUBLE, error STRING"
)
AT = dt.datetime(2026, 8, 27, 12)


def test_three_log_shapes(spark):
    rows = [
        (1, 1, "invoice.overdue", {}, AT, False, False, ["remind"], "remind", "email", "allowed", "no policy constraints triggered", None, 0.5, None),
        (2, 1, "promise.created", {"source": "voice"}, AT, False, False, ["promise"], "promise", None, None, None, 0.7, None, None),
        (3, 1, "promise.created", {}, AT, None, None, None, None, None, None, None, None, None, "invalid event"),
    ]
    got = audit.event_decision_logs(with_empty_round(spark.createDataFrame(rows, ROUND))).orderBy("event_id").collect()
    full, promise, rejected = got
    assert [r.decision for r in got] == ["email", "promise", "rejected"]
    assert [r.reason for r in got] == ["no policy constraints triggered", "promise recorded -- account moved to promise", "invalid event"]
    assert json.loads(full.model_scores) == {"recovery_probability": 0.5, "ptp_probability": None, "root_cause": None}
    assert json.loads(promise.model_scores)["ptp_probability"] == 0.7
    assert json.loads(full.policy_checks)["policy_result"] == "allowed"
    assert "selected_action" not in json.loads(promise.policy_checks)
    assert json.loads(rejected.policy_checks)["state_transition_path"] == []
    assert json.loads(promise.evidence)["trigger_event"] == {"event_type": "promise.created", "payload": {"source": "voice"}}


def test_reason_rewrite_is_idempotent(spark):
    rows = [("email failed after 2 attempt(s): socket closed",), (P.OLD_CLOSING_REASON,), ("email failed after 2 attempt(s), fell back to wait",), ("other",)]
    once = audit.rewrite_reasons(spark.createDataFrame(rows, "reason STRING"))
    assert [r.reason for r in once.collect()] == ["email failed after 2 attempt(s), fell back to wait", P.CLOSING_REASON, rows[2][0], "other"]
    assert audit.rewrite_reasons(once).exceptAll(once).isEmpty()


def log(i, inv, at, p=None, reason="r", decision="wait", created=None):
    scores = json.dumps({"recovery_probability": p, "ptp_probability": None, "root_cause": None})
    return (str(i), inv, decision, scores, '{"trigger_event":{"event_type":"invoice.overdue"}}', "{}", reason, at, created or at)


def logs(spark, *rows):
    return spark.createDataFrame(rows, TABLES["decision_logs"])


def test_trace_falls_back_to_the_newest_scored_log(spark):
    later, latest = AT + dt.timedelta(days=1), AT + dt.timedelta(days=2)
    rows = logs(spark, log(1, 1, AT, 0.1), log(2, 1, later, 0.2), log(3, 1, latest, None, decision="stop"), log(4, 2, AT, None), log(5, 3, AT, 0.3),
                log(6, 3, AT, 0.4, created=later))
    got = {r.invoice_id: r for r in audit.decision_trace(rows).collect()}
    assert got[1].decision == "stop" and json.loads(got[1].model_scores)["recovery_probability"] == 0.2 and got[1].assessed_at == later
    assert got[2].assessed_at is None and json.loads(got[2].model_scores)["recovery_probability"] is None
    assert json.loads(got[3].model_scores)["recovery_probability"] == 0.4 and got[3].assessed_at is None


def test_closing_log_is_always_last_and_written_once(spark):
    payments = spark.createDataFrame(
        [(1, Decimal("5.00"), dt.date(2026, 7, 1), P.SIMULATED_PAYMENT_METHOD, "completed")] * 2 + [(2, Decimal("5.00"), dt.date(2026, 9, 1), P.SIMULATED_PAYMENT_METHOD, "completed"),
         (3, Decimal("5.00"), dt.date(2026, 9, 1), P.SIMULATED_PAYMENT_METHOD, "completed"), (4, Decimal("5.00"), dt.date(2026, 9, 1), "upi", "completed")], TABLES["payments"])
    stored = logs(spark, log(1, 1, AT), log(2, 2, AT), log(3, 3, AT, reason=P.CLOSING_REASON))
    new = audit.missing_closing_logs(payments, stored)
    assert {r.invoice_id: r.timestamp for r in new.collect()} == {1: AT + dt.timedelta(minutes=1), 2: dt.datetime(2026, 9, 1)}
    both = stored.drop("id", "created_at").unionByName(new)
    assert audit.missing_closing_logs(payments, both).isEmpty()


STATE = "invoice_id BIGINT, current_state STRING, score DOUBLE"


def table(spark, rows, buckets=16):
    path = new_path(spark, "state")
    keyed.create(spark.createDataFrame(rows, STATE), path, ["invoice_id"], buckets)
    return path


def stored(spark, path, version=None):
    return sorted((tuple(r) for r in keyed.read(spark, path, version).collect()), key=str)


def test_upsert_keeps_what_was_not_recomputed(spark):
    path = table(spark, [(1, "wait", 0.1), (2, "remind", 0.2), (None, "wait", 0.4)])
    keyed.upsert(spark.createDataFrame([(2, "promise", None), (3, "wait", 0.9), (None, "kept", None)], STATE), path, ["invoice_id"])
    assert stored(spark, path) == [(1, "wait", 0.1), (2, "promise", 0.2), (3, "wait", 0.9), (None, "kept", 0.4)]
    assert stored(spark, path, 0) == [(1, "wait", 0.1), (2, "remind", 0.2), (None, "wait", 0.4)]


def test_an_update_of_one_key_writes_one_bucket(spark):
    path = table(spark, [(i, "wait", 0.5) for i in range(300)])
    before = keyed.manifest(spark, path)
    touched = keyed.upsert(spark.createDataFrame([(7, "kept", None)], STATE), path, ["invoice_id"])
    after = keyed.manifest(spark, path)
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == touched
    assert len(keyed._names(spark, f"{path}/data/version=000000000001")) == 2  # that bucket and the marker of the job
    assert stored(spark, path) == sorted([(i, "kept" if i == 7 else "wait", 0.5) for i in range(300)], key=str)
    assert keyed.upsert(spark.createDataFrame([], STATE), path, ["invoice_id"]) == [] and len(stored(spark, path)) == 300


def test_a_crash_before_the_switch_leaves_the_old_table(spark, monkeypatch):
    path = table(spark, [(1, "wait", 0.1), (2, "wait", 0.2)])
    update = spark.createDataFrame([(1, "kept", 0.9)], STATE)
    with monkeypatch.context() as broken:
        broken.setattr(keyed, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            keyed.upsert(update, path, ["invoice_id"])
    assert stored(spark, path) == [(1, "wait", 0.1), (2, "wait", 0.2)] and keyed.versions(spark, path) == [0]
    keyed.upsert(update, path, ["invoice_id"])
    assert stored(spark, path) == [(1, "kept", 0.9), (2, "wait", 0.2)]


def test_a_batch_that_runs_again_and_a_second_writer(spark):
    path = table(spark, [(1, "wait", 0.1)])
    update = spark.createDataFrame([(1, "kept", 0.9), (5, "wait", 0.5)], STATE)
    for _ in range(2):
        keyed.upsert(update, path, ["invoice_id"], base=0)
    assert stored(spark, path) == [(1, "kept", 0.9), (5, "wait", 0.5)] and keyed.versions(spark, path) == [0, 1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        keyed.commit(spark, path, 1, keyed.manifest(spark, path, 0))


def test_vacuum_removes_only_what_no_kept_version_names(spark):
    path = table(spark, [(i, "wait", 0.5) for i in range(40)], buckets=4)
    for n in range(3):
        keyed.upsert(spark.createDataFrame([(n, "kept", None)], STATE), path, ["invoice_id"])
    want = stored(spark, path), stored(spark, path, 2)
    gone = keyed.vacuum(spark, path)
    assert gone and keyed.versions(spark, path) == [2, 3]
    assert (stored(spark, path), stored(spark, path, 2)) == want and keyed.vacuum(spark, path) == []


def test_promises_keep_their_id_in_a_keyed_table(spark):
    schema = "id BIGINT, invoice_id BIGINT, promised_amount DOUBLE, promised_date DATE, status STRING, source STRING, confidence_score DOUBLE, created_at TIMESTAMP_NTZ"
    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    path = new_path(spark, "promises")
    keyed.create(spark.createDataFrame([(1, 10, 5.0, day, "open", "sms", 0.1, at), (2, 10, 4.0, day, "kept", "sms", 0.2, at), (3, 11, 1.0, day, "broken", "sms", 0.2, at)], schema), path, ["invoice_id"], 8)
    new = spark.createDataFrame([(90, 10, 7.0, day + dt.timedelta(9), "voice", 0.9, at), (91, 11, 8.0, day, "voice", 0.8, at)], schema.replace("status STRING, ", ""))
    keyed.upsert(new, path, ["invoice_id"], sinks.merged_open_promises)
    got = sorted((r.id, r.invoice_id, r.promised_amount, r.status) for r in keyed.read(spark, path).collect())
    assert got == [(1, 10, 7.0, "open"), (2, 10, 4.0, "kept"), (3, 11, 1.0, "broken"), (91, 11, 8.0, "open")]


def test_partition_overwrite_leaves_other_experiments(spark):
    path = new_path(spark, "slices")
    part = lambda e, n: spark.createDataFrame([(e, n)], "experiment_id STRING, n INT")
    for e, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.overwrite_partitions(part(e, n), path, ["experiment_id"])
    assert sorted((r.experiment_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_domain_round_trip_through_files(spark):
    root = new_path(spark, "domain")
    spark.createDataFrame([(1, "retail", "SMB", dt.date(2020, 1, 1))], TABLES["merchants"]).write.parquet(f"{root}/merchants")
    assert read_domain(spark, root).merchants.first().industry == "retail"
    with pytest.raises(AttributeError):
        read_domain(spark, root).unknown


def test_list_predicates(spark):
    rows = spark.createDataFrame([(1, "INV-10184", "SMB", "wait", dt.date(2024, 1, 2)), (2, "inv-77%", "SMB", "wait", dt.date(2024, 1, 1)), (3, "INV-9", "MID", "kept", dt.date(2024, 1, 1))],
                                 "invoice_id INT, invoice_number STRING, segment STRING, current_state STRING, due_date DATE")
    ids = lambda df: sorted(r.invoice_id for r in df.collect())
    assert ids(reads.filtered(rows, number_part="inv-1")) == [1]
    assert ids(reads.filtered(rows, number_part="%")) == [2]
    assert ids(reads.filtered(rows, state="wait", segment="SMB")) == [1, 2]
    with pytest.raises(ValueError, match="Unknown"):
        reads.filtered(rows, state="nope")
    with pytest.raises(ValueError):
        reads.page(rows, limit=501)
    assert [r.invoice_id for r in reads.page(rows, limit=2, offset=1).collect()] == [3, 1]


def clean_domain(spark, **bad):
    """A dataset that breaks no row rule, plus the given bad rows."""
    tables = {
        "merchants": [(1, "retail", "SMB", dt.date(2020, 1, 1))],
        "customers": [(1, 1, "C", "tech", "SMB", dt.date(2020, 1, 1), "chronic_late", 0.5, 0.5)],
        "invoices": [(1, 1, "N1", Decimal("6000.00"), dt.date(2025, 1, 1), dt.date(2025, 2, 1), "paid", dt.datetime(2025, 2, 2), "oversight")],
        "payments": [(1, Decimal("6000.00"), dt.date(2025, 2, 2), "upi", "completed")],
        "payment_promises": [(1, 1, Decimal("5.00"), dt.date(2025, 2, 1), "voice", 0.5, "kept", AT)],
        "recovery_actions": [(1, 1, "email", 0.0, Decimal("5.00"), "allowed", "sent", AT)],
        "interactions": [("1", 1, None, "email", "", "", "", Decimal("0.00"), AT)],
        "account_state": [(1, "closed_paid", 0.5, 0.0, None, 0.0, "stop", AT)],
    }
    for table, rows in bad.items():
        tables[table] = tables[table] + rows
    names = {"promises": "payment_promises", "actions": "recovery_actions"}
    return Domain(lambda t: spark.createDataFrame(tables[names.get(t, t)], TABLES[names.get(t, t)]))


NOW = "2026-08-27 12:00:00"
INV = (1, "N2", Decimal("6000.00"), dt.date(2025, 1, 1), dt.date(2025, 2, 1), "open", None, "oversight")


def inv(**changes):
    names = ["customer_id", "invoice_number", "amount", "issue_date", "due_date", "status", "paid_at", "true_root_cause"]
    return [(2, *{**dict(zip(names, INV)), **changes}.values())]


@pytest.mark.parametrize("bad, rule", [
    ({"payments": [(9, Decimal("1.00"), dt.date(2025, 2, 2), "upi", "completed")]}, "payments.invoice_id"),
    ({"customers": [(2, 9, "C", "t", "SMB", dt.date(2020, 1, 1), "chronic_late", 0.5, 0.5)]}, "customers.merchant_id"),
    ({"interactions": [("2", 1, 9, "email", "", "", "", Decimal("0.00"), AT)]}, "interactions.invoice_id (where set)"),
    ({"invoices": inv()}, "invoices without account_state"),
    ({"invoices": inv(due_date=dt.date(2024, 12, 1))}, "due_date before issue_date"),
    ({"invoices": inv(status="paid")}, "paid without paid_at"),
    ({"invoices": inv(paid_at=AT)}, "paid_at without paid"),
    ({"payments": [(1, Decimal("0.00"), dt.date(2024, 12, 1), "upi", "completed")]}, "payment before issue_date"),
    ({"payments": [(1, Decimal("0.00"), dt.date(2026, 8, 28), "upi", "completed")]}, "payment in the future"),
    ({"invoices": inv(status="written_off", due_date=dt.date(2026, 8, 1))}, "premature write-off"),
    ({"payments": [(1, Decimal("0.02"), dt.date(2025, 2, 2), "upi", "completed")]}, "paid invoice with other payment total"),
    ({"invoices": inv(invoice_number="N1")}, "duplicate invoice_number"),
    ({"invoices": inv(true_root_cause=None)}, "missing true_root_cause"),
    ({"invoices": inv(amount=Decimal("4999.99"))}, "amount out of bounds"),
    ({"recovery_actions": [(2, 1, "email", 0.0, Decimal("-1.00"), "allowed", "sent", AT)]}, "negative action cost"),
])
def test_each_rule_reports_its_one_bad_row(spark, bad, rule):
    found = {r.rule: r.violations for r in quality.all_rules(clean_domain(spark, **bad), ntz(NOW)).collect()}
    assert found[rule] == 1
    clean = {r.rule: r.violations for r in quality.all_rules(clean_domain(spark), ntz(NOW)).collect()}
    assert clean[rule] == 0


def test_unknown_labels_are_reported(spark):
    d = clean_domain(spark, invoices=inv(status="lost"))
    assert {r.rule: r.violations for r in quality.enum_domains(d).collect()}["invoices.status"] == 1


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = quality.fingerprint(clean_domain(spark, invoices=inv())).first()[0]
    d = clean_domain(spark, invoices=inv())
    shuffled = Domain(lambda t: getattr(d, t).orderBy(F.desc(getattr(d, t).columns[0])) if t == "invoices" else getattr(d, t))
    assert quality.fingerprint(shuffled).first()[0] == a
    assert quality.fingerprint(clean_domain(spark, invoices=inv(amount=Decimal("6000.01")))).first()[0] != a
