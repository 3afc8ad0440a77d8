"""Queries on splits and metrics. The score is a given column, so SQL can check every number."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import metrics as M
from duewise.operators import sampling as SP
from duewise.operators.features import promise_cutoffs, recovery_label, with_archetype
from duewise.queries.registry import query
from duewise.queries.sqlviews import fdays, r, sql, view
from duewise.sources.driver_tables import with_probability
from duewise.sources.tables import organic_history


def labelled(x):
    past = organic_history(x.d.invoices, x.d.payments).withColumnRenamed("id", "invoice_id")
    return past.select("invoice_id", "customer_id", "issue_date", recovery_label().alias("recovery_label"))


def scored(x):
    """Resolved history with its label and a score that leans towards it."""
    rows = with_probability(labelled(x))
    p = (F.col("base_probability") + F.col("recovery_label") * 0.3) / 1.3
    return rows.select("invoice_id", "customer_id", F.col("recovery_label").alias("y"), p.alias("p"))


view("labelled", f"""SELECT id AS invoice_id, customer_id, issue_date, (CASE WHEN status = 'paid' AND {fdays('due_date::TIMESTAMP', 'paid_at')} <= 60
  THEN 1 ELSE 0 END)::BIGINT AS recovery_label FROM past""")
view("scored", "SELECT invoice_id, customer_id, recovery_label AS y, (0.05::DOUBLE + (invoice_id % 90)::DOUBLE / 100.0 + recovery_label * 0.3::DOUBLE) / 1.3::DOUBLE AS p FROM labelled")


def split_views(name: str, source: str, date: str, label: str, key: str) -> None:
    view(f"bounds0_{name}", f"SELECT min({date})::TIMESTAMP AS lo, round_even({fdays(f'min({date})::TIMESTAMP', f'max({date})::TIMESTAMP')} * 9 / 11, 0)::INT AS train_days FROM {source}")
    view(f"bounds_{name}", f"SELECT lo, lo + to_days(train_days) AS boundary, lo + to_days(train_days) - to_days(round_even(train_days / 9, 0)::INT) AS fit_val FROM bounds0_{name}")
    view(f"parts_{name}", f"SELECT s.*, CASE WHEN s.{date} >= b.boundary THEN 'test' WHEN s.{date} >= b.fit_val THEN 'validation' ELSE 'pool' END AS part FROM {source} s, bounds_{name} b")
    view(f"split_{name}", f"""SELECT * EXCLUDE (part, rn, n), CASE WHEN part <> 'pool' THEN part WHEN rn <= round_even(n * {P.CALIBRATION_FRACTION}, 0) THEN 'calibration' ELSE 'fit' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY part, {label} ORDER BY md5('{P.SEED}:' || {label} || ':' || {key}), {key}) AS rn,
      count(*) OVER (PARTITION BY part, {label}) AS n FROM parts_{name})""")


split_views("recovery", "labelled", "issue_date", "recovery_label", "invoice_id")
view("promise_rows", """SELECT p.id AS promise_id, i.customer_id, p.T, (p.status = 'kept')::BIGINT AS kept FROM promise_cut p JOIN past i ON i.id = p.invoice_id
  WHERE p.status IN ('kept', 'broken')""")
split_views("promise", "promise_rows", "T", "kept", "promise_id")
view("split_customer", f"""SELECT l.*, CASE WHEN c.rn > n_train THEN 'test' WHEN c.rn <= round_even(n_train * {P.CUSTOMER_VALIDATION_FRACTION}, 0) THEN 'validation' ELSE 'fit' END AS split
  FROM labelled l JOIN (SELECT customer_id, row_number() OVER (ORDER BY md5('{P.SEED}:' || customer_id), customer_id) AS rn,
  round_even(count(*) OVER () * {P.CUSTOMER_TRAIN_FRACTION}, 0) AS n_train FROM (SELECT DISTINCT customer_id FROM labelled)) c ON c.customer_id = l.customer_id""")


def promise_rows(x):
    past = organic_history(x.d.invoices, x.d.payments).select(F.col("id").alias("invoice_id"), "customer_id")
    closed = x.d.promises.filter(F.col("status").isin("kept", "broken"))
    rows = promise_cutoffs(closed, x.d.actions).join(past, "invoice_id")
    return rows.select(F.col("id").alias("promise_id"), "customer_id", "T", (F.col("status") == "kept").cast("int").alias("kept"))


@query("O117_time_split", sql("SELECT invoice_id, split FROM split_recovery"))
def time_split(x):
    return SP.time_split(labelled(x), "issue_date", "recovery_label", "invoice_id").select("invoice_id", "split")


@query("O117_time_split_promises", sql("SELECT promise_id, split FROM split_promise"))
def time_split_promises(x):
    return SP.time_split(promise_rows(x), "T", "kept", "promise_id").select("promise_id", "split")


@query("O118_customer_split", sql("SELECT invoice_id, split FROM split_customer"))
def customer_split(x):
    return SP.customer_split(labelled(x)).select("invoice_id", "split")


@query("O119_split_summary", sql("""SELECT split, count(*) AS n, count(DISTINCT customer_id) AS customers, strftime(min(issue_date), '%Y-%m-%d') AS first_date,
  strftime(max(issue_date), '%Y-%m-%d') AS last_date FROM split_recovery GROUP BY 1"""))
def split_summary(x):
    return SP.split_summary(SP.time_split(labelled(x), "issue_date", "recovery_label", "invoice_id"), "issue_date")


@query("O119_one_sided_customers", sql("""SELECT count(*) FILTER (tr AND NOT te) AS train_only, count(*) FILTER (te AND NOT tr) AS test_only FROM (
  SELECT customer_id, bool_or(split = 'test') AS te, bool_or(split <> 'test') AS tr FROM split_recovery GROUP BY 1)"""))
def one_sided(x):
    return SP.one_sided_customers(SP.time_split(labelled(x), "issue_date", "recovery_label", "invoice_id"))


@query("O093_classification_metrics", sql(f"""SELECT count(*) AS n, {r('avg(y)')} AS positive_rate,
  {r('(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))')} AS roc_auc,
  {r('sum(y * tp / flagged) / sum(y)')} AS pr_auc, {r('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS log_loss, {r('avg((y - p) * (y - p))')} AS brier
  FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk,
    sum(y) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS flagged FROM scored)"""))
def metrics(x):
    return M.classification_metrics(scored(x))


@query("O094_reliability_table", sql(f"""SELECT b.bin, count(s.p) AS n, {r('avg(s.p)')} AS mean_predicted, {r('avg(s.y)')} AS observed_rate
  FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN scored s ON least(floor(s.p * 10)::INT, 9) = b.bin GROUP BY 1"""))
def reliability(x):
    return M.reliability_table(scored(x))


@query("O095_archetype_sanity", sql(f"""SELECT archetype, count(*) AS n, {r('avg(true_recovery_probability)')} AS true_organic_probability,
  {r('avg(p)')} AS mean_predicted_probability, {r('avg(y)')} AS observed_rate FROM scored s JOIN customers c ON c.id = s.customer_id GROUP BY 1"""))
def sanity(x):
    return M.archetype_sanity(with_archetype(scored(x), x.d.customers))


view("test_scored", "SELECT s.* FROM scored s JOIN split_recovery t ON t.invoice_id = s.invoice_id WHERE t.split = 'test'")
view("sanity_source", f"""SELECT * FROM test_scored WHERE (SELECT min(n) FROM (SELECT count(*) AS n FROM test_scored s JOIN customers c ON c.id = s.customer_id GROUP BY c.archetype)) >= {P.MIN_ARCHETYPE_ROWS}
  UNION ALL SELECT * FROM scored WHERE (SELECT min(n) FROM (SELECT count(*) AS n FROM test_scored s JOIN customers c ON c.id = s.customer_id GROUP BY c.archetype)) < {P.MIN_ARCHETYPE_ROWS}""")


@query("O095_archetype_sanity_fallback", sql(f"""SELECT archetype, count(*) AS n, {r('avg(true_recovery_probability)')} AS true_organic_probability,
  {r('avg(p)')} AS mean_predicted_probability, {r('avg(y)')} AS observed_rate FROM sanity_source s JOIN customers c ON c.id = s.customer_id GROUP BY 1"""))
def sanity_fallback(x):
    test = SP.time_split(labelled(x), "issue_date", "recovery_label", "invoice_id").filter("split = 'test'").select("invoice_id")
    full = with_archetype(scored(x), x.d.customers)
    return M.archetype_sanity_with_fallback(full.join(test, "invoice_id", "left_semi"), full)


@query("O096_broken_class_metrics", sql(f"""SELECT 0.5::DOUBLE AS threshold, {r('tp / nullif(f, 0)')} AS precision, {r('tp / nullif(b, 0)')} AS recall, {r('2 * tp / nullif(f + b, 0)')} AS f1 FROM (
  SELECT count(*) FILTER (y = 0 AND p < 0.5) AS tp, count(*) FILTER (p < 0.5) AS f, count(*) FILTER (y = 0) AS b FROM scored)"""))
def broken(x):
    return M.broken_class_metrics(scored(x))


@query("O104_tie_averaged_rank", sql(f"SELECT {r('p')} AS p, {r('any_value(rk)')} AS avg_rank, count(*) AS rows FROM (SELECT p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored) s GROUP BY s.p"))
def ranks(x):
    return M.tie_averaged_ranks(scored(x))
