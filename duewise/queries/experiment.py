"""Queries on assignment, outcomes and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import attribution as A
from duewise.operators import audit
from duewise.operators.sampling import assign_arms
from duewise.plans import decisions as PD
from duewise.plans import experiment as X
from duewise.queries.decisions import decisions
from duewise.queries.registry import query
from duewise.queries.sqlviews import AS_OF, day, md5_prefix, r, rr, sql, ts, view
from duewise.session import materialise
from duewise.sources.driver_tables import outcome_draws, with_probability

_DRAW = md5_prefix("'outcome:' || a.invoice_id", 8)

view("eligible", "SELECT c.*, k.segment, k.archetype FROM ctx c JOIN customers k ON k.id = c.customer_id WHERE NOT c.is_actually_paid AND NOT c.is_disputed")
view("arms", f"""SELECT *, CASE WHEN rn <= round_even(n * 0.5, 0) THEN 'acted' ELSE 'control' END AS treatment_group FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5('{P.SEED}:' || segment || ':' || invoice_id), invoice_id) AS rn,
  count(*) OVER (PARTITION BY segment) AS n FROM eligible)""")
view("drawn", f"""SELECT a.*, {_DRAW} % 100 < 70 AS recovered_ever, CASE WHEN {_DRAW} % 100 < 70 THEN ({_DRAW} % 97)::INT END AS delay FROM arms a""")
view("gated", f"""SELECT *, CASE WHEN recovered THEN amount ELSE 0.0 END AS recovered_amount, CASE WHEN recovered_ever THEN due_date + delay END AS recovery_date,
  CASE WHEN recovered THEN least(due_date + delay, {AS_OF}::DATE - 1) END AS ledger_date
  FROM (SELECT *, coalesce(recovered_ever AND delay <= {P.HORIZON_DAYS}, false) AS recovered FROM drawn)""")
view("experiment", """SELECT g.*, CASE WHEN treatment_group = 'acted' THEN d.final_action END AS action,
  CASE WHEN treatment_group = 'control' THEN f.final_action END AS counterfactual_action,
  floor(g.base_probability * g.amount * 100 + 0.5) / 100 AS predicted, floor(recovered_amount * 100 + 0.5) / 100 AS observed
  FROM gated g JOIN decided d USING (invoice_id) JOIN decided_cf f USING (invoice_id)""")
view("sliced", "SELECT *, CASE WHEN treatment_group = 'acted' THEN action ELSE counterfactual_action END AS slice_action, observed > 0 AS hit FROM experiment")


def cube_sql(dim: str, sets: str, source: str = "sliced") -> str:
    arm = lambda c, g: f"coalesce(sum({c}) FILTER (treatment_group = '{g}'), 0)"
    return f"""SELECT *, t_rate - c_rate AS incremental_recovery_rate, t_rec - c_rate * t_amount AS increment,
      t_rec - c_rate * t_amount - cost - drag AS net, CASE WHEN nt > 0 AND nc > 0 THEN sqrt(p1 * (1 - p1) / nt + p2 * (1 - p2) / nc) END AS se FROM (
      SELECT *, coalesce(t_rec / nullif(t_amount, 0), 0) AS t_rate, coalesce(c_rec / nullif(c_amount, 0), 0) AS c_rate,
      t_hits / nullif(nt, 0) AS p1, c_hits / nullif(nc, 0) AS p2 FROM (
      SELECT {dim}, slice_action, grouping({dim}) AS g1, grouping(slice_action) AS g2,
      count(*) FILTER (treatment_group = 'acted') AS nt, count(*) FILTER (treatment_group = 'control') AS nc,
      {arm('observed', 'acted')} AS t_rec, {arm('observed', 'control')} AS c_rec, {arm('amount', 'acted')} AS t_amount, {arm('amount', 'control')} AS c_amount,
      {arm('p.cost', 'acted')} AS cost, {arm('p.friction', 'acted')} AS drag,
      count(*) FILTER (treatment_group = 'acted' AND hit) AS t_hits, count(*) FILTER (treatment_group = 'control' AND hit) AS c_hits
      FROM {source} s LEFT JOIN action_params p ON p.action = s.action GROUP BY GROUPING SETS ({sets})))
      WHERE (g1 = 1 OR {dim} IS NOT NULL) AND (g2 = 1 OR slice_action IS NOT NULL) AND (g2 = 1 OR nt > 0)"""


view("cube", cube_sql("segment", "(), (segment), (slice_action), (segment, slice_action)"))
view("arch_cube", cube_sql("archetype", "(archetype, slice_action)"))
_z = "CASE WHEN se > 0 THEN (p1 - p2) / se WHEN se = 0 THEN 0 END"
_cube_cols = f"""slice_action AS action, nt AS treatment_n, nc AS control_n, {r('t_rate', 4)} AS treatment_recovery_rate, {r('c_rate', 4)} AS control_recovery_rate,
  {r('incremental_recovery_rate', 4)} AS incremental_recovery_rate, {r('t_rec', 4)} AS treatment_recovered_amount, {r('c_rec', 4)} AS control_recovered_amount,
  {r('increment', 4)} AS incremental_recovered_amount, {r('cost', 4)} AS treatment_cost, {r('drag', 4)} AS treatment_friction, {r('net', 4)} AS incremental_net_recovery,
  {r('p1', 4)} AS treatment_count_recovery_rate, {r('p2', 4)} AS control_count_recovery_rate, {r('se', 4)} AS recovery_rate_diff_se, {r(_z, 4)} AS recovery_rate_diff_z"""


def arms(x):
    return X.arms(x.d, with_probability, x.as_of, x.now_utc)


def outcomes(x):
    return X.outcomes(arms(x), outcome_draws, x.as_of)


def rows(x):
    """The stored experiment: records are written once and every report reads them."""
    return materialise(X.experiment_rows(x.d, with_probability, outcome_draws, x.as_of, x.now_utc), "experiment")


@query("O004_attribution_load", sql(f"""SELECT invoice_id, treatment_group, action, counterfactual_action, segment, archetype, {r('amount', 2)} AS amount,
  {r('predicted', 2)} AS baseline_predicted_recovery, {r('observed', 2)} AS observed_recovery, observed > 0 AS recovered FROM experiment"""), digits=2)
def load(x):
    return rows(x).drop("customer_id", "incremental_recovery")


@query("O039_horizon_gate", sql(f"""SELECT invoice_id, recovered, {r('recovered_amount', 2)} AS recovered_amount, {day('recovery_date')} AS recovery_date,
  {day('ledger_date')} AS ledger_payment_date FROM gated"""), digits=2)
def gate(x):
    return outcomes(x).select("invoice_id", "recovered", "recovered_amount", "recovery_date", "ledger_payment_date")


@query("O039_horizon_sensitivity", sql(f"""SELECT h AS horizon, count(*) AS n, {r('avg(coalesce(recovered_ever AND delay <= h, false)::INT)')} AS recovery_rate
  FROM drawn, (SELECT unnest([30, 45, 60, 90])::BIGINT AS h) WHERE treatment_group = 'control' GROUP BY 1"""))
def sensitivity(x):
    assigned = assign_arms(X.population(x.d, x.as_of)).filter("treatment_group = 'control'")
    return A.horizon_sensitivity(outcome_draws(assigned), x.as_of)


@query("O040_attribution_record", sql(f"""SELECT invoice_id, treatment_group, {r('predicted', 2)} AS baseline_predicted_recovery,
  {r('observed', 2)} AS observed_recovery, NULL::DOUBLE AS incremental_recovery, action, counterfactual_action FROM experiment"""), digits=2)
def records(x):
    return A.attribution_records(outcomes(x))


@query("O041_eligibility", sql("SELECT invoice_id FROM eligible"))
def eligible(x):
    return X.population(x.d, x.as_of).filter(~F.col("is_actually_paid") & ~F.col("is_disputed")).select("invoice_id")


@query("O063_write_back", sql(f"""SELECT g.invoice_id, {r('(floor(g.recovered_amount * 100 + 0.5) - coalesce(p.done, 0)) / 100.0', 2)} AS amount,
  {day('g.ledger_date')} AS payment_date, '{P.SIMULATED_PAYMENT_METHOD}' AS method, 'completed' AS status FROM gated g
  LEFT JOIN (SELECT invoice_id, sum(cents) AS done FROM payments WHERE status = 'completed' GROUP BY 1) p ON p.invoice_id = g.invoice_id
  WHERE g.recovered AND floor(g.recovered_amount * 100 + 0.5) - coalesce(p.done, 0) > 0"""), digits=2)
def write_back(x):
    return A.write_back(outcomes(x), x.d.payments)


@query("O084_slice_cube", sql(f"SELECT segment, {_cube_cols} FROM cube"), digits=4)
def cube(x):
    return A.slice_cube(rows(x))


@query("O085_amount_rates", sql(f"""SELECT segment, {r('t_rate')} AS treatment_recovery_rate, {r('c_rate')} AS control_recovery_rate, {r('net', 2)} AS incremental_net_recovery
  FROM cube WHERE g2 = 1"""))
def amount_rates(x):
    by_segment = A.slice_cube(rows(x), "segment", [[], ["segment"]])
    return by_segment.select(
        "segment", "treatment_recovery_rate", "control_recovery_rate",
        (F.floor(F.col("incremental_net_recovery") * 100 + 0.5) / 100).alias("incremental_net_recovery"),
    )


@query("O086_count_rates_z", sql(f"""SELECT slice_action AS action, {r('p1')} AS treatment_count_recovery_rate, {r('p2')} AS control_count_recovery_rate,
  {r('se')} AS recovery_rate_diff_se, {r(_z)} AS recovery_rate_diff_z FROM cube WHERE g1 = 1"""))
def count_rates(x):
    return A.slice_cube(rows(x), "segment", [[], ["slice_action"]]).select(
        "action", "treatment_count_recovery_rate", "control_count_recovery_rate", "recovery_rate_diff_se", "recovery_rate_diff_z"
    )


@query("O087_action_by_archetype", sql(f"SELECT archetype, {_cube_cols} FROM arch_cube"), digits=4)
def by_archetype(x):
    return A.action_by_archetype(rows(x))


@query("O088_simpson_check", sql(f"""SELECT action, {r('pooled', 2)} AS pooled, {r('stratified', 2)} AS stratified,
  abs(pooled) >= 1000 AND abs(stratified) >= 1000 AND ((pooled < 0) <> (stratified < 0)) AS sign_flip FROM (
  SELECT c.slice_action AS action, c.increment AS pooled, coalesce(s.total, 0) AS stratified FROM cube c
  LEFT JOIN (SELECT slice_action, sum(increment) AS total FROM arch_cube GROUP BY 1) s ON s.slice_action = c.slice_action WHERE c.g1 = 1 AND c.g2 = 0)"""), digits=2)
def simpson(x):
    return A.simpson_check(rows(x))


# Four digits hold an interpolated amount exactly; two would round ties differently per engine.
@query("O089_amount_by_archetype", sql(f"""SELECT archetype, count(*) AS n, {r('avg(amount)', 4)} AS mean, {r('stddev_samp(amount)', 4)} AS std, {r('min(amount)', 4)} AS min,
  {', '.join(f'{r(f"quantile_cont(amount, {p / 100})", 4)} AS p{p}' for p in (10, 25, 50, 75, 90))}, {r('max(amount)', 4)} AS max
  FROM experiment GROUP BY 1"""), digits=4)
def amounts(x):
    return A.amount_by_archetype(rows(x))


view("metric_rows", """SELECT *, 'count' AS metric, predicted / amount AS x, hit::INT::DOUBLE AS y FROM sliced
  UNION ALL SELECT *, 'amount', predicted, observed FROM sliced""")
view("theta", "SELECT metric, covar_samp(x, y) / var_samp(x) AS theta, corr(x, y) AS corr, avg(x) AS x_mean FROM metric_rows GROUP BY 1")
_side = lambda f, c, g: f"{f}({c}) FILTER (treatment_group = '{g}')"
view("cuped", f"""SELECT *, CASE WHEN nt >= 2 AND nc >= 2 AND vt / nt + vc / nc > 0 THEN sqrt(vt / nt + vc / nc) END AS raw_se,
  CASE WHEN nt >= 2 AND nc >= 2 AND wt / nt + wc / nc > 0 THEN sqrt(wt / nt + wc / nc) END AS cuped_se FROM (
  SELECT metric, segment, slice_action, grouping(segment) AS g1, grouping(slice_action) AS g2, any_value(theta) AS theta, any_value(corr) AS corr,
  count(*) FILTER (treatment_group = 'acted') AS nt, count(*) FILTER (treatment_group = 'control') AS nc,
  {_side('avg', 'y', 'acted')} - {_side('avg', 'y', 'control')} AS raw_effect, {_side('avg', 'adj', 'acted')} - {_side('avg', 'adj', 'control')} AS cuped_effect,
  {_side('var_samp', 'y', 'acted')} AS vt, {_side('var_samp', 'y', 'control')} AS vc, {_side('var_samp', 'adj', 'acted')} AS wt, {_side('var_samp', 'adj', 'control')} AS wc
  FROM (SELECT m.*, t.theta, t.corr, y - t.theta * (x - t.x_mean) AS adj FROM metric_rows m JOIN theta t ON t.metric = m.metric)
  GROUP BY GROUPING SETS ((metric), (metric, segment), (metric, slice_action), (metric, segment, slice_action)))
  WHERE (g1 = 1 OR segment IS NOT NULL) AND (g2 = 1 OR slice_action IS NOT NULL) AND nt > 0 AND nc > 0""")
_cuped = f"""SELECT segment, slice_action AS action, metric, nt AS treatment_n, nc AS control_n, {rr('raw_effect raw_se cuped_effect cuped_se theta corr', 4)},
  {r('(1 - cuped_se / raw_se) * 100', 4)} AS se_reduction_pct FROM cuped"""


@query("O090_cuped_theta", sql(f"SELECT metric, {rr('theta corr x_mean')} FROM theta"))
def theta(x):
    return A.cuped_theta(rows(x))


@query("O091_cuped_slices", sql(_cuped), digits=4)
def cuped(x):
    return A.cuped_slices(rows(x))


@query("O092_cuped_pooled", sql(_cuped + " WHERE g1 = 1 AND g2 = 1"), digits=4)
def cuped_pooled(x):
    return A.cuped_slices(rows(x), [[]])


@query("O100_dashboard_slices", sql(f"""SELECT segment, slice_action AS action, nt AS treatment_n, nc AS control_n, {r('net', 2)} AS incremental_net_recovery,
  {r('p1 - p2', 2)} AS count_increment, least(nt, nc) < 15 AS low_n, coalesce(abs({_z}) >= 1.96, false) AS beyond_noise FROM cube"""), digits=2)
def dashboard(x):
    return A.dashboard(A.slice_cube(rows(x)))


@query("O100_channel_totals", sql("SELECT count(*) FILTER (net > 0) AS positive_channels, count(*) AS channels FROM cube WHERE g1 = 1 AND g2 = 0"))
def channels(x):
    return A.channel_totals(A.slice_cube(rows(x), "segment", [["slice_action"]]))


@query("O100_headline", sql(f"""SELECT {r("max(net_expected_recovered) FILTER (strategy = 'Decision engine') - max(net_expected_recovered) FILTER (strategy <> 'Decision engine')", 2)} AS net_improvement,
  {r("(max(recovery_rate) FILTER (strategy = 'Decision engine') - max(recovery_rate) FILTER (strategy <> 'Decision engine')) * 100", 2)} AS recovery_delta_points FROM summary"""), digits=2)
def headline(x):
    return A.headline(PD.strategy_summary(PD.strategies(decisions(x))))


@query("O114_assignment", sql("SELECT invoice_id, segment, treatment_group FROM arms"))
def assignment(x):
    return assign_arms(X.population(x.d, x.as_of)).select("invoice_id", "segment", "treatment_group")


@query("O115_population", sql("SELECT c.invoice_id, k.segment, c.is_disputed, c.is_actually_paid FROM ctx c JOIN customers k ON k.id = c.customer_id"))
def population(x):
    return X.population(x.d, x.as_of).select("invoice_id", "segment", "is_disputed", "is_actually_paid")


@query("O172_attribution_run", sql(f"""SELECT segment, nt AS treatment_n, nc AS control_n, {r('increment', 2)} AS incremental_recovered_amount, {r('net', 2)} AS incremental_net_recovery,
  (SELECT count(*) FROM gated WHERE recovered) AS n_recovered FROM cube WHERE g2 = 1"""), digits=2)
def attribution_run(x):
    recovered = outcomes(x).agg(F.count_if("recovered").alias("n")).scalar()
    by_segment = A.slice_cube(rows(x), "segment", [[], ["segment"]])
    return by_segment.select(
        "segment", "treatment_n", "control_n", "incremental_recovered_amount", "incremental_net_recovery", recovered.alias("n_recovered")
    )


@query("O113_closing_log_time", sql(f"""SELECT g.invoice_id, {ts('CASE WHEN l.newest >= g.ledger_date::TIMESTAMP THEN l.newest + to_minutes(1) ELSE g.ledger_date::TIMESTAMP END')} AS timestamp
  FROM gated g LEFT JOIN (SELECT invoice_id, max(timestamp) AS newest FROM decision_logs GROUP BY 1) l ON l.invoice_id = g.invoice_id WHERE g.recovered"""))
def closing_time(x):
    paid = outcomes(x).filter("recovered").select("invoice_id", F.col("ledger_payment_date").alias("payment_date"))
    return audit.closing_logs(paid, x.d.decision_logs).select("invoice_id", "timestamp")


@query("O060_missing_closing_logs", sql(f"""SELECT p.invoice_id, {ts('CASE WHEN l.newest >= p.d THEN l.newest + to_minutes(1) ELSE p.d END')} AS timestamp FROM (
  SELECT invoice_id, min(payment_date)::TIMESTAMP AS d FROM payments WHERE method = '{P.SIMULATED_PAYMENT_METHOD}' GROUP BY 1) p
  LEFT JOIN (SELECT invoice_id, max(timestamp) AS newest FROM decision_logs GROUP BY 1) l ON l.invoice_id = p.invoice_id
  WHERE p.invoice_id NOT IN (SELECT invoice_id FROM decision_logs WHERE decision = 'stop' AND invoice_id % 2 = 0)"""))
def missing_logs(x):
    # Half of the stop logs count as closing entries already written.
    done = F.when((F.col("decision") == "stop") & (F.col("invoice_id") % 2 == 0), P.CLOSING_REASON).otherwise(F.col("reason"))
    return audit.missing_closing_logs(x.d.payments, x.d.decision_logs.withColumn("reason", done)).select("invoice_id", "timestamp")
