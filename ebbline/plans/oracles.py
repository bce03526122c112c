"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Each statement starts from the given tables and restates the operator on its
own; the shared steps are common table expressions, added where needed.
"""

from __future__ import annotations

import re

from ebbline.plans.inputs import FOREIGN_NAMES, SCORECARDS
from ebbline.schemas import (
    CATEGORICAL_COLUMNS,
    FEATURE_COLUMNS,
    NUMERIC_COLUMNS,
    RAW_COLUMNS,
    REQUEST_COLUMNS,
    SCORE_COLUMNS,
    SNAPSHOT_COLUMNS,
    TEXT_COLUMNS,
)

_ADD_ONS = {
    "OnlineSecurity": "k % 4 = 0",
    "OnlineBackup": "k % 5 < 2",
    "DeviceProtection": "k % 7 < 3",
    "TechSupport": "k % 8 < 3",
    "StreamingTV": "k % 9 < 4",
    "StreamingMovies": "k % 12 < 5",
}


def _even(expression: str, places: int) -> str:
    scale = f"{10.0**places:.1f}::double"
    return f"round_even(({expression}) * {scale}, 0) / {scale}"


def _trim(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def _number(column: str) -> str:
    return (
        f"case when regexp_full_match({column}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
        f"then try_cast(trim({column}, ' ' || chr(9)) as double) end"
    )


def _months(contract: str, tenure: str) -> str:
    buffer = (
        f"case {contract} when 'Month-to-month' then 3 when 'One year' then 12 when 'Two year' then 18 else 6 end"
    )
    discount = f"least(6.0::double, greatest(0.0::double, {tenure} / 12.0::double))"
    return _even(f"greatest(1.0::double, {buffer} - {discount})", 2)


def _segment(p: str) -> str:
    return (
        f"case when {p} > -0.01::double and {p} <= 0.3::double then 'low' "
        f"when {p} > 0.3::double and {p} <= 0.7::double then 'medium' "
        f"when {p} > 0.7::double and {p} <= 1.0::double then 'high' else 'nan' end"
    )


def _bucket(tenure: str) -> str:
    return (
        f"case when {tenure} between 0 and 12 then '0_12' when {tenure} between 13 and 24 then '13_24' "
        f"when {tenure} between 25 and 48 then '25_48' when {tenure} between 49 and 72 then '49_72' else 'nan' end"
    )


_ENGINEERED = f"""
    {_bucket('tenure')} as tenure_bucket,
    (case Contract when 'One year' then 12 when 'Two year' then 24 else 1 end)::bigint as contract_term_months,
    ln(1 + MonthlyCharges) as monthly_charges_log,
    (case when InternetService = 'No' then 0 else 1 end)::bigint as has_internet,
    (case when OnlineSecurity = 'Yes' then 1 else 0 end)::bigint as has_security,
    (case when PaymentMethod = 'Electronic check' then 1 else 0 end)::bigint as payment_risk_flag,
    SeniorCitizen::bigint as is_senior,
    (case when Partner = 'Yes' then 1 else 0 end)::bigint as has_partner,
    (case when Dependents = 'Yes' then 1 else 0 end)::bigint as has_dependents
"""

_RULE = """least(0.99::double, greatest(0.01::double,
    0.05::double
    + 0.40::double * (case when Contract = 'Month-to-month' then 1.0::double else 0.0::double end)
    + 0.20::double * (case when PaymentMethod = 'Electronic check' then 1.0::double else 0.0::double end)
    + 0.15::double * (case when InternetService = 'Fiber optic' then 1.0::double else 0.0::double end)
    - 0.001::double * tenure))"""

_UNIFORM_FIELDS = " + ".join(
    f"((('0x' || substr(md5(s), {start}, 15))::ubigint >> {10 * i}) & 1023)::bigint"
    for start in (1, 17)
    for i in range(6)
)


def _deltas(name: str, source: str) -> str:
    """Drift metrics between the two newest dates of a snapshot relation."""
    per_date = f"""
    {name}_per_date as (
      select snapshot_date, avg(monthly_revenue) as r, avg(tenure_at_snapshot) as t,
        avg(case when Contract = 'Month-to-month' then 1.0::double else 0.0::double end) as m,
        avg(churn_probability) as p,
        avg(case when risk_segment = 'high' then 1.0::double else 0.0::double end) as h,
        row_number() over (order by snapshot_date desc) as place
      from {source} group by snapshot_date),
    {name}_pair as (
      select l.snapshot_date, l.r - q.r as r, l.t - q.t as t, l.m - q.m as m, l.p - q.p as p, l.h - q.h as h
      from {name}_per_date l, {name}_per_date q where l.place = 1 and q.place = 2),"""
    metrics = [
        ("monthly_revenue_mean_delta", "data_drift", "r", "5.0"),
        ("tenure_mean_delta", "data_drift", "t", "1.0"),
        ("contract_month_to_month_share_delta", "data_drift", "m", "0.05"),
        ("avg_churn_probability_delta", "prediction_drift", "p", "0.03"),
        ("high_risk_share_delta", "prediction_drift", "h", "0.03"),
    ]
    rows = " union all ".join(
        f"select snapshot_date, '{metric}' as metric_name, '{scope}' as metric_scope, {value} as metric_value, "
        f"{limit}::double as threshold_value, case when abs({value}) > {limit}::double then 'alert' else 'ok' end "
        f"as status from {name}_pair"
        for metric, scope, value, limit in metrics
    )
    return f"{per_date} {name} as ({rows})"


def _levels(source: str) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, {c} as value from {source}" for c in CATEGORICAL_COLUMNS
    )


def _select(columns: list[str], **replace: str) -> str:
    return ", ".join(f"{replace[c]} as {c}" if c in replace else c for c in columns)


_CTES = {
    "telco_raw": f"""
      history as (select o_custkey, count(*) as n_orders, min(o_orderdate) as first_o, max(o_orderdate) as last_o
        from orders group by o_custkey),
      as_of as (select max(o_orderdate) as day from orders),
      base as (select customer.*, coalesce(n_orders, 0) as n_orders, c_custkey as k,
          date_diff('day', last_o::date, (select day from as_of)::date) as idle,
          coalesce(least(cast(floor(date_diff('day', first_o::date, last_o::date) / 30) as bigint), 72::bigint), 0) as tenure,
          cast(floor((cast(round(c_acctbal * 100) as bigint) + 100000) / 1e2) as bigint) + 1800 as mc_cents
        from customer left join history on c_custkey = o_custkey),
      charged as (select *, mc_cents * tenure as tc_cents from base),
      telco_raw as (select
        c_name as customerID,
        case when k % 11 = 0 then 'Female  ' when k % 2 = 0 then 'Female' else 'Male' end as gender,
        (case when k % 6 = 0 then 1 else 0 end)::bigint as SeniorCitizen,
        case when k % 13 = 0 then ' Yes' when c_nationkey % 2 = 0 then 'Yes' else 'No' end as Partner,
        case when k % 3 = 0 then 'Yes' else 'No' end as Dependents,
        tenure,
        case when k % 10 = 0 then 'No' else 'Yes' end as PhoneService,
        case when k % 10 = 0 then 'No phone service' when k % 2 = 0 then 'Yes' else 'No' end as MultipleLines,
        case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'Fiber optic'
          when c_mktsegment in ('FURNITURE', 'HOUSEHOLD') then 'DSL' else 'No' end as InternetService,
        {", ".join(
            f"case when c_mktsegment = 'MACHINERY' then 'No internet service' when {condition} then 'Yes' else 'No' end as {column}"
            for column, condition in _ADD_ONS.items()
        )},
        case when n_orders < 9 then 'Month-to-month' when n_orders < 12 then 'One year' else 'Two year' end as Contract,
        case when k % 5 < 3 then 'Yes' else 'No' end as PaperlessBilling,
        case k % 4 when 0 then 'Electronic check' when 1 then 'Mailed check'
          when 2 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as PaymentMethod,
        mc_cents / 1e2 as MonthlyCharges,
        case when k % 97 = 0 then ' ' else concat(cast(cast(floor(tc_cents / 1e2) as bigint) as varchar), '.',
          lpad(cast(tc_cents % 100 as varchar), 2, '0')) end as TotalCharges,
        case when idle > 180 then 'Yes' else 'No' end as Churn
        from charged)""",
    "clean": f"""
      clean as (select {_select(
          RAW_COLUMNS, TotalCharges=_number("TotalCharges"),
          Churn="(case Churn when 'Yes' then 1 when 'No' then 0 end)::bigint")} from telco_raw)""",
    "prepared": f"""
      stripped as (select {_select(RAW_COLUMNS, **{c: _trim(c) for c in TEXT_COLUMNS})} from clean),
      prepared as (select {_select(RAW_COLUMNS, TotalCharges="coalesce(TotalCharges, MonthlyCharges * tenure)")}
        from stripped)""",
    "features": f"""
      features as (select {", ".join(REQUEST_COLUMNS)}, Churn as churn_flag, {_ENGINEERED} from prepared)""",
    "scores": f"""
      ruled as (select *, {_RULE} as churn_probability, MonthlyCharges as monthly_revenue,
          {_months("Contract", "tenure")} as expected_months_remaining from features),
      scored as (select *, {_even("churn_probability * monthly_revenue * expected_months_remaining", 2)} as revenue_at_risk,
          {_segment("churn_probability")} as risk_segment, date '2001-08-01' as snapshot_date from ruled),
      scores as (select {", ".join(SCORE_COLUMNS)} from scored)""",
    "customer_months": """
      months as (select unnest(range(0, 12)) as months_back),
      customer_months as (select *, greatest(tenure - months_back, 0) as tenure_at_snapshot,
          last_day((date '2001-08-01' - to_months(months_back::integer))::date) as month_end
        from (select * exclude (snapshot_date) from scores), months
        where greatest(tenure - months_back, 0) > 0)""",
    "noise": f"""
      keyed as (select *, (months_back + 42) || '|' || customerID as s from customer_months),
      noise as (select *, ((({_UNIFORM_FIELDS}) + 6) / 1024.0::double - 6.0::double) * 0.03::double as noise from keyed)""",
    "snapshots": f"""
      moved as (select * replace (
          greatest({_even("MonthlyCharges * (1.0::double + noise)", 2)}, 18.0::double) as monthly_revenue,
          least(0.99::double, greatest(0.01::double, churn_probability - (months_back * 0.015::double
            + (case when risk_segment = 'high' then 1.0::double else 0.0::double end) * 0.01::double)))
            as churn_probability,
          {_months("Contract", "tenure_at_snapshot")} as expected_months_remaining) from noise),
      snapshots as (select {_select(
          SNAPSHOT_COLUMNS, snapshot_date="month_end",
          revenue_at_risk=_even("churn_probability * monthly_revenue * expected_months_remaining", 2),
          risk_segment=_segment("churn_probability"),
          observed_churn_event="(case when churn_flag = 1 and months_back = 0 then 1 else 0 end)::bigint",
          active_customer_flag="1::bigint")} from moved)""",
    "drift": _deltas("drift", "snapshots"),
    "alerts": """
      alert_figures as (select snapshot_date, sum(revenue_at_risk) as total, avg(churn_probability) as mean
        from scores where snapshot_date = (select max(snapshot_date) from scores) group by snapshot_date),
      alerts as (
        select snapshot_date, 'total_revenue_at_risk' as metric_name, 'threshold_alert' as metric_scope,
          total as metric_value, 50000.0::double as threshold_value,
          case when total > 50000.0::double then 'alert' else 'ok' end as status from alert_figures
        union all
        select snapshot_date, 'avg_churn_probability', 'threshold_alert', mean, 0.45::double,
          case when mean > 0.45::double then 'alert' else 'ok' end from alert_figures)""",
    "suite": "suite as (select * from drift union all select * from alerts)",
    "ledger": f"""
      earlier as (select * from snapshots where snapshot_date < (select max(snapshot_date) from snapshots)),
      {_deltas("earlier_drift", "earlier")},
      ledger as (select * from suite union all select * from earlier_drift union all select * from alerts),
      newest_metrics as (select * from ledger where snapshot_date = (select max(snapshot_date) from ledger)),
      scope_metrics as (select ledger.* from ledger join (select metric_scope, max(snapshot_date) as day from ledger
        group by metric_scope) newest on ledger.metric_scope = newest.metric_scope and snapshot_date = day)""",
    "dirty": """
      numbered as (select *, substr(customerID, 10)::bigint as k from telco_raw),
      faulty as (select * exclude (k) replace (
          case when k % 31 = 0 then null else gender end as gender,
          case when k % 29 = 0 then 2 else SeniorCitizen end as SeniorCitizen,
          case when k % 41 = 0 then null when k % 37 = 0 then 100 when k % 43 = 0 then -1 else tenure end as tenure,
          case when k % 23 = 0 then 'Weekly' when k % 19 = 0 then ' ' || Contract else Contract end as Contract,
          case when k % 53 = 0 then -1.0::double when k % 59 = 0 then null else MonthlyCharges end as MonthlyCharges,
          case when k % 17 = 0 then '1d' when k % 13 = 0 then chr(9) || TotalCharges else TotalCharges end
            as TotalCharges,
          case when k % 47 = 0 then 'Maybe' when k % 61 = 0 then null else Churn end as Churn)
        from numbered),
      dirty as (select * from faulty
        union all select * from faulty where substr(customerID, 10)::bigint % 50 = 0)""",
    "requests": f"requests as (select {_select(REQUEST_COLUMNS, TotalCharges=_number('TotalCharges'))} from telco_raw)",
    "violations": """
      violations as (select *, concat_ws(', ',
          case when TotalCharges is null then 'TotalCharges missing' end,
          case when SeniorCitizen not between 0 and 1 then 'SeniorCitizen out of range' end,
          case when tenure not between 0 and 72 then 'tenure out of range' end,
          case when MonthlyCharges <= 0 then 'MonthlyCharges not positive' end,
          case when TotalCharges < 0 then 'TotalCharges negative' end) as violations from requests)""",
    "foreign_set": f"""
      foreign_set as (select {", ".join(f'{c} as "{f}"' for c, f in zip(REQUEST_COLUMNS, FOREIGN_NAMES))}
        from telco_raw)""",
    "upload": f"""
      mapped as (select {", ".join(f'"{f}" as {c}' for c, f in zip(REQUEST_COLUMNS, FOREIGN_NAMES))} from foreign_set),
      coerced as (select {_select(REQUEST_COLUMNS, TotalCharges=_number("TotalCharges"),
          **{c: _trim(c) for c in TEXT_COLUMNS})} from mapped),
      imputed as (select {_select(REQUEST_COLUMNS, TotalCharges="coalesce(TotalCharges, MonthlyCharges * tenure)")}
        from coerced),
      upload as (select *, {_ENGINEERED} from imputed)""",
    "upload_scores": f"""
      upload_ruled as (select *, {_RULE} as churn_probability, {_months("Contract", "tenure")} as months from upload),
      upload_scores as (select *, {_even("churn_probability * MonthlyCharges * months", 2)} as revenue_at_risk,
          {_segment("churn_probability")} as risk_segment from upload_ruled)""",
    "split": """
      sizes as (select count(*) as n, ceil(0.2::double * count(*))::bigint as n_test,
          count(*) filter (churn_flag = 0) as n0, count(*) filter (churn_flag = 1) as n1 from features),
      shares as (select *, n0 / n::double * (n - n_test) as x0, n1 / n::double * (n - n_test) as x1 from sizes),
      floors as (select *, floor(x0)::bigint as f0, floor(x1)::bigint as f1,
          (n - n_test - floor(x0) - floor(x1))::bigint as spare from shares),
      train_sizes as (select n0, n1,
          f0 + (case when spare = 2 or (spare = 1 and x0 - f0 >= x1 - f1) then 1 else 0 end) as t0,
          f1 + (case when spare = 2 or (spare = 1 and x0 - f0 < x1 - f1) then 1 else 0 end) as t1 from floors),
      placed as (select *, row_number() over (partition by churn_flag order by md5('42|' || customerID)) as place
        from features),
      split as (select placed.*, case when place <= case churn_flag when 0 then n0 - t0 else n1 - t1 end
          then 'test' else 'train' end as split from placed, train_sizes)""",
}


def _with(*names: str) -> str:
    return "with " + ", ".join(_CTES[n] for n in names) + " "


_RAW = _with("telco_raw")
_CLEAN = _with("telco_raw", "clean")
_PREPARED = _with("telco_raw", "clean", "prepared")
_FEATURE_CHAIN = ("telco_raw", "clean", "prepared", "features")
_FEATURES = _with(*_FEATURE_CHAIN)
_SCORE_CHAIN = (*_FEATURE_CHAIN, "scores")
_SCORES = _with(*_SCORE_CHAIN)
_SNAP_CHAIN = (*_SCORE_CHAIN, "customer_months", "noise", "snapshots")
_SNAPS = _with(*_SNAP_CHAIN)
_SUITE_CHAIN = (*_SNAP_CHAIN, "drift", "alerts", "suite")
_LEDGER = _with(*_SUITE_CHAIN, "ledger")
_HISTORY = f"""{_SNAPS}, stored_months as (
    select * from snapshots where snapshot_date = '2001-08-31'
    union all select * replace (last_day((snapshot_date - to_months(1))::date) as snapshot_date) from snapshots
      where customerID in (select customerID from scores where tenure >= 12))"""
_DETAILS = "drift_details as (" + " union all ".join(
    f"select '{metric}' as metric_name, format('latest={{:.4f}}, previous={{:.4f}}', l.{value}, q.{value}) as details "
    "from drift_per_date l, drift_per_date q where l.place = 1 and q.place = 2"
    for metric, value in (
        ("monthly_revenue_mean_delta", "r"),
        ("tenure_mean_delta", "t"),
        ("contract_month_to_month_share_delta", "m"),
        ("avg_churn_probability_delta", "p"),
        ("high_risk_share_delta", "h"),
    )
) + ")"
_UPLOAD_CHAIN = ("telco_raw", "foreign_set", "upload")
_SPLIT = _with(*_FEATURE_CHAIN, "split")

_LOG9 = _even("monthly_charges_log", 9)
_METRICS = (
    f"select snapshot_date, metric_name, metric_scope, {_even('metric_value', 6)} as metric_value, "
    "threshold_value, status from "
)
_KPIS = f"""{_even("sum(revenue_at_risk)", 2)} as total_revenue_at_risk,
    {_even("avg(churn_probability)", 6)} as avg_churn_probability,
    count(*) filter (risk_segment = 'high') as high_risk_customers"""
_THRESHOLD = f"""
    select {_even("coalesce(tp / nullif(tp + fp, 0)::double, 0)", 6)} as precision,
      {_even("coalesce(tp / nullif(tp + fn, 0)::double, 0)", 6)} as recall,
      {_even("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)", 6)} as f1"""
_COUNTS = """count(*) filter (churn_probability >= 0.5::double and churn_flag = 1) as tp,
    count(*) filter (churn_probability >= 0.5::double and churn_flag = 0) as fp,
    count(*) filter (churn_probability < 0.5::double and churn_flag = 1) as fn"""


def _snake(name: str) -> str:
    return re.sub("([a-z])([A-Z])", r"\1_\2", name).lower()


_INTEGERS = {"SeniorCitizen", "tenure", "churn_flag", "tenure_at_snapshot", "observed_churn_event", "active_customer_flag"}


def _mart(columns: list[str]) -> str:
    items = []
    for c in columns:
        value = f"{c}::integer" if c in _INTEGERS or c.startswith(("has_", "is_", "payment_risk", "contract_term")) else c
        items.append(f"{value} as {_snake(c)}")
    return ", ".join(items)


def _quality(source: str) -> str:
    return f"""
      ids as (select customerID, count(*) as n from {source} group by customerID),
      figures as (select count(*) as n, min(tenure) as t0, max(tenure) as t1, min(MonthlyCharges) as c0,
          max(MonthlyCharges) as c1, count(*) filter (Churn not in ('Yes', 'No')) as odd from {source}),
      missing as ({_missing(source)}),
      checks as (
        select 'row_count' as "check", greatest(1000 - n, 0) as failed from figures
        union all select 'duplicate_customer_ids', sum(n - 1) from ids
        union all select 'missing_' || column_name, missing from missing
        union all select 'tenure_range', (t0 < 0)::bigint + (t1 > 72)::bigint from figures
        union all select 'monthly_charges_range', (c0 < 0)::bigint + (c1 <= 0)::bigint from figures
        union all select 'target_values', odd from figures)
      select "check", failed::bigint as failed, failed = 0 as passed from checks"""


def _missing(source: str) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({c} is null) as missing from {source}"
        for c in ("customerID", "tenure", "MonthlyCharges", "Churn")
    )


def _auc(source: str) -> str:
    """Mid-rank form of the area under the ROC curve."""
    return f"""
      grouped as (select p, count(*) filter (churn_flag = 1) as pos, count(*) as n from {source}
        group by p),
      ranked as (select *, sum(n) over (order by p) - n + (n + 1) / 2.0::double as mid from grouped),
      area as (select sum(pos)::double as np, (sum(n) - sum(pos))::double as nn, sum(pos * mid) as rank_sum
        from ranked),
      auc as (select (rank_sum - np * (np + 1) / 2) / nullif(np * nn, 0) as auc from area)"""


def _scorecard(place: int, rule: str) -> str:
    """Evaluation of one of the rules as relation ``card_<place>``."""
    area = re.sub(r"\b(grouped|ranked|area|auc) as \(", rf"\1_{place} as (", _auc(f"rated_{place}"))
    area = re.sub(r"\bfrom (grouped|ranked|area)\b", rf"from \1_{place}", area)
    name = list(SCORECARDS)[place]
    return f"""
      rated_{place} as (select churn_flag, {rule} as p, {rule} as churn_probability from scores), {area},
      counts_{place} as (select {_COUNTS} from rated_{place}),
      metrics_{place} as ({_THRESHOLD} from counts_{place}),
      card_{place} as (select {place} as place, '{name}' as model_type, auc, precision, recall, f1
        from auc_{place}, metrics_{place})"""


def oracle_sql() -> dict[str, str]:
    return {
        "src_csv": f"{_RAW} select * from telco_raw",
        "src_parquet_roundtrip": f"{_FEATURES} select {_select(FEATURE_COLUMNS, monthly_charges_log=_LOG9)} from features",
        "upload_stage_roundtrip": f"{_with('telco_raw', 'foreign_set')} select * from foreign_set",
        "mart_customers_raw": f"{_CLEAN} select {_mart(REQUEST_COLUMNS)}, Churn::integer as churn_flag from clean",
        "mart_features": f"""{_FEATURES} select customerID as customer_id, tenure_bucket,
            contract_term_months::integer as contract_term_months, {_LOG9} as monthly_charges_log,
            has_internet::integer as has_internet, has_security::integer as has_security,
            payment_risk_flag::integer as payment_risk_flag, is_senior::integer as is_senior,
            has_partner::integer as has_partner, has_dependents::integer as has_dependents from features""",
        "mart_scores_daily": f"{_SCORES} select {_mart(SCORE_COLUMNS)} from scores",
        "mart_customer_snapshots": f"{_SNAPS} select {_mart(SNAPSHOT_COLUMNS)} from snapshots",
        "mart_drift_append": f"""{_with(*_SUITE_CHAIN)} {_METRICS} suite union all {_METRICS} suite""",
        "mart_drift_rerun": f"""{_with(*_SUITE_CHAIN)}, runs(run_id) as (values ('monday'), ('tuesday')),
            shown as ({_METRICS} suite) select run_id, shown.* from runs, shown""",
        "mart_snapshot_history": f"""{_HISTORY} select {_mart(SNAPSHOT_COLUMNS)} from stored_months""",
        "history_drift": f"{_HISTORY}, {_deltas('old_drift', 'stored_months')} {_METRICS} old_drift",
        "mart_create_again": f"""{_FEATURES} select 'features' as table_name, count(*) as row_count from features
            union all select 'drift_metrics', 2
            union all select unnest(['customers_raw', 'scores_daily', 'customer_snapshots', 'model_registry']), 0""",
        "model_columns": f"""{_FEATURES} select {_select([*CATEGORICAL_COLUMNS, *NUMERIC_COLUMNS, "churn_flag"], monthly_charges_log=_LOG9)} from features""",
        "gates": """select * from (values ('raw columns', true, 'tenure, Churn'), ('raw columns', false, ''),
            ('upload fields', true, 'gender'), ('upload fields', false, ''),
            ('two dates', true, 'two snapshot dates'), ('two dates', false, '')) said(gate, faulty, said)""",
        "monitoring_details": f"""{_with(*_SUITE_CHAIN)}, {_DETAILS},
            told as (select * from drift_details union all
              select 'total_revenue_at_risk', 'snapshot_date=' || snapshot_date || ', total_revenue_at_risk=' ||
                format('{{:.2f}}', total) from alert_figures
              union all select 'avg_churn_probability', 'snapshot_date=' || snapshot_date || ', avg_churn_probability=' ||
                format('{{:.4f}}', mean) from alert_figures)
            select metric_name, status, details from told join suite using (metric_name)""",
        "job_retrain": f"""{_FEATURES} select customerID, true as in_range, true as loaded_alike, 2::bigint as versions,
            true as report_fits from features""",
        "clean_total_charges": f"{_RAW} select customerID, {_number('TotalCharges')} as TotalCharges from telco_raw",
        "clean_churn_label": f"{_CLEAN} select customerID, Churn from clean",
        "clean_trim": f"""{_RAW} select {", ".join(f"{_trim(c)} as {c}" for c in TEXT_COLUMNS)} from telco_raw""",
        "clean_impute_total": f"{_PREPARED} select customerID, TotalCharges from prepared",
        "upload_coerce": f"""{_with("telco_raw", "foreign_set", "upload")}
            select {_select(REQUEST_COLUMNS, TotalCharges=_number("TotalCharges"))} from mapped""",
        "dq_report": f"{_RAW}, {_quality('telco_raw')}",
        "dq_report_dirty": f"{_with('telco_raw', 'dirty')}, {_quality('dirty')}",
        "dq_duplicates": f"""{_RAW}
            select 'customers' as dataset, (count(*) - count(distinct customerID))::bigint as duplicate_rows from telco_raw
            union all select 'orders by customer', (count(*) - count(distinct o_custkey))::bigint from orders""",
        "dq_missing": f"{_RAW} {_missing('telco_raw')}",
        "dq_missing_dirty": f"{_with('telco_raw', 'dirty')} {_missing('dirty')}",
        "dq_unexpected_targets": f"""{_with("telco_raw", "dirty")}
            select Churn, count(*) as row_count from dirty where Churn not in ('Yes', 'No') group by Churn""",
        "dq_record_contract_dirty": f"""{_with("telco_raw", "dirty")},
            numeric as (select * replace ({_number("TotalCharges")} as TotalCharges) from dirty)
            select customerID, concat_ws(', ',
              case when gender is null then 'gender missing' end,
              case when tenure is null then 'tenure missing' end,
              case when MonthlyCharges is null then 'MonthlyCharges missing' end,
              case when TotalCharges is null then 'TotalCharges missing' end,
              case when SeniorCitizen not in (0, 1) then 'SeniorCitizen out of range' end,
              case when tenure < 0 or tenure > 72 then 'tenure out of range' end,
              case when MonthlyCharges <= 0 then 'MonthlyCharges not positive' end,
              case when TotalCharges < 0 then 'TotalCharges negative' end,
              case when Contract = 'Weekly' then 'Contract unknown' end) as violations from numeric""",
        "dq_summary": f"""{_RAW} select count(*) as row_count, 21::bigint as column_count,
            {_even("avg(case when Churn = 'Yes' then 1.0::double else 0.0::double end)", 6)} as churn_rate,
            min(tenure) as tenure_min, max(tenure) as tenure_max, min(MonthlyCharges) as monthly_charges_min,
            max(MonthlyCharges) as monthly_charges_max,
            count(*) filter (({_number("TotalCharges")}) is null) as total_charges_missing from telco_raw""",
        "dq_record_contract": f"""{_with("telco_raw", "requests", "violations")}
            select customerID, violations, violations = '' as valid from violations""",
        "features": f"{_FEATURES} select {_select(FEATURE_COLUMNS, monthly_charges_log=_LOG9)} from features",
        "tenure_bucket_dist": f"""{_FEATURES} select tenure_bucket, count(*) as customers,
            min(tenure) as tenure_min, max(tenure) as tenure_max from features group by tenure_bucket""",
        "upload_features": f"""{_with(*_UPLOAD_CHAIN)}
            select * replace ({_LOG9} as monthly_charges_log) from upload""",
        "upload_features_dirty": f"""{_with("telco_raw", "dirty")},
            coerced as (select {_select(REQUEST_COLUMNS, **{c: _trim(c) for c in TEXT_COLUMNS},
              tenure="coalesce(tenure, 0)", MonthlyCharges="coalesce(MonthlyCharges, 0)",
              TotalCharges=_number("TotalCharges"))} from dirty),
            imputed as (select * replace (coalesce(TotalCharges, MonthlyCharges * tenure) as TotalCharges) from coerced),
            engineered as (select *, {_ENGINEERED.replace("ln(1 + MonthlyCharges)", "ln(1 + greatest(MonthlyCharges, 0))")}
              from imputed)
            select * replace ({_LOG9} as monthly_charges_log) from engineered""",
        "split_stratified": f"{_SPLIT} select customerID, churn_flag, split from split",
        "prep_numeric_stats": f"{_FEATURES} "
        + " union all ".join(
            f"select '{c}' as column_name, {_even(f'median({c})::double', 6)} as median_value, "
            f"{_even(f'avg({c})', 6)} as mean_value, {_even(f'stddev_pop({c})', 6)} as std_value from features"
            for c in NUMERIC_COLUMNS
        ),
        "prep_modes": f"""{_FEATURES}, cells as ({_levels("features")}),
            counted as (select column_name, value, count(*) as n from cells group by column_name, value)
            select column_name, value as mode_value from counted
            qualify row_number() over (partition by column_name order by n desc, value) = 1""",
        "onehot_active": f"""{_SPLIT}, train as (select * from split where split = 'train')
            select customerID, ({" + ".join(
                f"(case when {c} in (select {c} from train) then 1 else 0 end)" for c in CATEGORICAL_COLUMNS
            )})::bigint as active from split""",
        "class_weights": f"""{_FEATURES} select churn_flag, count(*) as class_rows,
            {_even("(select count(*) from features) / (2.0::double * count(*))", 9)} as class_weight
            from features group by churn_flag""",
        "train_lr_scores": f"""{_SPLIT} select customerID, churn_flag, split, true as in_range,
            (select count(*) from split where split = 'train') as train_rows, true as optimal, true as balanced from split""",
        "train_rf_scores": f"""{_SPLIT} select customerID, churn_flag, split, true as in_range, 400::bigint as trees,
            true as depth_held, true as leaves_held, true as features_known, true as rows_add_up from split""",
        "model_selection": """select position::integer as position, model_type, true as better_than_chance, true as in_range,
            true as f1_fits, true as choice_fits, 1::bigint as chosen
            from (values (1, 'logistic_regression'), (2, 'random_forest')) candidates(position, model_type)""",
        "registry_row": """select 'subscriber_risk' as model_name, 'once' as run_id, true as version_fits,
            true as figures_fit, true as model_fits, true as one_artifact, true as dated""",
        "upload_model_preview": f"""{_RAW} select unnest(range(1, least(count(*), 15) + 1)) as place, true as known,
            true as in_range, true as months_fit, true as segment_fits, true as none_above from telco_raw""",
        "eval_auc": f"""{_SCORES}, rated as (select churn_flag, churn_probability as p from scores), {_auc("rated")}
            select {_even("auc", 6)} as auc from auc""",
        "eval_threshold_metrics": f"{_SCORES}, counts as (select {_COUNTS} from scores) {_THRESHOLD} from counts",
        "score_expected_months": f"{_SCORES} select customerID, expected_months_remaining from scores",
        "score_segments": f"{_SCORES} select customerID, churn_probability, risk_segment from scores",
        "score_output": f"""{_SCORES} select {_select(FEATURE_COLUMNS, monthly_charges_log=_LOG9)}, churn_probability,
            monthly_revenue, expected_months_remaining, revenue_at_risk, risk_segment, snapshot_date from scored""",
        "batch_scores": f"{_SCORES} select * from scores",
        "score_response": f"""{_SCORES} select customerID as customer_id,
            {_even("churn_probability", 6)} as churn_probability, {_even("monthly_revenue", 2)} as monthly_revenue,
            {_even("expected_months_remaining", 2)} as expected_months_remaining,
            {_even("revenue_at_risk", 2)} as revenue_at_risk, risk_segment from scores""",
        "snap_month_ends": f"""{_RAW}, months as (select unnest(range(0, 12)) as months_back)
            select last_day(((select day from as_of)::date - to_months(months_back::integer))::date) as snapshot_date,
              months_back::bigint as months_back, count(*) as customers
            from telco_raw, months where tenure > months_back group by all""",
        "snap_customer_months": f"""{_with(*_SCORE_CHAIN, "customer_months")}
            select customerID, months_back::bigint as months_back, month_end as snapshot_date, tenure_at_snapshot
            from customer_months""",
        "snap_noise": f"""{_with(*_SCORE_CHAIN, "customer_months", "noise")}
            select customerID, months_back::bigint as months_back, noise from noise""",
        "snapshots": f"{_SNAPS} select * from snapshots",
        "drift_dates": f"""{_SNAPS} select max(snapshot_date) as latest_date,
            max(snapshot_date) filter (snapshot_date < (select max(snapshot_date) from snapshots)) as previous_date
            from snapshots""",
        "data_drift": f"{_with(*_SUITE_CHAIN)} {_METRICS} suite where metric_scope = 'data_drift'",
        "prediction_drift": f"{_with(*_SUITE_CHAIN)} {_METRICS} suite where metric_scope = 'prediction_drift'",
        "threshold_alerts": f"{_with(*_SCORE_CHAIN, 'alerts')} {_METRICS} alerts",
        "monitoring_suite": f"{_with(*_SUITE_CHAIN)} {_METRICS} suite",
        "latest_scores": f"""{_SNAPS} select * from snapshots
            where snapshot_date = (select max(snapshot_date) from snapshots)""",
        "kpis": f"{_SCORES} select snapshot_date, {_KPIS}, count(*) as customers_scored from scores group by snapshot_date",
        "kpi_cards": f"""{_SCORES}, figures as (select snapshot_date, sum(revenue_at_risk) as total,
              avg(churn_probability) as mean, count(*) filter (risk_segment = 'high') as high, count(*) as n
              from scores group by snapshot_date)
            select snapshot_date, 1 as position, 'Total Revenue At Risk' as label, format('${{:,.0f}}', total) as value
              from figures
            union all select snapshot_date, 2, 'Average Churn Probability', format('{{:.1f}}%', mean * 100) from figures
            union all select snapshot_date, 3, 'High Risk Customers', format('{{:,d}}', high) from figures
            union all select snapshot_date, 4, 'Customers Scored', format('{{:,d}}', n) from figures""",
        "segment_mix": f"""{_SCORES}, segments(position, risk_segment) as (values (1, 'high'), (2, 'medium'), (3, 'low'))
            select segments.position, segments.risk_segment, count(scores.customerID) as customers
            from segments left join scores using (risk_segment) group by all""",
        "top_risky": f"""{_SCORES} select customerID, Contract, MonthlyCharges, churn_probability, revenue_at_risk,
            risk_segment from scores order by revenue_at_risk desc, customerID limit 12""",
        "trend": f"""{_SNAPS} select snapshot_date, {_even("avg(churn_probability)", 4)} as avg_churn_probability,
            {_even("sum(revenue_at_risk)", 2)} as total_revenue_at_risk,
            {_even("avg(case when risk_segment = 'high' then 1.0::double else 0.0::double end)", 4)} as high_risk_share
            from snapshots group by snapshot_date""",
        "explorer_all": f"""{_SCORES} select customerID, Contract, PaymentMethod, MonthlyCharges, churn_probability,
            expected_months_remaining, revenue_at_risk, risk_segment from scores
            order by revenue_at_risk desc, churn_probability desc, customerID limit 50""",
        "explorer_filtered": f"""{_SCORES} select customerID, Contract, PaymentMethod, MonthlyCharges, churn_probability,
            expected_months_remaining, revenue_at_risk, risk_segment from scores
            where risk_segment = 'medium' and Contract = 'Two year'
            order by revenue_at_risk desc, churn_probability desc, customerID limit 50""",
        "monitoring_summary": f"""{_LEDGER} select snapshot_date,
            count(*) filter (status = 'alert') as active_alerts,
            count(*) filter (metric_scope = 'data_drift') as data_drift_metrics,
            count(*) filter (metric_scope = 'prediction_drift') as prediction_drift_metrics,
            count(*) filter (metric_scope = 'threshold_alert') as threshold_checks
            from newest_metrics group by snapshot_date""",
        "metric_ledger": f"""{_LEDGER} select snapshot_date, metric_scope, metric_name, status,
            format('{{:,.4f}}', metric_value) as metric_value_display,
            coalesce(format('{{:,.4f}}', threshold_value), '-') as threshold_value_display from newest_metrics""",
        "monitoring_summary_per_scope": f"""{_LEDGER} select max(snapshot_date) as snapshot_date,
            count(*) filter (status = 'alert') as active_alerts,
            count(*) filter (metric_scope = 'data_drift') as data_drift_metrics,
            count(*) filter (metric_scope = 'prediction_drift') as prediction_drift_metrics,
            count(*) filter (metric_scope = 'threshold_alert') as threshold_checks from scope_metrics""",
        "metric_ledger_per_scope": f"""{_LEDGER} select snapshot_date, metric_scope, metric_name, status,
            format('{{:,.4f}}', metric_value) as metric_value_display,
            coalesce(format('{{:,.4f}}', threshold_value), '-') as threshold_value_display from scope_metrics""",
        "alert_queue": f"""{_LEDGER}
            select snapshot_date, metric_scope, metric_name, status,
              format('{{:,.4f}}', metric_value) as metric_value_display,
              coalesce(format('{{:,.4f}}', threshold_value), '-') as threshold_value_display
            from scope_metrics where status = 'alert'""",
        # The display rounds halves up.
        "registry_latest": f"""{_SCORES}, {", ".join(_scorecard(i, rule) for i, rule in enumerate(SCORECARDS.values()))},
            registry as ({" union all ".join(f"select * from card_{i}" for i in range(len(SCORECARDS)))})
            select model_type, format('{{:.4f}}', round(round(auc, 9), 4)) as auc_display, format('{{:.4f}}', round(round(precision, 9), 4)) as precision_display,
              format('{{:.4f}}', round(round(recall, 9), 4)) as recall_display, format('{{:.4f}}', round(round(f1, 9), 4)) as f1_display
            from registry order by place desc limit 5""",
        "ops_summary": f"""{_LEDGER} select snapshot_date, count(*) as metrics,
            count(*) filter (status = 'alert') as active_alerts,
            least({len(SCORECARDS)}, 5)::bigint as registered_models
            from newest_metrics group by snapshot_date""",
        "upload_summary": f"""{_with(*_UPLOAD_CHAIN, "upload_scores")}
            select count(*) as rows_scored, {_KPIS} from upload_scores""",
        "upload_preview": f"""{_with(*_UPLOAD_CHAIN, "upload_scores")}
            select customerID, Contract, PaymentMethod, MonthlyCharges, churn_probability, revenue_at_risk, risk_segment
            from upload_scores order by revenue_at_risk desc, customerID limit 15""",
        "profile_dataset": f"""{_with("telco_raw", "foreign_set")},
            distinct_rows as (select distinct * from foreign_set)
            select count(*) as row_count, 20::bigint as column_count,
              sum({" + ".join(f'("{f}" is null)::bigint' for f in FOREIGN_NAMES)})::bigint as missing_total,
              3::bigint as numeric_columns, (count(*) - (select count(*) from distinct_rows))::bigint as duplicate_rows,
              20::bigint as mapped_fields, 20::bigint as required_fields from foreign_set""",
        "profile_dataset_dirty": f"""{_with("telco_raw", "dirty")},
            distinct_rows as (select distinct * from dirty)
            select count(*) as row_count, 21::bigint as column_count,
              sum({" + ".join(f"({c} is null)::bigint" for c in RAW_COLUMNS)})::bigint as missing_total,
              3::bigint as numeric_columns, (count(*) - (select count(*) from distinct_rows))::bigint as duplicate_rows,
              20::bigint as mapped_fields, 20::bigint as required_fields from dirty""",
        "profile_columns": f"{_with('telco_raw', 'foreign_set')} "
        + " union all ".join(
            f"select {i} as position, '{f}' as column_name, "
            f"'{ {'is_senior': 'bigint', 'customer-tenure': 'bigint', 'monthlyAmount': 'double'}.get(f, 'string') }' as dtype, "
            f"{_even(f'count(*) filter ("{f}" is null) / count(*)::double * 100', 1)} as missing_pct, "
            f'count(distinct "{f}") as unique_values, '
            f"(select string_agg(v, ' | ' order by v) from (select distinct \"{f}\"::varchar as v from foreign_set "
            f"where \"{f}\" is not null order by v limit 3)) as sample_values from foreign_set"
            for i, f in enumerate(FOREIGN_NAMES, start=1)
        ),
        "profile_sketches": f"{_with('telco_raw', 'foreign_set')} "
        + " union all ".join(
            f"select {i} as position, '{f}' as column_name, count(*) as total, "
            f"{_even(f'count(*) filter ("{f}" is null) / count(*)::double * 100', 1)} as missing_pct, "
            f'count(distinct "{f}") as exact, true as within_bound from foreign_set'
            for i, f in enumerate(FOREIGN_NAMES, start=1)
        ),
        "src_csv_quoted_breaks": f"""{_RAW} select * replace (replace(PaymentMethod, ' ', chr(10)) as PaymentMethod)
            from telco_raw""",
        "upload_mapped": f"{_with(*_UPLOAD_CHAIN)} select * from mapped",
        "job_refresh_mart": f"""{_SNAPS}
            select 'customers_raw' as table_name, count(*) as row_count from telco_raw
            union all select 'features', count(*) from features
            union all select 'scores_daily', count(*) from scores
            union all select 'customer_snapshots', count(*) from snapshots""",
        "job_restart": f"""{_SCORES}, runs(day) as (values (date '2001-07-01'), (date '2001-08-01'))
            select {_mart([c for c in SCORE_COLUMNS if c != "snapshot_date"])}, day as snapshot_date,
              1::bigint as features_made, date '2001-07-01' as readable from scores, runs""",
        "job_dashboard": f"""{_SCORES} select customerID, Contract, PaymentMethod, MonthlyCharges, churn_probability,
            expected_months_remaining, revenue_at_risk, risk_segment from scores
            where risk_segment = 'medium' and Contract = 'Two year'
            order by revenue_at_risk desc, churn_probability desc, customerID limit 50""",
        "job_mart_contents": f"{_SNAPS} select {_mart(SNAPSHOT_COLUMNS)} from snapshots",
        "stream_model_change": f"""{_with("telco_raw", "clean", "prepared", "features", "scores", "requests", "violations")},
            rated as (select * replace (case when substr(customerID, 10)::bigint % 2 = 0 then churn_probability
                else {SCORECARDS["contract"]} end as churn_probability),
                case when substr(customerID, 10)::bigint % 2 = 0 then 'steady' else 'contract' end as model from scores
              where customerID in (select customerID from violations where violations = ''))
            select model, customerID as customer_id, {_even("churn_probability", 6)} as churn_probability,
              {_even("monthly_revenue", 2)} as monthly_revenue,
              {_even("expected_months_remaining", 2)} as expected_months_remaining,
              {_even(_even("churn_probability * monthly_revenue * expected_months_remaining", 2), 2)} as revenue_at_risk,
              {_segment("churn_probability")} as risk_segment from rated""",
        "stream_score": f"""{_with("telco_raw", "clean", "prepared", "features", "scores", "requests", "violations")}
            select customerID as customer_id, {_even("churn_probability", 6)} as churn_probability,
              {_even("monthly_revenue", 2)} as monthly_revenue,
              {_even("expected_months_remaining", 2)} as expected_months_remaining,
              {_even("revenue_at_risk", 2)} as revenue_at_risk, risk_segment
            from scores where customerID in (select customerID from violations where violations = '')""",
        "stream_quarantine": f"""{_with("telco_raw", "requests", "violations")}
            select customerID, case when violations = '' then 'valid' else 'quarantine' end as record_status,
              violations from violations""",
        "stream_threshold_alerts": f"""{_with("telco_raw", "clean", "prepared", "features", "scores", "requests", "violations")},
            figures as (select snapshot_date, sum(revenue_at_risk) as total, avg(churn_probability) as mean from scores
              where customerID in (select customerID from violations where violations = '') group by snapshot_date),
            rows as (select snapshot_date, 'total_revenue_at_risk' as metric_name, 'threshold_alert' as metric_scope,
              total as metric_value, 50000.0::double as threshold_value,
              case when total > 50000.0::double then 'alert' else 'ok' end as status from figures
              union all select snapshot_date, 'avg_churn_probability', 'threshold_alert', mean, 0.45::double,
              case when mean > 0.45::double then 'alert' else 'ok' end from figures)
            {_METRICS} rows""",
    }
