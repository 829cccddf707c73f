"""The same queries as plain SQL over the same tables, as an independent check of results.

Nothing here shares a formula with the Spark code: recursions are written as recursions,
frames as whole-series windows, windows as range joins.
"""

from __future__ import annotations

import re

SQL: dict[str, str] = {}


def d(x: str, name: str, digits: int = 6) -> str:
    """A double rounded like the Spark side: half-way cases upwards, never -0.0."""
    return f"round(({x}) + 1e-10, {digits}) + 0.0 AS {name}"


def stamp(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def n_if(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


Z = lambda c: f"({c} - {c}__mean) / greatest({c}__std, 1e-8)"
STATS = lambda c: (
    f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std, min({c}) AS {c}__minimum, max({c}) AS {c}__maximum, "
    f"quantile_cont({c}, 0.25) AS {c}__q1, quantile_cont({c}, 0.75) AS {c}__q3"
)
SIGNAL = "(least(abs(z_value), 5.0) + least(abs(z_k), 5.0)) / 2.0"
EDGE_P1 = "1.0 / (1.0 + exp(-(0.8::DOUBLE * z_value - 0.2::DOUBLE * z_k)))"
CLOUD_P1 = "1.0 / (1.0 + exp(-(1.5::DOUBLE * z_value - 0.6::DOUBLE * z_k)))"
CONF = lambda p1: f"2.0 * (greatest({p1}, 1.0 - {p1}) - 0.5)"
HARMONIC = lambda c, e, s, q: (
    f"1.0 / (0.25 / ({c} + 1e-8) + 0.25 / (1.0 - {e} + 1e-8) + 0.25 / (1.0 - {s} + 1e-8) + 0.25 / ({q} + 1e-8))"
)
UNIFORM = lambda seed, salt, key: (
    f"(('0x' || substr(md5({seed} || '|{salt}|' || {key}), 1, 13))::BIGINT / pow(16.0::DOUBLE, 13))"
)
NORMAL = lambda seed, salt, key: (
    f"(sqrt(-2.0 * ln(greatest({UNIFORM(seed, salt + '/a', key)}, 1e-300))) * cos(2.0 * pi() * {UNIFORM(seed, salt + '/b', key)}))"
)


def macro(tp: str, fp: str, fn: str, tn: str) -> dict[str, str]:
    safe = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"
    one, zero = f"(({tp}+{fp}+{fn} > 0)::INT)", f"(({tn}+{fp}+{fn} > 0)::INT)"
    both = lambda x1, x0: safe(f"{one} * ({x1}) + {zero} * ({x0})", f"{one} + {zero}")
    return {
        "accuracy": safe(f"{tp}+{tn}", f"{tp}+{fp}+{fn}+{tn}"),
        "precision": both(safe(tp, f"{tp}+{fp}"), safe(tn, f"{tn}+{fn}")),
        "recall": both(safe(tp, f"{tp}+{fn}"), safe(tn, f"{tn}+{fp}")),
        "f1": both(safe(f"2.0*{tp}", f"2*{tp}+{fp}+{fn}"), safe(f"2.0*{tn}", f"2*{tn}+{fp}+{fn}")),
        "mcc": safe(
            f"{tp}::DOUBLE*{tn} - {fp}::DOUBLE*{fn}",
            f"sqrt(({tp}+{fp})::DOUBLE*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))",
        ),
    }


def matrix(label: str, pred: str, prefix: str = "", among: str = "true") -> str:
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return ", ".join(n_if(f"{among} AND {label}={y} AND {pred}={p}", prefix + n) for n, (y, p) in cells.items())


CTES: dict[str, str] = {}

CTES["t"] = r"""
  SELECT user_id % 16 AS series_id, event_id, ts, user_id, event_type, value,
    CAST(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) AS k,
    CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) % 4 AS state,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
    CASE WHEN event_type = 'purchase' THEN value END AS amount,
    CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'baseline_train'
         WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline_validation' ELSE 'inference' END AS role
  FROM events"""
CTES["o"] = "SELECT *, row_number() OVER (PARTITION BY series_id, role ORDER BY ts, event_id) - 1 AS row_idx FROM t"
CTES["st"] = f"SELECT count(*) AS n0, {STATS('value')}, {STATS('k')} FROM t WHERE role = 'baseline_train'"
CTES["n"] = f"SELECT o.*, st.*, {Z('value')} AS z_value, {Z('k')} AS z_k FROM o CROSS JOIN st"
CTES["inf"] = "SELECT *, count(*) OVER (PARTITION BY series_id) AS n_stream FROM n WHERE role = 'inference'"
CTES["sc"] = f"""
  SELECT series_id, row_idx, event_id, event_type, ts, y, value, k, state, z_value, z_k, {EDGE_P1} AS p1, {CLOUD_P1} AS cloud_p1,
    CASE WHEN {EDGE_P1} >= 0.5 THEN 1 ELSE 0 END AS edge_pred, CASE WHEN {CLOUD_P1} >= 0.5 THEN 1 ELSE 0 END AS cloud_pred,
    {SIGNAL} AS signal
  FROM n WHERE role = 'inference'"""
CTES["bm"] = f"SELECT avg({SIGNAL}) AS baseline_mean FROM n WHERE role = 'baseline_train'"
CTES["sg"] = "SELECT sc.*, least(1.0, abs(signal - baseline_mean)) AS raw_severity FROM sc CROSS JOIN bm"
CTES["sev"] = """
  SELECT series_id, row_idx, raw_severity AS s FROM sg WHERE row_idx = 0
  UNION ALL
  SELECT g.series_id, g.row_idx, 0.8::DOUBLE * p.s + 0.2::DOUBLE * g.raw_severity
  FROM sev p JOIN sg g ON g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
CTES["ls"] = """
  SELECT series_id, row_idx, lag(CASE WHEN edge_pred <> y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 15)
    OVER (PARTITION BY series_id ORDER BY row_idx) AS loss FROM sc"""
CTES["err"] = """
  SELECT series_id, row_idx, 0.0::DOUBLE AS e FROM ls WHERE row_idx = 0
  UNION ALL
  SELECT l.series_id, l.row_idx, CASE WHEN l.loss IS NULL THEN p.e ELSE 0.8::DOUBLE * p.e + 0.2::DOUBLE * l.loss END
  FROM err p JOIN ls l ON l.series_id = p.series_id AND l.row_idx = p.row_idx + 1"""
CTES["rel"] = f"""
  SELECT sg.*, sev.s AS smoothed_severity, err.e AS error_ema, {CONF('p1')} AS confidence,
    {HARMONIC(CONF('p1'), 'err.e', 'sev.s', '1.0')} AS reliability
  FROM sg JOIN sev USING (series_id, row_idx) JOIN err USING (series_id, row_idx)"""
CTES["alarmed"] = "SELECT *, raw_severity > 0.55 AS alarm FROM rel"
CTES["fl"] = """
  SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx
  FROM lineitem"""
CTES["fd"] = "SELECT *, epoch_us(l_shipdate) / 1e6 - lag(epoch_us(l_shipdate) / 1e6) OVER (ORDER BY row_idx) AS delta_s FROM fl"
CTES["flp"] = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, avg({c}) AS mean, stddev_pop({c}) AS std, "
    f"min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
)
CTES["bl"] = """
  SELECT * EXCLUDE (jump), CAST(sum(jump) OVER (PARTITION BY series_id, role ORDER BY row_idx) AS BIGINT) AS block_id
  FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id, role ORDER BY row_idx) > 43200000000
                       THEN 1 ELSE 0 END AS jump FROM o)"""
CTES["ff"] = """
  SELECT * EXCLUDE (amount, src), amount AS recorded,
    CASE WHEN src.b = block_id THEN src.v END AS amount
  FROM (SELECT *, last_value(CASE WHEN amount IS NOT NULL THEN {'b': block_id, 'v': amount} END IGNORE NULLS)
          OVER (PARTITION BY series_id, role ORDER BY row_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS src FROM bl)"""


def range_out(c: str, k: float) -> str:
    lo = f"least({c}__mean - {k} * {c}__std, {c}__minimum)"
    hi = f"greatest({c}__mean + {k} * {c}__std, {c}__maximum)"
    return f"({c} < {lo} OR {c} > {hi})"


def iqr_out(c: str, k: float) -> str:
    width = f"{k}::DOUBLE * ({c}__q3 - {c}__q1)"
    return f"({c} < {c}__q1 - {width} OR {c} > {c}__q3 + {width})"


CTES["rp"] = f"""
  SELECT ff.*, st.*, recorded IS NULL AND amount IS NOT NULL AS filled, amount IS NULL AS unfilled,
    {range_out('value', 2.0)} AS value__range, {range_out('k', 2.0)} AS k__range,
    {iqr_out('value', 1.0)} AS value__outlier, {iqr_out('k', 1.0)} AS k__outlier,
    {Z('value')} AS z_value, {Z('k')} AS z_k
  FROM ff CROSS JOIN st"""
CTES["rq"] = """
  SELECT *, value__range OR k__range AS range_violation, value__outlier OR k__outlier AS outlier,
    NOT unfilled AS valid, event_type <> 'signup' AS ok FROM rp"""
CTES["len"] = "SELECT series_id, role, count(*) AS n_rows FROM o GROUP BY ALL"
CTES["gr"] = "SELECT series_id, role, n_rows, unnest(range(0, n_rows - 20 + 1, 5)) AS start_index FROM len WHERE n_rows >= 20"
CTES["wr"] = """
  SELECT gr.start_index, q.*, lag(state) OVER (PARTITION BY q.series_id, q.role, start_index ORDER BY q.row_idx) AS before
  FROM gr JOIN rq q ON q.series_id = gr.series_id AND q.role = gr.role
    AND q.row_idx >= gr.start_index AND q.row_idx < gr.start_index + 20"""
CTES["wn"] = """
  SELECT series_id, role, start_index, start_index + 20 AS end_index, min(ts) AS start_time, max(ts) AS end_time,
    count(*) AS n_rows, min(block_id) = max(block_id) AS contiguous, avg(ok::INT) AS valid_fraction,
    count(*) FILTER (WHERE outlier) AS n_outlier, count(*) FILTER (WHERE range_violation) AS n_range_violation
  FROM wr GROUP BY series_id, role, start_index"""
CTES["em"] = """
  SELECT *, row_number() OVER (PARTITION BY series_id, role ORDER BY start_index) - 1 AS window_id
  FROM wn WHERE contiguous AND valid_fraction >= 0.75"""
CTES["lg"] = """
  SELECT *, coalesce(edge_latency_s, 0) + coalesce(network_latency_s, 0) + coalesce(cloud_latency_s, 0) AS total_latency_s,
    CASE WHEN packet_lost THEN 'network failure: packet lost' WHEN NOT success THEN 'model failure' END AS error,
    CASE WHEN NOT success THEN 'FAILED' WHEN cloud_fallback THEN 'FALLBACK' ELSE 'SUCCESS' END AS execution_status,
    CASE WHEN selected_action = 'EDGE' THEN 'edge' WHEN selected_action = 'CLOUD' THEN 'cloud'
         WHEN cloud_fallback THEN 'hybrid_cloud' ELSE 'hybrid_edge' END AS model_used,
    CAST(user_id % 5 AS INTEGER) AS seed
  FROM (SELECT *, NOT packet_lost AND value <= 150 AS success,
      CASE WHEN selected_action <> 'CLOUD' THEN value / 1000.0 END AS edge_latency_s,
      CASE WHEN in_cloud THEN k / 1000.0 END AS network_latency_s,
      CASE WHEN in_cloud AND NOT packet_lost THEN value / 500.0 END AS cloud_latency_s
    FROM (SELECT *, in_cloud AND state = 3 AND value < 30 AS packet_lost
      FROM (SELECT *, selected_action = 'CLOUD' OR cloud_fallback AS in_cloud
        FROM (SELECT *, selected_action = 'HYBRID' AND k < 40 AS cloud_fallback
          FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'EDGE' WHEN event_type = 'purchase' THEN 'CLOUD'
                               ELSE 'HYBRID' END AS selected_action
                FROM o WHERE role = 'inference')))))"""

SCHEDULE = {
    "sudden": "CASE WHEN row_idx >= round_even(0.5 * n_stream, 0) THEN {m}::DOUBLE ELSE 0.0::DOUBLE END",
    "gradual": """CASE WHEN row_idx < round_even(0.5 * n_stream, 0) THEN 0.0::DOUBLE
      WHEN row_idx < least(round_even(0.5 * n_stream, 0) + round_even({dur}::DOUBLE * n_stream, 0), n_stream)
      THEN {m}::DOUBLE * (row_idx - round_even(0.5 * n_stream, 0) + 1)
        / (least(round_even(0.5 * n_stream, 0) + round_even({dur}::DOUBLE * n_stream, 0), n_stream) - round_even(0.5 * n_stream, 0))
      ELSE {m}::DOUBLE END""",
}


def held(c: str, moved: str) -> str:
    mid, half = f"(({c}__maximum + {c}__minimum) / 2.0)", f"(({c}__maximum - {c}__minimum) * 1.5 / 2.0)"
    return (
        f"CASE WHEN schedule > 0 THEN greatest(least({moved}, greatest({mid} + {half}, {c})), least({mid} - {half}, {c})) "
        f"ELSE {c} END"
    )


CTES["sd"] = f"SELECT *, {SCHEDULE['sudden'].format(m=1.5)} AS schedule FROM inf"
CTES["sdo"] = f"""
  SELECT *, {held('value', 'value + schedule * value__std')} AS value_d, {held('k', 'k + schedule * k__std')} AS k_d FROM sd"""
CTES["gt"] = f"SELECT *, {SCHEDULE['gradual'].format(m=3.0, dur=0.1)} AS schedule FROM inf"
CTES["gtd"] = f"SELECT *, {held('value', 'value + schedule * value__std')} AS value_d, {held('k', 'k + schedule * k__std')} AS k_d FROM gt"

# Seeded runs: drift, severity, then the closed loop as one recursion with the open losses in a list.
CTES["sx"] = f"""
  SELECT seed, inf.*, {SCHEDULE['sudden'].format(m=2.0)} AS schedule
  FROM inf CROSS JOIN (SELECT unnest([42, 43, 44, 45, 46]) AS seed)"""
CTES["sz"] = f"""
  SELECT seed, series_id, row_idx, event_id, y, n_stream, value, k, ({held('value', 'value + ' + NORMAL('seed', 'value', 'event_id') + ' * schedule * value__std')} - value__mean) / value__std AS z_value,
    ({held('k', 'k + ' + NORMAL('seed', 'k', 'event_id') + ' * schedule * k__std')} - k__mean) / k__std AS z_k
  FROM sx"""
CTES["sp"] = f"""
  SELECT seed, series_id, row_idx, event_id, y AS label, value, k, z_value, z_k, CAST(round_even(n_stream * 0.5, 0) AS BIGINT) AS onset, {SIGNAL} AS signal,
    least(1.0, abs({SIGNAL} - baseline_mean)) AS raw_severity, {CONF(EDGE_P1)} AS confidence,
    CASE WHEN {EDGE_P1} >= 0.5 THEN 1 ELSE 0 END AS edge_pred, CASE WHEN {CLOUD_P1} >= 0.5 THEN 1 ELSE 0 END AS cloud_pred
  FROM sz CROSS JOIN bm"""
CTES["sq"] = """
  SELECT seed, series_id, row_idx, raw_severity AS s FROM sp WHERE row_idx = 0
  UNION ALL
  SELECT g.seed, g.series_id, g.row_idx, 0.8::DOUBLE * p.s + 0.2::DOUBLE * g.raw_severity
  FROM sq p JOIN sp g ON g.seed = p.seed AND g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
# The retrained method: triggers with their cooldown, candidates, their gate, and the answer of whoever is in force.
_f1 = macro("tp", "fp", "fn", "tn")["f1"]
_class = lambda y, k: f"count(*) FILTER (WHERE {y} = {k}) AS cnt{k}, " + ", ".join(
    f"avg({c}) FILTER (WHERE {y} = {k}) AS {c}_m{k}, var_pop({c}) FILTER (WHERE {y} = {k}) AS {c}_v{k}" for c in ("z_value", "z_k"))
_log = lambda k: f"ln(cnt{k} / (cnt0 + cnt1)) - 0.5::DOUBLE * (" + " + ".join(
    f"ln(2.0 * pi() * {c}_v{k}) + pow({c} - {c}_m{k}, 2) / {c}_v{k}" for c in ("z_value", "z_k")) + ")"
_posterior = f"1.0 / (1.0 + exp(({_log(0)}) - ({_log(1)})))"
CTES["recand"] = """SELECT seed, series_id, row_idx FROM (SELECT *, count(*) FILTER (WHERE raw_severity > 0.55)
    OVER (PARTITION BY seed, series_id ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS alarms FROM sp JOIN sq USING (seed, series_id, row_idx))
  WHERE alarms >= 4 AND s >= 0.35 AND row_idx >= 39"""
CTES["refire"] = """
  SELECT seed, series_id, min(row_idx) AS place FROM recand GROUP BY seed, series_id
  UNION ALL
  SELECT * FROM (SELECT f.seed, f.series_id, (SELECT min(c.row_idx) FROM recand c WHERE c.seed = f.seed AND c.series_id = f.series_id AND c.row_idx >= f.place + 50) AS place
    FROM refire f) WHERE place IS NOT NULL"""
CTES["reatt"] = "SELECT *, row_number() OVER (PARTITION BY seed, series_id ORDER BY place) - 1 AS attempt FROM refire"
CTES["rerow"] = """
  SELECT a.seed, a.series_id, a.attempt, z_value, z_k, label FROM reatt a JOIN sp ON sp.seed = a.seed AND sp.series_id = a.series_id AND sp.row_idx <= a.place - 15 AND sp.row_idx > a.place - 115
  UNION ALL SELECT a.seed, a.series_id, a.attempt, z_value, z_k, y FROM reatt a JOIN n ON n.series_id = a.series_id AND n.role = 'baseline_train'"""
CTES["remom"] = f"SELECT seed, series_id, attempt, {_class('label', 0)}, {_class('label', 1)} FROM rerow GROUP BY seed, series_id, attempt"
CTES["reval"] = f"SELECT remom.seed, n.series_id, remom.attempt, y, ({_posterior} >= 0.5)::INT AS p FROM n JOIN remom ON remom.series_id = n.series_id WHERE role = 'baseline_validation'"
CTES["regate"] = f"""SELECT a.*, c.f AS candidate_metric, b.f AS first_metric FROM reatt a
  JOIN (SELECT seed, series_id, attempt, {_f1} AS f FROM (SELECT seed, series_id, attempt, {matrix('y', 'p')} FROM reval GROUP BY 1, 2, 3)) c
    ON c.seed = a.seed AND c.series_id = a.series_id AND c.attempt = a.attempt
  JOIN (SELECT series_id, {_f1} AS f FROM (SELECT series_id, {matrix('y', 'p')}
    FROM (SELECT series_id, y, ({CLOUD_P1} >= 0.5)::INT AS p FROM n WHERE role = 'baseline_validation') GROUP BY 1)) b ON b.series_id = a.series_id"""
CTES["rehold"] = """
  SELECT seed, series_id, attempt, place, candidate_metric >= 0.4 AND candidate_metric >= first_metric - 0.05 AS ok,
    CASE WHEN candidate_metric >= 0.4 AND candidate_metric >= first_metric - 0.05 THEN candidate_metric ELSE first_metric END AS hold FROM regate WHERE attempt = 0
  UNION ALL
  SELECT g.seed, g.series_id, g.attempt, g.place, g.candidate_metric >= 0.4 AND g.candidate_metric >= p.hold - 0.05,
    CASE WHEN g.candidate_metric >= 0.4 AND g.candidate_metric >= p.hold - 0.05 THEN g.candidate_metric ELSE p.hold END
  FROM rehold p JOIN regate g ON g.seed = p.seed AND g.series_id = p.series_id AND g.attempt = p.attempt + 1"""
CTES["reans"] = f"""
  SELECT q.seed, q.series_id, q.row_idx, CASE WHEN m.attempt IS NULL THEN q.cloud_pred ELSE ({_posterior} >= 0.5)::INT END AS pred
  FROM (SELECT sp.seed, sp.series_id, sp.row_idx, sp.cloud_pred, z_value, z_k, s.attempt AS last
    FROM sp ASOF LEFT JOIN (SELECT * FROM rehold WHERE ok) s ON s.seed = sp.seed AND s.series_id = sp.series_id AND sp.row_idx > s.place) q
  LEFT JOIN remom m ON m.seed = q.seed AND m.series_id = q.series_id AND m.attempt = q.last"""
CTES["sm"] = """
  SELECT method, policy, sp.* REPLACE (CASE WHEN method = 'ADAPTIVE_RETRAINED' THEN reans.pred ELSE sp.cloud_pred END AS cloud_pred),
    sq.s AS smoothed_severity, CASE WHEN sees THEN sq.s ELSE 0.0::DOUBLE END AS drift
  FROM sp JOIN sq USING (seed, series_id, row_idx) JOIN reans USING (seed, series_id, row_idx)
  CROSS JOIN (VALUES ('EDGE_ONLY', 'edge_only', true), ('CLOUD_ONLY', 'cloud_only', true), ('STATIC', 'edge_only', true),
    ('NO_DRIFT_SIGNAL', 'adaptive', false), ('ADAPTIVE', 'adaptive', true), ('ADAPTIVE_RETRAINED', 'adaptive', true)) m(method, policy, sees)"""


def closed_loop(me: str, source: str, keys: tuple[str, ...]) -> str:
    """The routing loop of every run of `source` as one recursion."""
    listed, same = ", ".join(keys), " AND ".join(f"g.{k} = p.{k}" for k in keys)
    return f"""
  SELECT {listed}, -1::BIGINT AS row_idx, 0.0::DOUBLE AS error_ema, 0.0::DOUBLE AS reliability, 'EDGE' AS action,
    -1 AS prediction, false AS cloud_fallback, CAST([] AS DOUBLE[]) AS open_losses FROM {source} WHERE row_idx = 0
  UNION ALL
  SELECT {listed}, row_idx, e, r, a,
    CASE WHEN fell OR a = 'CLOUD' THEN cloud_pred ELSE edge_pred END, fell,
    list_append(rest, CASE WHEN (CASE WHEN fell OR a = 'CLOUD' THEN cloud_pred ELSE edge_pred END) <> label
                           THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  FROM (SELECT *, a = 'HYBRID' AND confidence < 0.6 AS fell
    FROM (SELECT *, CASE WHEN policy = 'edge_only' THEN 'EDGE' WHEN policy = 'cloud_only' THEN 'CLOUD' WHEN r >= 0.7 THEN 'EDGE'
        WHEN r < 0.3 THEN 'CLOUD' WHEN r < 0.5 AND before = 'EDGE' THEN 'HYBRID' ELSE before END AS a
      FROM (SELECT *, {HARMONIC('confidence', 'e', 'drift', '1.0')} AS r
        FROM (SELECT g.*, p.action AS before,
            CASE WHEN len(p.open_losses) = 15 THEN 0.8::DOUBLE * p.error_ema + 0.2::DOUBLE * p.open_losses[1] ELSE p.error_ema END AS e,
            CASE WHEN len(p.open_losses) = 15 THEN p.open_losses[2:] ELSE p.open_losses END AS rest
          FROM {me} p JOIN {source} g ON {same} AND g.row_idx = p.row_idx + 1))))"""


CTES["lp"] = closed_loop("lp", "sm", ("method", "seed", "series_id"))
CTES["ru"] = """
  SELECT sm.* EXCLUDE (drift), lp.error_ema, lp.reliability, lp.action, lp.prediction, lp.cloud_fallback,
    lag(lp.action) OVER (PARTITION BY method, seed, series_id ORDER BY row_idx) AS before
  FROM sm JOIN lp USING (method, seed, series_id, row_idx)"""
CTES["pp"] = f"""
  SELECT method, seed, count(*) FILTER (WHERE row_idx < onset) AS pre_samples, count(*) FILTER (WHERE row_idx >= onset) AS post_samples,
    {matrix('label', 'prediction', 'pre_', 'row_idx < onset')}, {matrix('label', 'prediction', 'post_', 'row_idx >= onset')}
  FROM ru GROUP BY method, seed"""
_pre, _post = macro("pre_tp", "pre_fp", "pre_fn", "pre_tn"), macro("post_tp", "post_fp", "post_fn", "post_tn")
CTES["pq"] = "SELECT method, seed, pre_samples, post_samples, " + ", ".join(
    f"{_pre[s]} AS pre_{s}, {_post[s]} AS post_{s}" for s in _pre
) + " FROM pp"
CTES["rt"] = """
  SELECT method, seed, count(*) AS total_decisions, count(*) FILTER (WHERE action = 'EDGE') AS edge_count,
    count(*) FILTER (WHERE action = 'CLOUD') AS cloud_count, count(*) FILTER (WHERE action = 'HYBRID') AS hybrid_count,
    count(*) FILTER (WHERE action <> before) AS switch_count, count(*) FILTER (WHERE cloud_fallback) AS hybrid_fallback_count
  FROM ru GROUP BY method, seed"""
CTES["tierlat"] = "SELECT series_id, avg(edge_latency_s) AS e, avg(network_latency_s) AS w, avg(cloud_latency_s) AS c FROM lg GROUP BY 1"
CTES["rl"] = """
  SELECT ru.*, CASE WHEN action <> 'CLOUD' THEN e ELSE 0.0 END + CASE WHEN action = 'CLOUD' OR cloud_fallback THEN w + c ELSE 0.0 END AS latency_s
  FROM ru JOIN tierlat USING (series_id)"""
CTES["lab"] = """
  SELECT series_id, row_idx, y AS label, CAST(row_idx + floor(k / 4.0) - CASE WHEN state = 3 THEN 3 ELSE 0 END AS BIGINT) AS arrival_index
  FROM o WHERE role = 'inference' AND event_type <> 'view'"""
CTES["fb"] = """
  SELECT rel.*, lab.label, lab.arrival_index, lab.arrival_index IS NOT NULL AS is_labeled,
    coalesce(lab.arrival_index >= rel.row_idx, true) AS causal
  FROM rel LEFT JOIN lab USING (series_id, row_idx)"""
CTES["el"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY row_idx DESC) AS back FROM fb
    WHERE is_labeled AND causal AND arrival_index <= 150 AND row_idx <= 150 AND row_idx > 50) WHERE back <= 40"""
CTES["ec"] = """
  SELECT r.series_id, r.row_idx, r.raw_severity, r.smoothed_severity, count(f.row_idx) AS n_eligible
  FROM rel r LEFT JOIN fb f ON f.series_id = r.series_id AND f.is_labeled AND f.causal AND f.arrival_index < f.row_idx + 60
    AND f.arrival_index <= r.row_idx AND f.row_idx > r.row_idx - 60
  GROUP BY ALL"""
CTES["cd"] = "SELECT series_id, row_idx FROM ec WHERE raw_severity > 0.3 AND smoothed_severity >= 0.35 AND n_eligible >= 25"
_fire = """
  SELECT series_id, min(row_idx) AS place FROM cd GROUP BY series_id
  UNION ALL
  SELECT * FROM (SELECT f.series_id, (SELECT min(c.row_idx) FROM cd c WHERE c.series_id = f.series_id AND c.row_idx >= f.place + {cool}) AS place
    FROM {me} f) WHERE place IS NOT NULL"""
CTES["f50"] = _fire.format(cool=50, me="f50")
CTES["f30"] = _fire.format(cool=30, me="f30")
CTES["atm"] = """
  SELECT f.series_id, row_number() OVER (PARTITION BY f.series_id ORDER BY f.place) - 1 AS attempt, f.place AS row_idx, ec.smoothed_severity >= 0.45 AS ok
  FROM f30 f JOIN ec ON ec.series_id = f.series_id AND ec.row_idx = f.place"""
CTES["va"] = """
  SELECT *, CAST(sum(ok::INT) OVER (PARTITION BY series_id ORDER BY attempt) AS BIGINT) AS done FROM atm"""
CTES["smp"] = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {UNIFORM("'42'", 'sample', 'event_id')}) AS place
    FROM n WHERE role = 'baseline_train') WHERE place <= CASE WHEN y = 0 THEN 194 ELSE 6 END"""
CTES["nb"] = "SELECT y AS label, count(*) AS n, " + ", ".join(
    f"sum({c}::DOUBLE) AS {c}__sum, sum({c}::DOUBLE * {c}) AS {c}__sq" for c in ("z_value", "z_k", "state")
) + " FROM n WHERE role = 'baseline_train' GROUP BY y"


def _nb_term(side: str) -> str:
    terms = [f"ln({side}.n / (a.n + b.n))"]
    for c in ("z_value", "z_k", "state"):
        mean, var = f"({side}.{c}__sum / {side}.n)", f"greatest({side}.{c}__sq / {side}.n - pow({side}.{c}__sum / {side}.n, 2), 1e-9)"
        terms.append(f"-0.5::DOUBLE * (ln(2.0 * pi() * {var}) + pow(n.{c} - {mean}, 2) / {var})")
    return " + ".join(terms)


CTES["nbs"] = f"""
  SELECT n.event_id, n.y, n.z_value, n.z_k, 1.0 / (1.0 + exp(({_nb_term('a')}) - ({_nb_term('b')}))) AS p1
  FROM n, (SELECT * FROM nb WHERE label = 0) a, (SELECT * FROM nb WHERE label = 1) b WHERE n.role = 'baseline_validation'"""

_ORDER = list(CTES)


def _needs(text: str) -> set[str]:
    return {c for c in _ORDER if re.search(rf"(FROM|JOIN|,)\s+{c}\b", text)}


def sql(name: str, body: str) -> None:
    """Register `body` with the shared parts it refers to, in order."""
    want, grow = set(), _needs(body)
    while grow - want:
        want |= grow
        grow = set().union(*(_needs(CTES[c]) for c in want))
    parts = ",\n".join(f"{c} AS MATERIALIZED ({CTES[c]})" if c not in _needs(CTES[c]) else f"{c} AS ({CTES[c]})" for c in _ORDER if c in want)
    SQL[name] = f"WITH RECURSIVE {parts}\n{body}" if parts else body


WIN = "PARTITION BY series_id, role ORDER BY row_idx"
SER = "PARTITION BY series_id ORDER BY row_idx"

# ---- scans and sinks ---------------------------------------------------------------------------
sql("scan_delimited", f"""
  SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum, {d('avg(value)', 'mean_value')},
    {stamp("min(date_trunc('second', ts))", 'first_at')}, CAST(0 AS BIGINT) AS n_unparsed FROM events GROUP BY event_type""")
sql("scan_time_range", f"""SELECT event_id, {stamp('ts', 'ts')}, {d('value', 'value')} FROM t
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
sql("scan_row_cap", "SELECT series_id, role, row_idx, event_id FROM o WHERE row_idx < 20")
sql("split_by_role", "SELECT role, count(*) AS n_rows, true AS known FROM t GROUP BY role")
sql("extract_labels", "SELECT series_id, role, row_idx, y AS label FROM o")
sql("sink_event_log", """
  SELECT CAST(row_number() OVER (PARTITION BY series_id ORDER BY start_index) - 1 AS VARCHAR) AS window_id,
    CAST(start_index AS VARCHAR) AS start_index, CAST(end_index AS VARCHAR) AS end_index,
    rtrim(rtrim(strftime(start_time, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start_time,
    rtrim(rtrim(strftime(end_time, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS end_time,
    CAST(n_rows AS VARCHAR) AS n_rows, '1' AS contiguous, CAST(valid_fraction AS VARCHAR) AS valid_fraction
  FROM wn WHERE contiguous AND role = 'inference'""")
_flags = ", ".join(n_if(c, f"n_{c}") for c in ("valid", "range_violation", "outlier", "filled", "unfilled"))
sql("sink_quality_row", f"""SELECT role, 'preprocess' AS stage, count(*) AS n_rows, {_flags},
  {n_if('range_violation', 'n_validation_failed')}, 'frozen baseline' AS note FROM rq GROUP BY role""")
_landed = lambda c: f"avg({c}_d - {c}) FILTER (WHERE schedule > 0) / max({c}__std)"
_less = lambda c: f"CASE WHEN abs({_landed(c)}) < 0.95::DOUBLE * avg(schedule) FILTER (WHERE schedule > 0) THEN '{c} clipped' END"
_truth = f"""SELECT {{by}} 'gradual' AS scenario, 'offset' AS mechanism, min(row_idx) FILTER (WHERE schedule > 0) AS drift_start_index,
    max(row_idx) FILTER (WHERE schedule > 0) + 1 AS drift_end_index, 'value|k' AS affected_features, 3.0::DOUBLE AS drift_magnitude,
    {d(_landed('value'), 'realised_value')}, {d(_landed('k'), 'realised_k')}, concat_ws('; ', {_less('value')}, {_less('k')}) AS notes,
    42 AS random_seed {{more}} FROM gtd GROUP BY series_id"""
sql("sink_ground_truth", _truth.format(by="", more=""))

# ---- row checks ---------------------------------------------------------------------------------
sql("parse_ts_strict", """
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'signup') AS n_unparsed,
    (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS s FROM events
      WHERE event_type = 'signup' ORDER BY s LIMIT 5)) AS samples FROM events""")
sql("project_features", "\n UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, {d(f'avg({c})', 'mean')} FROM t" for c in ("value", "k", "state")))
sql("check_numeric", "\n UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS n_not_numeric, "
    f"count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) = 0 AS is_numeric FROM lineitem"
    for c in ("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")))
_gone = {c: f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("value", "k", "state", "amount", "event_type")}
sql("missing_census", "\n UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {g} AS n_missing, {' + '.join(_gone.values())} AS n_missing_total FROM t" for c, g in _gone.items()))
_seen = {c: c in ("event_id", "event_type", "user_id", "ts", "y", "series_id", "role", "row_idx") for c in
  ("series_id", "event_id", "ts", "user_id", "event_type", "value", "k", "state", "y", "amount", "role", "row_idx", "z_value", "z_k")}
sql("leakage_refusals", "\n UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n_values, {str(no).lower()} AS is_refused FROM n""" for c, no in _seen.items()))
sql("leakage_guard", "SELECT y, count(*) AS n FROM n WHERE role = 'baseline_train' GROUP BY y")
sql("validate_observation", """SELECT event_type, CASE WHEN amount IS NULL THEN 'missing' WHEN k = 0 THEN 'not_finite' ELSE 'ok' END AS error,
  count(*) AS n FROM t GROUP BY 1, 2""")
sql("validate_prediction", """
  SELECT CASE WHEN event_type = 'signup' THEN 'label' WHEN state = 3 THEN 'missing_probability'
      WHEN p0 < -1e-9 OR p0 > 1 + 1e-9 OR p1 < -1e-9 OR p1 > 1 + 1e-9 THEN 'out_of_range'
      WHEN abs(p0 + p1 - 1.0) > 1e-4 THEN 'sum' ELSE 'ok' END AS error, count(*) AS n
  FROM (SELECT *, (k + state * 5) / 100.0 AS p1, 1.0 - k / 100.0 - CASE WHEN event_type = 'click' THEN 0.05 ELSE 0.0 END AS p0 FROM t)
  GROUP BY 1""")
sql("range_check", f"""SELECT role, {n_if(range_out('value', 2.0) + ' OR ' + range_out('k', 2.0), 'n_rows')},
  {n_if(range_out('value', 2.0), 'n_value')}, {n_if(range_out('k', 2.0), 'n_k')} FROM n GROUP BY role""")
sql("ts_order_flags", """
  SELECT l_returnflag, CAST(0 AS BIGINT) AS n_back, count(*) - count(DISTINCT l_shipdate) AS n_duplicate FROM lineitem GROUP BY 1""")
sql("ts_arrival_flags", """
  SELECT l_returnflag, count(*) FILTER (WHERE l_shipdate < before) AS n_back, count(*) FILTER (WHERE seen > 1) AS n_duplicate
  FROM (SELECT l_returnflag, l_shipdate, lag(l_shipdate) OVER w AS before, row_number() OVER (PARTITION BY l_returnflag, l_shipdate) AS seen
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))
  GROUP BY 1""")
sql("outlier_flags_iqr", f"""SELECT event_id, {iqr_out('value', 1.0)} AS value__outlier, {iqr_out('k', 1.0)} AS k__outlier FROM n
  WHERE {iqr_out('value', 1.0)} OR {iqr_out('k', 1.0)}""")
_zo = lambda c: f"(abs({c} - {c}__mean) > 1.5::DOUBLE * {c}__std)"
sql("outlier_flags_zscore", f"SELECT event_id, {_zo('value')} AS value__outlier, {_zo('k')} AS k__outlier FROM n WHERE {_zo('value')} OR {_zo('k')}")
sql("outlier_clip", f"""SELECT event_id, {d('greatest(value__q1 - 0.5 * (value__q3 - value__q1), least(value__q3 + 0.5 * (value__q3 - value__q1), value))', 'value')} FROM n""")
sql("degenerate_bounds", f"""
  SELECT c.*, n_rows_flagged, n_rows_flagged_excluding FROM
  (SELECT count(*) FILTER (WHERE a OR b OR f) AS n_rows_flagged, count(*) FILTER (WHERE a OR b) AS n_rows_flagged_excluding,
     count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb_, count(*) FILTER (WHERE f) AS nf
   FROM (SELECT {iqr_out('value', 3.0)} AS a, {iqr_out('k', 3.0)} AS b, k > 90 AS f FROM n)) s,
  LATERAL (VALUES ('value', false, s.na), ('k', false, s.nb_), ('flat', true, s.nf)) c("column", degenerate, n_flagged)""")
sql("row_validity", f"SELECT role, count(*) AS n, {n_if('valid', 'n_valid')}, {n_if('outlier', 'n_outlier')} FROM rq GROUP BY role")
sql("select_zero_variance", """SELECT * FROM (VALUES ('fixed', true, false, 'undeclared'), ('dead', true, true, 'agrees'), ('state', false, true, 'varies'))
  v("column", measured, declared, status) WHERE (SELECT count(DISTINCT state) FROM t) > 1""")
sql("classify_columns", """SELECT "column", n_unique, CASE WHEN "column" = 'l_tax' THEN 'continuous' WHEN n_unique <= 10 THEN 'discrete' ELSE 'continuous' END AS kind,
  CASE WHEN "column" = 'l_tax' THEN 'override' ELSE 'cardinality' END AS decided_by FROM flp""")
sql("exclude_siblings", """SELECT "column", n_unique FROM flp WHERE "column" NOT IN ('l_quantity', 'l_extendedprice')""")
sql("resolve_target", """SELECT "column", n_unique, n_unique <= 10 AS is_discrete FROM flp WHERE "column" = 'l_linenumber'""")
_bad = lambda x: f"count(*) FILTER (WHERE NOT coalesce({x} BETWEEN 0 AND 1, false))"
sql("unit_interval_check", f"SELECT event_type, {_bad('value / 100.0')} AS a_violations, {_bad('k / 50.0')} AS b_violations, {_bad('amount / 400.0')} AS c_violations FROM t GROUP BY 1")

# ---- profiles -----------------------------------------------------------------------------------
_prof = lambda c, src, dg: f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, {d(f'avg({c})', 'mean', dg)}, {d(f'stddev_pop({c})', 'std', dg)},
  {d(f'min({c})::DOUBLE', 'minimum', dg)}, {d(f'max({c})::DOUBLE', 'maximum', dg)}, count(DISTINCT {c}) <= 10 AS is_discrete, count(DISTINCT {c}) <= 1 AS zero_variance FROM {src}"""
sql("profile_baseline", "\n UNION ALL ".join(_prof(c, "t WHERE role = 'baseline_train'", 6) for c in ("value", "k", "state")))
_FLOW = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
sql("profile_flow", "\n UNION ALL ".join(_prof(c, "lineitem", 4) for c in _FLOW))
_fit = lambda c, src, dg: f"""SELECT '{c}' AS "column", count(*) AS n_rows, {d(f'avg({c})', 'mean', dg)}, {d(f'stddev_pop({c})', 'std', dg)},
  {d(f'min({c})::DOUBLE', 'minimum', dg)}, {d(f'max({c})::DOUBLE', 'maximum', dg)}, {d(f'quantile_cont({c}::DOUBLE, 0.25)', 'q1', dg)}, {d(f'quantile_cont({c}::DOUBLE, 0.75)', 'q3', dg)} FROM {src}"""
sql("fit_statistics", "\n UNION ALL ".join(_fit(c, "t WHERE role = 'baseline_train'", 6) for c in ("value", "k")))
sql("fit_statistics_flow", "\n UNION ALL ".join(_fit(c, "lineitem", 4) for c in _FLOW))
sql("exact_quantiles", "\n UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", " + ", ".join(d(f"quantile_cont({c}, {p})", f"q{i}") for i, p in enumerate((0.01, 0.5, 0.95, 0.999)))
    + " FROM lineitem GROUP BY l_returnflag" for c in ("l_extendedprice", "l_quantity")))
sql("apply_frozen_stats", f"SELECT event_id, {d('z_value', 'z_value')}, {d('z_k', 'z_k')} FROM n")
sql("top_variance", f"""SELECT "column", {d('std', 'std', 4)} FROM flp WHERE n_unique > 10 ORDER BY flp.std DESC, "column" LIMIT 2""")
_chan = "[{'k': -count(*) FILTER (WHERE value__range), 'n': 'value.range'}, {'k': -count(*) FILTER (WHERE value__outlier), 'n': 'value.outlier'}, {'k': -count(*) FILTER (WHERE k__range), 'n': 'k.range'}, {'k': -count(*) FILTER (WHERE k__outlier), 'n': 'k.outlier'}]"
sql("quality_summary", f"""SELECT role, count(*) AS n_rows, {_flags}, {n_if('range_violation', 'n_validation_failed')},
  array_to_string(list_transform(list_sort(list_filter({_chan}, lambda x: x.k < 0)), lambda x: x.n || ':' || (-x.k)), '|') AS top_channels
  FROM rq GROUP BY role""")
sql("top_offenders", """SELECT * FROM (
    SELECT 'value.range' AS channel, count(*) FILTER (WHERE value__range) AS n_flagged FROM rq
    UNION ALL SELECT 'value.outlier', count(*) FILTER (WHERE value__outlier) FROM rq
    UNION ALL SELECT 'k.range', count(*) FILTER (WHERE k__range) FROM rq
    UNION ALL SELECT 'k.outlier', count(*) FILTER (WHERE k__outlier) FROM rq) WHERE n_flagged > 0 ORDER BY n_flagged DESC, channel LIMIT 3""")
sql("baseline_signal_mean", f"SELECT {d('baseline_mean', 'baseline_mean')} FROM bm")

# ---- order and causal windows -----------------------------------------------------------------------
sql("causal_order", "SELECT row_idx, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM fl")
sql("gap_blocks", "SELECT series_id, role, row_idx, block_id FROM bl")
sql("forward_fill", f"""SELECT series_id, role, row_idx, {d('amount', 'amount')}, recorded IS NULL AND amount IS NOT NULL AS filled, amount IS NULL AS unfilled FROM ff""")
_roll = "(PARTITION BY series_id, role, block_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
sql("trailing_mean", f"SELECT series_id, role, row_idx, {d(f'avg(value) OVER {_roll}', 'smooth')} FROM bl")
sql("trailing_median", f"SELECT series_id, role, row_idx, {d(f'quantile_cont(value, 0.5) OVER {_roll}', 'smooth')} FROM bl")
sql("normalize_frozen", f"SELECT series_id, role, row_idx, {d('z_value', 'z_value')}, {d('z_k', 'z_k')} FROM n")
_mm = lambda c: d(f"({c} - {c}__minimum) / greatest({c}__maximum - {c}__minimum, 1e-8)", f"{c}_minmax")
sql("normalize_minmax", f"SELECT event_id, {_mm('value')}, {_mm('k')} FROM n")


def _running(c: str) -> str:
    n = f"(n0 + count({c}) OVER w)"
    m = f"((n0 * {c}__mean + sum({c}) OVER w) / {n})"
    v = f"((n0 * ({c}__std * {c}__std + {c}__mean * {c}__mean) + sum({c} * {c}) OVER w) / {n} - {m} * {m})"
    return d(f"({c} - {m}) / greatest(sqrt(greatest({v}, 0.0)), 1e-8)", f"{c}__run")


sql("normalize_running", f"SELECT series_id, row_idx, {_running('value')}, {_running('k')} FROM inf WINDOW w AS ({SER})")
CTES["tail"] = """
  SELECT series_id, row_idx - n_rows AS row_idx, value, k FROM o JOIN len USING (series_id, role)
  WHERE role = 'baseline_train' AND row_idx >= n_rows - 50"""
_ORDER.append("tail")
_rl = lambda c: d(f"({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, 1e-8)", f"{c}__roll")
sql("normalize_rolling", f"""SELECT * FROM (SELECT series_id, row_idx, {_rl('value')}, {_rl('k')}
  FROM (SELECT series_id, row_idx, value, k FROM inf UNION ALL SELECT * FROM tail)
  WINDOW w AS ({SER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE row_idx >= 0""")
CTES["rw"] = f"""
  SELECT series_id, role, min(row_idx) AS start_index, min_by(a, row_idx) AS first_half_positives, min_by(b, row_idx) AS second_half_positives
  FROM (SELECT *, CAST(sum(y) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS BIGINT) AS a,
      CAST(sum(y) OVER ({WIN} ROWS BETWEEN 30 FOLLOWING AND 59 FOLLOWING) AS BIGINT) AS b,
      count(*) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS size FROM o)
  WHERE size = 60 AND a >= 7 AND b >= 7 GROUP BY series_id, role"""
_ORDER.append("rw")
sql("representative_window", "SELECT * FROM rw")
sql("window_metadata", f"""SELECT series_id, role, start_index, start_index + 60 AS end_index, count(*) AS n_rows, {n_if('y = 0', 'class_0')}, {n_if('y = 1', 'class_1')},
  {d('avg(y)', 'positive_rate')}, {n_if('y = 1 AND row_idx < start_index + 30', 'pre_positives')}, {n_if('y = 1 AND row_idx >= start_index + 30', 'post_positives')}
  FROM rw JOIN o USING (series_id, role) WHERE row_idx >= start_index AND row_idx < start_index + 60 GROUP BY ALL""")
_cum = lambda cond, name: f"count(*) FILTER (WHERE {cond}) OVER ({SER}) AS {name}"
sql("running_counters", f"""SELECT series_id, row_idx, {_cum("selected_action = 'EDGE'", 'n_edge')}, {_cum("selected_action = 'CLOUD'", 'n_cloud')},
  {_cum("selected_action = 'HYBRID'", 'n_hybrid')}, {_cum('selected_action <> before', 'n_switches')}, {_cum('NOT success', 'n_failed')}
  FROM (SELECT *, lag(selected_action) OVER ({SER}) AS before FROM lg)""")
sql("recent_history", f"SELECT series_id, role, row_idx, event_id, {d('value', 'value')} FROM o JOIN len USING (series_id, role) WHERE row_idx >= n_rows - 10")

# ---- count windows ------------------------------------------------------------------------------------
sql("window_grid", "SELECT series_id, role, n_rows, start_index, start_index + 20 AS end_index FROM gr")
sql("sliding_windows", f"""SELECT series_id, role, window_id, start_index, end_index, {stamp('start_time', 'start_time')}, {stamp('end_time', 'end_time')},
  {d('valid_fraction', 'valid_fraction')} FROM em""")
sql("window_stats", """
  SELECT len.series_id, len.role, len.n_rows AS n_rows_available, count(start_index) AS n_candidate,
    count(*) FILTER (WHERE contiguous AND valid_fraction >= 0.75) AS n_emitted, count(*) FILTER (WHERE NOT contiguous) AS n_skipped_noncontiguous,
    count(*) FILTER (WHERE contiguous AND valid_fraction < 0.75) AS n_skipped_invalid, len.n_rows - coalesce(max(end_index), 0) AS trailing_rows_dropped
  FROM len LEFT JOIN wn ON wn.series_id = len.series_id AND wn.role = len.role GROUP BY len.series_id, len.role, len.n_rows""")
sql("interleaved_events", """
  SELECT series_id, role, row_idx, row_number() OVER (PARTITION BY series_id, role ORDER BY row_idx, kind) - 1 AS arrival, kind, window_id
  FROM (SELECT series_id, role, row_idx, 'sample' AS kind, CAST(NULL AS BIGINT) AS window_id FROM o
    UNION ALL SELECT series_id, role, end_index - 1, 'window', window_id FROM em)""")
_cf = lambda c: ", ".join([d(f"avg({c})", f"{c}__mean"), d(f"stddev_pop({c})", f"{c}__std"), d(f"min({c})", f"{c}__min"), d(f"max({c})", f"{c}__max"),
                           d(f"max_by({c}, row_idx)", f"{c}__last"), d(f"regr_slope({c}, row_idx)", f"{c}__slope")])
sql("window_features_continuous", f"SELECT series_id, role, start_index, {_cf('z_value')}, {_cf('z_k')} FROM wr GROUP BY series_id, role, start_index")
_mode = lambda c, src, keys: f"""(SELECT {keys}, {c} AS m FROM (SELECT {keys}, {c}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {c}) AS place
  FROM {src} GROUP BY {keys}, {c}) WHERE place = 1)"""
_K = "series_id, role, start_index"
sql("window_features_discrete", f"""SELECT {_K}, m AS state__mode, state__n_changes FROM
  (SELECT {_K}, count(*) FILTER (WHERE state <> before) AS state__n_changes FROM wr GROUP BY {_K}) JOIN {_mode('state', 'wr', _K)} USING ({_K})""")
sql("window_flags", f"SELECT {_K}, n_outlier, n_range_violation, {d('valid_fraction', 'valid_fraction')}, contiguous FROM wn")
sql("window_label", f"""SELECT {_K}, any_positive, m AS majority, last FROM
  (SELECT {_K}, CASE WHEN max(y) = 1 THEN 1 ELSE min_by(y, row_idx) END AS any_positive, max_by(y, row_idx) AS last FROM wr GROUP BY {_K})
  JOIN {_mode('y', 'wr', _K)} USING ({_K})""")
CTES["wf"] = """
  SELECT g.start_index, q.*, lag(state) OVER (PARTITION BY q.series_id, g.start_index ORDER BY q.row_idx) AS before
  FROM (SELECT series_id, unnest(range(0, n_rows - 50 + 1, 10)) AS start_index FROM len WHERE role = 'inference' AND n_rows >= 50) g
  JOIN rq q ON q.series_id = g.series_id AND q.role = 'inference' AND q.row_idx >= g.start_index AND q.row_idx < g.start_index + 50"""
_ORDER.append("wf")
sql("feature_order", f"""SELECT * EXCLUDE (m), m AS state__mode FROM
  (SELECT series_id, start_index, {_cf('z_value')}, {_cf('z_k')}, count(*) FILTER (WHERE state <> before) AS state__n_changes FROM wf GROUP BY series_id, start_index)
  JOIN {_mode('state', 'wf', 'series_id, start_index')} USING (series_id, start_index)""")

# ---- drift injection ------------------------------------------------------------------------------------
_re = lambda x: f"round_even({x}, 0)"
_lv = lambda body: f"SELECT series_id, row_idx, {d(body, 'schedule')} FROM inf"
sql("schedule_sudden", _lv(f"CASE WHEN row_idx >= {_re('0.4 * n_stream')} AND row_idx < {_re('0.9 * n_stream')} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END"))
sql("schedule_gradual", _lv(SCHEDULE["gradual"].format(m=3.0, dur=0.2)))
_cyc = " OR ".join(
    f"(row_idx >= {_re('0.2 * n_stream')} + {2 * i} * {_re('0.1 * n_stream')} AND row_idx < {_re('0.2 * n_stream')} + {2 * i + 1} * {_re('0.1 * n_stream')})" for i in range(3))
sql("schedule_recurring", _lv(f"CASE WHEN {_cyc} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END"))
_b = lambda j: f"round_even({_re('0.3 * n_stream')} + (n_stream - {_re('0.3 * n_stream')}) * {j}::DOUBLE / 5, 0)"
sql("schedule_stress", _lv("CASE " + " ".join(f"WHEN row_idx < {_b(j)} THEN {3.0 * j / 5}::DOUBLE" for j in range(6)) + " ELSE 3.0::DOUBLE END"))
sql("drift_channels", f"""
  SELECT * FROM (SELECT "column", false AS is_discrete, true AS modified, 'top_variance' AS policy FROM flp WHERE n_unique > 10 ORDER BY std DESC, "column" LIMIT 2)
  UNION ALL SELECT * FROM (SELECT "column", false, true, 'random' FROM flp WHERE n_unique > 10 ORDER BY {UNIFORM("'42'", 'channels', '"column"')}, "column" LIMIT 2)
  UNION ALL SELECT "column", false, true, 'all_continuous' FROM flp WHERE n_unique > 10
  UNION ALL SELECT "column", n_unique <= 10, n_unique > 10, 'explicit' FROM flp WHERE "column" IN ('l_tax', 'l_quantity')""")
_inj = lambda v, k: f"SELECT event_id, {d(held('value', v), 'value__drifted')}, {d(held('k', k), 'k__drifted')} FROM sd"
sql("inject_offset", _inj("value + schedule * value__std", "k + schedule * k__std"))
sql("inject_scale", _inj("value * (1.0 + schedule)", "k * (1.0 + schedule)"))
sql("inject_noise", _inj(f"value + {NORMAL(chr(39) + '42' + chr(39), 'value', 'event_id')} * schedule * value__std", f"k + {NORMAL(chr(39) + '42' + chr(39), 'k', 'event_id')} * schedule * k__std"))
_th = "(schedule * pi() / 4.0)"
sql("inject_correlation", _inj(
    f"(z_value * cos({_th}) - z_k * sin({_th})) * value__std + value__mean", f"(z_value * sin({_th}) + z_k * cos({_th})) * k__std + k__mean"))
sql("inject_relative", _inj("value + schedule * abs(value)", "k + schedule * abs(k)"))
_s42 = "'42'"
sql("inject_state_flip", f"""
  SELECT event_id, state, CASE WHEN {UNIFORM(_s42, 'state/flip', 'event_id')} < 0.6::DOUBLE * schedule / 3.0
    THEN list_filter([0, 1, 2, 3], lambda x: x <> state)[CAST(floor({UNIFORM(_s42, 'state/state', 'event_id')} * 3) AS INTEGER) + 1] ELSE state END AS flipped
  FROM gt WHERE (SELECT count(DISTINCT state) FROM inf) = 4""")
sql("clip_physical", f"""SELECT series_id, {n_if('schedule > 0 AND abs(k + schedule * k__std - k_d) > 1e-9', 'n_clipped')}, {d('min(k_d)', 'lowest')}, {d('max(k_d)', 'highest')} FROM sdo GROUP BY 1""")
sql("injection_guards", "SELECT role, count(*) AS n, role = 'inference' AS may_drift FROM t GROUP BY role")
sql("ground_truth", _truth.format(by="series_id,", more=", count(*) AS n_rows, count(*) FILTER (WHERE schedule > 0) AS n_drifted_rows"))
sql("realised_magnitude", "\n UNION ALL ".join(f"""
  SELECT series_id, {d('avg(schedule)', 'requested')}, count(*) AS n_drifted_rows, '{c}' AS "column", {d(f'avg({c}_d - {c}) / max({c}__std)', 'realised')},
    {d(f'avg({c}_d - {c}) / max({c}__std) / avg(schedule)', 'attenuation')} FROM sdo WHERE schedule > 0 GROUP BY 1""" for c in ("value", "k")))
sql("measured_shift", f"""SELECT series_id, {d('avg(value_d - value) FILTER (WHERE schedule > 0)', 'raw_shift')},
  {d('avg(value_d) FILTER (WHERE schedule > 0) - avg(value_d) FILTER (WHERE schedule = 0)', 'level_shift')} FROM sdo GROUP BY 1""")
sql("measured_window_shift", f"""
  SELECT series_id, {d('avg(m) FILTER (WHERE start_index >= onset) - avg(m) FILTER (WHERE start_index + 20 <= onset)', 'window_shift')}
  FROM (SELECT q.series_id, g.start_index, avg(q.value_d) AS m FROM gr g JOIN sdo q ON q.series_id = g.series_id AND g.role = 'inference'
      AND q.row_idx >= g.start_index AND q.row_idx < g.start_index + 20 GROUP BY 1, 2)
  JOIN (SELECT series_id, min(row_idx) FILTER (WHERE schedule > 0) AS onset FROM sdo GROUP BY 1) USING (series_id) GROUP BY 1""")
CTES["ab"] = f"""
  SELECT * FROM (SELECT series_id, row_idx, schedule, (x - m) / s AS frozen,
    (x - (n0 * m + sum(x) OVER w) / (n0 + count(x) OVER w)) / sqrt((n0 * (s * s + m * m) + sum(x * x) OVER w) / (n0 + count(x) OVER w)
      - pow((n0 * m + sum(x) OVER w) / (n0 + count(x) OVER w), 2)) AS running
  FROM (SELECT series_id, row_idx, schedule, value_d AS x, value__mean AS m, value__std AS s, n0 FROM sdo) WINDOW w AS ({SER}))
  JOIN (SELECT series_id, row_idx, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-8) AS rolling
    FROM (SELECT series_id, row_idx, value_d AS x FROM sdo UNION ALL SELECT series_id, row_idx, value FROM tail)
    WINDOW w AS ({SER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) USING (series_id, row_idx)"""
_ORDER.append("ab")
_sh = lambda c: f"(avg({c}) FILTER (WHERE schedule > 0) - avg({c}) FILTER (WHERE schedule = 0))"
sql("drift_absorption", f"""SELECT series_id, {d(_sh('frozen'), 'frozen')}, {d(_sh('running'), 'running')}, {d(_sh('rolling'), 'rolling')},
  {d(_sh('running') + ' / ' + _sh('frozen'), 'running_retained')}, {d(_sh('rolling') + ' / ' + _sh('frozen'), 'rolling_retained')} FROM ab GROUP BY 1""")

# ---- audits ------------------------------------------------------------------------------------------------
CTES["ta"] = f"""
  SELECT 'flow' AS stream, count(*) AS n_rows, min(l_shipdate) AS f0, max(l_shipdate) AS l0, true AS monotonic_increasing,
    count(*) - count(DISTINCT l_shipdate) AS n_duplicate_timestamps, count(*) FILTER (WHERE delta_s > 86400) AS n_gaps, max(delta_s) AS max_gap_s,
    (SELECT delta_s FROM fd WHERE delta_s IS NOT NULL GROUP BY delta_s ORDER BY count(*) DESC, delta_s LIMIT 1) AS modal_interval_s FROM fd"""
_ORDER.append("ta")
_ta = f"""stream, n_rows, {stamp('f0', 'first_ts')}, {stamp('l0', 'last_ts')}, monotonic_increasing, n_duplicate_timestamps, n_gaps,
  {d('max_gap_s', 'max_gap_s')}, {d('modal_interval_s', 'modal_interval_s')}, n_gaps + 1 AS n_blocks"""
sql("time_axis_report", f"SELECT {_ta} FROM ta")
CTES["xs"] = f"SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({WIN})) / 1e6 AS delta_s FROM o"
_ORDER.append("xs")
sql("time_axis_by_series", f"""
  SELECT series_id, role, count(*) AS n_rows, {stamp('min(ts)', 'first_ts')}, {stamp('max(ts)', 'last_ts')}, true AS monotonic_increasing,
    count(*) - count(DISTINCT ts) AS n_duplicate_timestamps, {n_if('delta_s > 43200', 'n_gaps')}, {d('max(delta_s)', 'max_gap_s')},
    {d('any_value(m)', 'modal_interval_s')}, count(*) FILTER (WHERE delta_s > 43200) + 1 AS n_blocks
  FROM xs JOIN {_mode('delta_s', '(SELECT series_id, role, delta_s FROM xs WHERE delta_s IS NOT NULL) y', 'series_id, role')} USING (series_id, role) GROUP BY series_id, role""")
sql("load_report", f"""SELECT {_ta}, n_rows = 1000 AS row_count_matches, f0 = TIMESTAMP '1995-01-01' AND l0 = TIMESTAMP '2001-12-31' AS time_range_matches,
  concat_ws('|', CASE WHEN n_rows <> 1000 THEN 'row count differs' END, CASE WHEN n_duplicate_timestamps > 0 THEN n_duplicate_timestamps || ' duplicate timestamps' END,
    CASE WHEN modal_interval_s <> 86400 THEN 'modal interval differs' END, CASE WHEN n_gaps > 0 THEN n_gaps || ' gaps; ' || (n_gaps + 1) || ' blocks' END,
    CASE WHEN f0 <> TIMESTAMP '1995-01-01' OR l0 <> TIMESTAMP '2001-12-31' THEN 'time range differs' END) AS findings FROM ta""")
#: The driver's tables with their columns by kind: x doubles, t stamps, a lists of floats, the rest (s) read as text as they are.
_TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:x c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:x", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:x",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:x o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:x l_extendedprice:x l_discount:x l_tax:x l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:x props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:a label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
_COLUMNS = {t: [(c.partition(":")[0], c.partition(":")[2] or "s") for c in cs.split()] for t, cs in _TABLES.items()}


def _fixed(c: str, kind: str) -> str:
    """The fixed text of a value."""
    if kind == "x":
        return f"CASE WHEN isnan({c}) THEN 'nan' WHEN abs({c}) >= 9e12 THEN 'huge' ELSE CAST(CAST(floor({c} * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END"
    if kind == "t":
        return f"CAST(epoch_us({c}) AS VARCHAR)"
    if kind == "a":
        return f"array_to_string(list_transform({c}, lambda x: CAST(CAST(floor(x::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)), ',')"
    return f"CAST({c} AS VARCHAR)"


sql("dataset_audit", "\n UNION ALL ".join(f"""
  SELECT '{tb}' AS table_name, '{c}' AS "column", CAST(sum(k) AS BIGINT) AS n_rows,
    CAST(coalesce(sum(k) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS n_missing, count(v) > 12 AS is_wide, CASE WHEN count(v) <= 12 THEN count(v) END AS n_unique,
    CASE WHEN count(v) <= 12 THEN string_agg(v || ':' || k, '|' ORDER BY v || ':' || k) FILTER (WHERE v IS NOT NULL) END AS distribution, count(v) <= 1 AS zero_variance
  FROM (SELECT {_fixed(c, kind)} AS v, count(*) AS k FROM {tb} GROUP BY 1)""" for tb, cs in _COLUMNS.items() for c, kind in cs))
_STAMPS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
sql("table_facts", "\n UNION ALL ".join(f"""
  SELECT '{tb}' AS table_name, count(*) AS n_rows, {len(cs)} AS n_columns, md5('{"|".join(sorted(c for c, _ in cs))}') AS column_set_id,
    """ + (f"""'{_STAMPS[tb]}' AS time_column, {stamp(f'min({_STAMPS[tb]})', 'first_ts')}, {stamp(f'max({_STAMPS[tb]})', 'last_ts')}, count(DISTINCT {_STAMPS[tb]}) AS n_stamps FROM {tb}"""
    if tb in _STAMPS else f"NULL::VARCHAR AS time_column, {stamp('max(NULL::TIMESTAMP)', 'first_ts')}, {stamp('max(NULL::TIMESTAMP)', 'last_ts')}, NULL::BIGINT AS n_stamps FROM {tb}") for tb, cs in _COLUMNS.items()))


def _digested(name: str, source: str, cs: list[tuple[str, str]]) -> str:
    cells = ", ".join(f"coalesce({_fixed(c, kind)}, '\\N')" for c, kind in sorted(cs))
    return f"""SELECT '{name}' AS table_name, md5('{"|".join(sorted(c for c, _ in cs))}') AS schema_id, md5(concat_ws(chr(31), {cells})) AS h FROM {source}"""


CTES["dg"] = "\n  UNION ALL ".join([
    *[_digested(t, t, cs) for t, cs in _COLUMNS.items()], _digested("labels_copy", "labels", _COLUMNS["labels"]),
    _digested("labels_changed", "(SELECT doc_id, quality, CASE WHEN doc_id % 97 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels)", _COLUMNS["labels"]),
])
CTES["dt"] = """SELECT table_name, schema_id, substr(h, 1, 2) AS node, count(*) AS n_rows, sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT))::HUGEINT AS hi,
  sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT))::HUGEINT AS lo FROM dg GROUP BY ALL"""
CTES["dr"] = "SELECT table_name, schema_id, sum(n_rows)::BIGINT AS n_rows, sum(hi)::HUGEINT AS hi, sum(lo)::HUGEINT AS lo FROM dt GROUP BY ALL"
_ORDER += ["dg", "dt", "dr"]
sql("duplicate_tables", """SELECT table_name, schema_id, n_rows, hi::VARCHAR || '/' || lo::VARCHAR AS content_id,
  string_agg(table_name, '|' ORDER BY table_name) OVER same AS equal_tables, count(*) OVER same AS n_equal FROM dr
  WINDOW same AS (PARTITION BY schema_id, n_rows, hi, lo ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
sql("table_differences", """SELECT l AS left_table, r AS right_table, count(*) AS n_buckets, min(node) AS first_bucket, sum(ln)::BIGINT AS left_rows, sum(rn)::BIGINT AS right_rows
  FROM (SELECT p.l, p.r, b.node, coalesce(x.n_rows, 0) AS ln, coalesce(y.n_rows, 0) AS rn, coalesce(x.hi, 0) AS lh, coalesce(y.hi, 0) AS rh, coalesce(x.lo, 0) AS ll, coalesce(y.lo, 0) AS rl
    FROM (SELECT a.table_name AS l, c.table_name AS r FROM dr a JOIN dr c ON a.schema_id = c.schema_id AND a.table_name < c.table_name) p
    CROSS JOIN (SELECT DISTINCT node FROM dt) b LEFT JOIN dt x ON x.table_name = p.l AND x.node = b.node LEFT JOIN dt y ON y.table_name = p.r AND y.node = b.node)
  WHERE (ln, lh, ll) <> (rn, rh, rl) GROUP BY 1, 2""")
_plain = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' || event_id || ';' || event_type"
sql("scan_quarantine", f"""
  SELECT 'kept' AS reason, count(*) AS n, sum(event_id)::BIGINT AS id_sum, NULL::VARCHAR AS sample FROM events WHERE event_id % 50 > 2
  UNION ALL SELECT 'too few fields', count(*), NULL, min({_plain}) FROM events WHERE event_id % 50 = 0
  UNION ALL SELECT 'too many fields', count(*), NULL, min({_plain} || ';' || user_id || ';more') FROM events WHERE event_id % 50 = 1
  UNION ALL SELECT 'not a bigint: user_id', count(*), NULL, min({_plain} || ';many') FROM events WHERE event_id % 50 = 2""")
sql("sink_event_log_stream", """SELECT event_type AS event, md5(event_type) AS config_fingerprint, CAST(user_id % 5 AS VARCHAR) AS master_seed, count(*) AS n,
  sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1, 2, 3""")
sql("interval_histogram", f"SELECT {d('delta_s', 'delta_s')}, count(*) AS k FROM fd WHERE delta_s IS NOT NULL GROUP BY fd.delta_s ORDER BY k DESC, fd.delta_s LIMIT 4")
sql("table_chronology", "\n UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {stamp(f'min({c})', 'first_ts')}, {stamp(f'max({c})', 'last_ts')}, count(*) AS n_rows FROM {n}"
    for n, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))))
sql("align_labels", """
  WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels)
  SELECT *, n_data = n_labels AS counts_equal, n_duplicate_labels = 0 AS stamps_unique, n_mismatched = 0 AS elementwise_equal, n_data_only + n_labels_only = 0 AS sets_equal
  FROM (SELECT count(a.doc_id) AS n_data, count(b.doc_id) AS n_labels, count(*) FILTER (WHERE a.doc_id IS DISTINCT FROM b.doc_id) AS n_mismatched,
      min(coalesce(a.i, b.i)) FILTER (WHERE a.doc_id IS DISTINCT FROM b.doc_id) AS first_mismatch FROM a FULL JOIN b ON a.i = b.i),
    (SELECT count(*) AS n_data_only FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)),
    (SELECT count(*) AS n_labels_only FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)),
    (SELECT count(*) - count(DISTINCT doc_id) AS n_duplicate_labels FROM labels)""")
sql("stamp_set_diff", """SELECT *, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
  UNION ALL SELECT *, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
sql("schema_diff", """SELECT 'text|lang|source|n_chars' AS missing, 'quality|toxic' AS extra, false AS reordered,
  (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM labels) AS n_right""")
sql("class_distribution", f"""
  SELECT lang, label, n, {d('n / sum(n) OVER (PARTITION BY lang)', 'rate')}, count(label) OVER (PARTITION BY lang) AS n_classes, count(label) OVER (PARTITION BY lang) >= 2 AS usable
  FROM (SELECT lang, quality AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)""")
sql("positive_runs", f"""SELECT series_id, role, {n_if('y = 1 AND coalesce(before, 0) <> 1', 'n_runs')}, {n_if('y = 1', 'n_positive')}
  FROM (SELECT *, lag(y) OVER ({WIN}) AS before FROM o) GROUP BY 1, 2""")
sql("ts_resolution", "\n UNION ALL ".join(f"""
  SELECT *, CASE WHEN with_seconds > 0 THEN 'second' WHEN with_minutes > 0 THEN 'minute' WHEN with_hours > 0 THEN 'hour' ELSE 'day' END AS resolution, '{n}' AS table_name
  FROM (SELECT count(*) FILTER (WHERE epoch_us({c}) % 60000000 <> 0) AS with_seconds, count(*) FILTER (WHERE minute({c}) <> 0) AS with_minutes,
    count(*) FILTER (WHERE hour({c}) <> 0) AS with_hours, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM {n})""" for n, c in (("events", "ts"), ("lineitem", "l_shipdate"))))
sql("assert_causal", f"""SELECT {stamp("max(ts) FILTER (WHERE role = 'baseline_train')", 'baseline_end')}, {stamp("min(ts) FILTER (WHERE role = 'inference')", 'inference_start')}, true AS is_causal FROM t""")
sql("pool_baselines", f"SELECT count(*) AS n, {d('avg(value)', 'mean_value')}, {d('stddev_pop(k)', 'std_k')} FROM t WHERE role <> 'inference'")

# ---- scalars -------------------------------------------------------------------------------------------------
_id = "series_id, row_idx"
sql("confidence", f"SELECT {_id}, {d(CONF('p1'), 'confidence')} FROM sc")
sql("zero_one_loss", f"SELECT {_id}, {d('CASE WHEN edge_pred <> y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'loss')} FROM sc")
sql("quality_score", f"""SELECT event_id, {d('((amount IS NOT NULL)::INT + (value < 100)::INT + CASE WHEN state > 0 THEN (k > 10)::INT ELSE 1 END) / 3.0::DOUBLE', 'quality')},
  {d('CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE least(1.0, amount / 50.0) END', 'scalar')} FROM t""")
sql("harmonic_reliability", f"""SELECT event_id, {d('1.0 / ((0.4::DOUBLE / 1.2) / (k / 100.0 + 1e-8) + (0.25::DOUBLE / 1.2) / (1.0 - least(value / 300.0, 1.0) + 1e-8) + (0.3::DOUBLE / 1.2) / (1.0 - state / 4.0 + 1e-8) + (0.25::DOUBLE / 1.2) / (0.9 + 1e-8))', 'reliability')} FROM t""")
sql("reliability_defaults", f"""SELECT event_id, {d('CASE WHEN amount IS NULL THEN 0.5::DOUBLE ELSE least(1.0, amount / 100.0) END', 'confidence')},
  {d('CASE WHEN state = 1 THEN least(1.0, k / 50.0) ELSE 0.0::DOUBLE END', 'drift')} FROM t""")
sql("raw_severity", f"""SELECT {_id}, {d('least(1.0, abs(signal - 0.6) / 0.4)', 'relative')}, {d('least(1.0, abs(signal - 0.6))', 'relative_unit')},
  {d('1.0 - exp(-2.0 * abs(signal - 0.6))', 'exponential')} FROM sc""")
sql("monitored_signal", f"""SELECT {_id}, {d('p1', 'prediction_probability')}, {d('2.0 * (1.0 - greatest(p1, 1.0 - p1))', 'uncertainty')},
  {d('CASE WHEN p1 >= 1.0 - p1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'predicted_class')}, {d('CASE WHEN edge_pred <> y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'prediction_error')} FROM sc""")
sql("winsorized_l1", f"SELECT event_id, {d(SIGNAL, 'wide')}, {d('(least(abs(z_value), 1.0) + least(abs(z_k), 1.0)) / 2.0', 'tight')} FROM n")
sql("probability_normalise", f"""SELECT event_id, {d('CASE WHEN k * state + state * 10 > 0 THEN k * state / (k * state + state * 10) ELSE 1.0::DOUBLE END', 'p0')},
  {d('CASE WHEN k * state + state * 10 > 0 THEN state * 10.0::DOUBLE / (k * state + state * 10) ELSE 0.0::DOUBLE END', 'p1')} FROM t""")

# ---- severity, error, persistence, routing ----------------------------------------------------------------------
sql("severity_ema", f"SELECT {_id}, {d('raw_severity', 'raw_severity')}, {d('s', 'smoothed_severity')} FROM sg JOIN sev USING (series_id, row_idx)")
sql("error_ema", f"SELECT {_id}, {d('e', 'error_ema')} FROM err")
CTES["sl"] = "SELECT series_id, row_idx, CASE WHEN event_type = 'purchase' THEN k / 99.0 END AS loss FROM sc"
_ORDER.append("sl")
CTES["se"] = """
  SELECT series_id, -1::BIGINT AS row_idx, 0.25::DOUBLE AS e FROM sl WHERE row_idx = 0
  UNION ALL
  SELECT l.series_id, l.row_idx, CASE WHEN l.loss IS NULL THEN p.e ELSE 0.9::DOUBLE * p.e + 0.1::DOUBLE * l.loss END
  FROM se p JOIN sl l ON l.series_id = p.series_id AND l.row_idx = p.row_idx + 1"""
_ORDER.append("se")
sql("error_ema_sparse", f"SELECT {_id}, {d('e', 'error_ema')} FROM se WHERE row_idx >= 0")
_al = lambda w: f"count(*) FILTER (WHERE alarm) OVER ({SER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
sql("persistence_consecutive", f"SELECT {_id}, alarm, {_al(3)} = 3 AS is_persistent FROM alarmed")
sql("persistence_windowed", f"""SELECT {_id}, {_al(20)} AS alarms_in_window, {_al(20)} >= 8 AS is_persistent, count(*) FILTER (WHERE alarm) OVER ({SER}) AS total_alarms,
  {d(f'count(*) FILTER (WHERE alarm) OVER ({SER}) / (row_idx + 1)', 'alarm_rate')} FROM alarmed""")
sql("severity_history", f"""SELECT series_id, count(*) AS total_updates, {n_if('alarm', 'total_alarms')}, {d('max(raw_severity)', 'max_raw_severity')},
  {d('max_by(smoothed_severity, row_idx)', 'last_smoothed_severity')} FROM alarmed GROUP BY 1""")
sql("alerts", f"""SELECT a.series_id, a.row_idx, concat_ws('|', CASE WHEN reliability < 0.5 THEN 'reliability_degraded' END,
    CASE WHEN alarm OR smoothed_severity > 0.35 THEN 'drift_active' END, CASE WHEN NOT success THEN 'execution_failure_detected' END,
    CASE WHEN cloud_fallback THEN 'cloud_fallback_active' END, CASE WHEN packet_lost THEN 'packet_loss' END) AS alerts
  FROM alarmed a JOIN lg ON lg.series_id = a.series_id AND lg.row_idx = a.row_idx""")
CTES["ht"] = """
  SELECT series_id, -1::BIGINT AS row_idx, 'EDGE' AS action, 'EDGE' AS previous_action, 0.0::DOUBLE AS r FROM rel WHERE row_idx = 0
  UNION ALL
  SELECT g.series_id, g.row_idx, CASE p.action
      WHEN 'EDGE' THEN CASE WHEN g.reliability >= 0.4 THEN 'EDGE' WHEN g.reliability >= 0.2 THEN 'HYBRID' ELSE 'CLOUD' END
      WHEN 'HYBRID' THEN CASE WHEN g.reliability >= 0.5 THEN 'EDGE' WHEN g.reliability < 0.2 THEN 'CLOUD' ELSE 'HYBRID' END
      ELSE CASE WHEN g.reliability >= 0.5 THEN 'EDGE' ELSE 'CLOUD' END END, p.action, g.reliability
  FROM ht p JOIN rel g ON g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
_ORDER.append("ht")
_sw = f"count(*) FILTER (WHERE action <> previous_action) OVER ({SER}) AS switch_count"
sql("route_hysteresis", f"""SELECT {_id}, action, previous_action, printf('R_t (%.4f)', r) || CASE previous_action || action
    WHEN 'EDGEEDGE' THEN ' >= cloud_threshold (0.40); maintain EDGE' WHEN 'EDGEHYBRID' THEN ' in hybrid zone [0.20, 0.40); transition EDGE -> HYBRID'
    WHEN 'EDGECLOUD' THEN ' < critical_cloud_threshold (0.20); transition EDGE -> CLOUD' WHEN 'HYBRIDEDGE' THEN ' >= edge_return_threshold (0.50); recover HYBRID -> EDGE'
    WHEN 'HYBRIDCLOUD' THEN ' < critical_cloud_threshold (0.20); degrade HYBRID -> CLOUD' WHEN 'HYBRIDHYBRID' THEN ' in hysteresis/hybrid zone; maintain HYBRID'
    WHEN 'CLOUDEDGE' THEN ' >= edge_return_threshold (0.50); recover CLOUD -> EDGE' ELSE ' < edge_return_threshold (0.50); maintain CLOUD' END AS reason, {_sw}
  FROM ht WHERE row_idx >= 0""")
CTES["h2"] = """
  SELECT series_id, -1::BIGINT AS row_idx, 'HYBRID' AS action, 'HYBRID' AS previous_action FROM rel WHERE row_idx = 0
  UNION ALL
  SELECT g.series_id, g.row_idx, CASE WHEN g.reliability >= 0.5 THEN 'EDGE' WHEN p.action = 'EDGE' AND g.reliability >= 0.4 THEN 'EDGE' ELSE 'CLOUD' END, p.action
  FROM h2 p JOIN rel g ON g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
_ORDER.append("h2")
sql("route_two_state", f"SELECT {_id}, action, {_sw} FROM h2 WHERE row_idx >= 0")
sql("route_static", f"""SELECT {_id}, 'EDGE' AS edge_only, 'CLOUD' AS cloud_only, 'HYBRID' AS static_hybrid, CASE WHEN row_idx % 2 = 0 THEN 'EDGE' ELSE 'CLOUD' END AS round_robin,
  CASE WHEN (row_idx * 0.25) % 1.0 < 0.25 THEN 'EDGE' ELSE 'CLOUD' END AS fixed_ratio FROM o WHERE role = 'inference'""")
sql("two_tier_score", f"""
  SELECT {_id}, {d('CASE WHEN c THEN cloud_p1 ELSE p1 END', 'p1')}, CASE WHEN c THEN cloud_pred ELSE edge_pred END AS prediction,
    CASE WHEN action = 'EDGE' THEN 'edge' WHEN action = 'CLOUD' THEN 'cloud' WHEN c THEN 'hybrid_cloud' ELSE 'hybrid_edge' END AS model_used,
    action = 'HYBRID' AND c AS cloud_fallback, CASE WHEN action = 'HYBRID' AND c THEN 'FALLBACK' ELSE 'SUCCESS' END AS execution_status
  FROM (SELECT rel.*, ht.action, ht.action = 'CLOUD' OR (ht.action = 'HYBRID' AND confidence < 0.6) AS c FROM rel JOIN ht USING (series_id, row_idx))""")

# ---- runs and evaluation tables ------------------------------------------------------------------------------------
sql("experiment_grid", f"""SELECT method, seed, count(*) AS n_rows, {n_if('row_idx >= onset', 'n_post')}, {d('avg(signal)', 'mean_signal')}, {d('avg(smoothed_severity)', 'mean_severity')} FROM sm GROUP BY 1, 2""")
# The sweep: offsets of several strengths on one or two channels, same loop.
CTES["vx"] = f"""
  SELECT magnitude, breadth, inf.*, CASE WHEN row_idx >= round_even(0.5 * n_stream, 0) THEN magnitude ELSE 0.0::DOUBLE END AS schedule
  FROM inf CROSS JOIN (SELECT unnest([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0])::DOUBLE AS magnitude) CROSS JOIN (SELECT unnest([1, 2]) AS breadth)"""
_far = lambda c: held(c, f"{c} + schedule * {c}__std").replace("* 1.5 / 2.0", "* 4.0 / 2.0")
CTES["vz"] = f"""
  SELECT magnitude, breadth, series_id, row_idx, y, n_stream, ({_far('value')} - value__mean) / value__std AS z_value,
    (CASE WHEN breadth = 2 THEN {_far('k')} ELSE k END - k__mean) / k__std AS z_k FROM vx"""
CTES["vp"] = f"""
  SELECT magnitude, breadth, series_id, row_idx, y AS label, n_stream, 'adaptive' AS policy, least(1.0, abs({SIGNAL} - baseline_mean)) AS raw_severity,
    {CONF(EDGE_P1)} AS confidence, CASE WHEN {EDGE_P1} >= 0.5 THEN 1 ELSE 0 END AS edge_pred, CASE WHEN {CLOUD_P1} >= 0.5 THEN 1 ELSE 0 END AS cloud_pred
  FROM vz CROSS JOIN bm"""
CTES["vq"] = """
  SELECT magnitude, breadth, series_id, row_idx, raw_severity AS s FROM vp WHERE row_idx = 0
  UNION ALL
  SELECT g.magnitude, g.breadth, g.series_id, g.row_idx, 0.8::DOUBLE * p.s + 0.2::DOUBLE * g.raw_severity
  FROM vq p JOIN vp g ON g.magnitude = p.magnitude AND g.breadth = p.breadth AND g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
CTES["vm"] = "SELECT vp.*, vq.s AS drift FROM vp JOIN vq USING (magnitude, breadth, series_id, row_idx)"
CTES["vl"] = closed_loop("vl", "vm", ("magnitude", "breadth", "series_id"))
_ORDER += ["vx", "vz", "vp", "vq", "vm", "vl"]
_vs = lambda a: d(f"count(*) FILTER (WHERE action = '{a.upper()}') * 100.0::DOUBLE / count(*)", f"{a}_percentage")
sql("drift_sweep", f"""SELECT magnitude, breadth, {d('min(reliability)', 'min_reliability')}, {d('avg(reliability) FILTER (WHERE row_idx >= round_even(0.5 * n_stream, 0))', 'mean_reliability_post_drift')},
  {_vs('edge')}, {_vs('hybrid')}, {_vs('cloud')}, count(*) FILTER (WHERE action <> was) AS switch_count, count(*) FILTER (WHERE cloud_fallback) AS hybrid_fallback_count
  FROM (SELECT vl.*, n_stream, lag(action) OVER (PARTITION BY magnitude, breadth, series_id ORDER BY row_idx) AS was
    FROM vl JOIN vm USING (magnitude, breadth, series_id, row_idx)) GROUP BY magnitude, breadth""")
sql("closed_loop_trace", f"SELECT method, seed, {_id}, {d('error_ema', 'error_ema')}, {d('reliability', 'reliability')}, action, prediction, cloud_fallback FROM lp WHERE row_idx >= 0")
CTES["cm"] = f"SELECT method, seed, {matrix('label', 'prediction')} FROM ru GROUP BY 1, 2"
_ORDER.append("cm")
_scores = macro("tp", "fp", "fn", "tn")
_show = ", ".join(d(x, s) for s, x in _scores.items())
sql("classification_metrics", f"SELECT method, seed, {_show}, tp + fp + fn + tn AS sample_count, tp, fp, fn, tn FROM cm")
sql("pre_post_metrics", "SELECT method, seed, pre_samples, post_samples, " + ", ".join(
    ", ".join([d(f"pre_{s}", f"pre_{s}"), d(f"post_{s}", f"post_{s}"), d(f"post_{s} - pre_{s}", f"delta_{s}"),
               d(f"CASE WHEN abs(pre_{s}) > 1e-9 THEN (post_{s} - pre_{s}) / pre_{s} * 100.0 ELSE 0.0::DOUBLE END", f"pct_change_{s}")]) for s in _scores) + " FROM pq")
CTES["ap"] = f"SELECT *, {_al(20)} >= 8 AS per, {_al(3)} = 3 AS per3 FROM alarmed"
_ORDER.append("ap")
sql("drift_metrics", f"""
  SELECT series_id, CAST(100 AS BIGINT) AS drift_onset, first_detection_point, first_detection_point - 100 AS detection_delay,
    CASE WHEN first_detection_point IS NOT NULL THEN 'DETECTED' ELSE 'NOT DETECTED' END AS detection_status,
    total_alarms, false_alarms_pre_drift, post_drift_alarms, transient_alarms, persistent_events, mean_severity, max_severity, post_drift_mean_severity
  FROM (SELECT series_id, min(row_idx) FILTER (WHERE alarm AND row_idx >= 100) AS first_detection_point, {n_if('alarm', 'total_alarms')},
    {n_if('alarm AND row_idx < 100', 'false_alarms_pre_drift')}, {n_if('alarm AND row_idx >= 100', 'post_drift_alarms')}, {n_if('alarm AND NOT per', 'transient_alarms')}, {n_if('per', 'persistent_events')},
    {d('avg(smoothed_severity)', 'mean_severity')}, {d('max(smoothed_severity)', 'max_severity')}, {d('coalesce(avg(smoothed_severity) FILTER (WHERE row_idx >= 100), 0.0)', 'post_drift_mean_severity')}
    FROM ap GROUP BY 1)""")
sql("drift_metrics_control", f"""SELECT series_id, min(row_idx) FILTER (WHERE alarm) AS first_detection_point, 'NO_DRIFT' AS detection_status, {n_if('alarm', 'total_alarms')},
  {n_if('alarm', 'false_alarms_pre_drift')}, {n_if('alarm AND NOT per3', 'transient_alarms')}, {n_if('per3', 'persistent_events')},
  {d('avg(smoothed_severity)', 'mean_severity')}, {d('max(smoothed_severity)', 'max_severity')} FROM ap GROUP BY 1""")
_pre_r, _post_r = "coalesce(avg(reliability) FILTER (WHERE row_idx < onset), 0.0)", "coalesce(avg(reliability) FILTER (WHERE row_idx >= onset), 0.0)"
sql("reliability_metrics", f"""SELECT method, seed, {d(_pre_r, 'mean_reliability_pre_drift')}, {d(_post_r, 'mean_reliability_post_drift')}, {d('min(reliability)', 'min_reliability')},
  {d('max(reliability)', 'max_reliability')}, {d(f'{_post_r} - {_pre_r}', 'delta_reliability')} FROM ru GROUP BY 1, 2""")
_rate = "CASE WHEN hybrid_count > 0 THEN hybrid_fallback_count * 100.0::DOUBLE / hybrid_count ELSE 0.0::DOUBLE END"
_obs = "CASE WHEN hybrid_count > 0 THEN 'OBSERVED' ELSE 'NOT OBSERVED' END AS hybrid_status"
_pct = lambda a: f"{a}_count * 100.0::DOUBLE / total_decisions"
sql("routing_metrics", f"""SELECT *, {d(_pct('edge'), 'edge_percentage')}, {d(_pct('cloud'), 'cloud_percentage')}, {d(_pct('hybrid'), 'hybrid_percentage')}, {d(_pct('cloud'), 'offloading_ratio')},
  hybrid_count - hybrid_fallback_count AS edge_completed_hybrid_count, {d(_rate, 'hybrid_fallback_rate')}, {_obs} FROM rt""")
sql("hybrid_metrics", f"""SELECT method, seed, hybrid_count, hybrid_count - hybrid_fallback_count AS edge_completed_hybrid, hybrid_fallback_count AS cloud_fallback_count,
  {d(_rate, 'hybrid_fallback_rate')}, {_obs} FROM rt""")


def _lat(x: str, zero: bool = True, ms_only: bool = False) -> str:
    stats = {"mean": f"avg({x})", "median": f"quantile_cont({x}, 0.5)", "p95": f"quantile_cont({x}, 0.95)", "max": f"max({x})"}
    fix = lambda e: f"coalesce({e}, 0.0::DOUBLE)" if zero else e
    cols = [d(f"{fix(e)} * 1000.0", f"{n}_ms") for n, e in stats.items()]
    if not ms_only:
        cols += [d(fix(e), f"{n}_s") for n, e in stats.items()] + [f"count({x}) AS count"]
    return ", ".join(cols)


sql("latency_summary", f"SELECT selected_action, {_lat('cloud_latency_s')} FROM lg GROUP BY 1")
sql("latency_total", f"SELECT {_lat('total_latency_s')} FROM lg")
sql("latency_by_run", f"SELECT method, seed, {_lat('latency_s')} FROM rl GROUP BY 1, 2")
sql("execution_reliability", f"""SELECT selected_action, seed, count(*) AS total_executions, {n_if('success', 'successful_executions')}, {n_if('NOT success', 'failed_executions')},
  {n_if("NOT success AND model_used = 'edge'", 'edge_failures')}, {n_if("NOT success AND model_used LIKE '%cloud%'", 'cloud_failures')}, {n_if('packet_lost', 'packet_loss_failures')},
  {n_if('NOT success AND cloud_fallback', 'fallback_failures')}, {d('avg(success::INT)', 'success_rate')}, {d('avg((NOT success)::INT)', 'failure_rate')} FROM lg GROUP BY 1, 2""")
sql("delivery_metrics", f"""SELECT * FROM (SELECT seed, count(*) AS total_transmissions, {n_if('success', 'delivered_transmissions')}, {n_if('NOT success', 'failed_transmissions')}, {n_if('packet_lost', 'packet_loss_count')},
  {d('avg(success::INT)', 'delivery_rate')}, {d('avg((NOT success)::INT)', 'failure_rate')}, {d('avg(packet_lost::INT)', 'packet_loss_rate')} FROM lg WHERE network_latency_s IS NOT NULL GROUP BY 1)
  JOIN (SELECT seed, {_lat('network_latency_s', False, True)} FROM lg WHERE network_latency_s IS NOT NULL AND success GROUP BY 1) USING (seed)""")
sql("ablation_rollup", f"""SELECT method, {d('any_value(f)', 'post_drift_macro_f1')}, {d('avg(cloud_count * 100.0::DOUBLE / total_decisions)', 'cloud_offloading_percentage')}, {d('any_value(l)', 'mean_latency_ms')},
    CASE WHEN method LIKE 'ADAPTIVE%' THEN 'YES' ELSE 'NO' END AS drift_signal_used, CASE WHEN method = 'ADAPTIVE_RETRAINED' THEN 'YES' ELSE 'NO' END AS adaptation_used
  FROM rt JOIN (SELECT method, avg(post_f1) AS f FROM pq GROUP BY 1) USING (method)
  JOIN (SELECT method, avg(m) AS l FROM (SELECT method, seed, avg(latency_s) * 1000.0 AS m FROM rl GROUP BY 1, 2) GROUP BY 1) USING (method) GROUP BY method""")
# Fixed value: Student-t quantile 0.975 for 4 degrees of freedom (five seeds).
_T = "2.7764451051977987::DOUBLE"
_ci = lambda x, sign: f"CASE WHEN stddev_samp({x}) < 1e-12 THEN avg({x}) ELSE avg({x}) {sign} {_T} * stddev_samp({x}) / sqrt(count(*)) END"
sql("confidence_interval", f"""SELECT method, count(*) AS n, {d('avg(post_accuracy)', 'mean')}, {d('CASE WHEN stddev_samp(post_accuracy) < 1e-12 THEN 0.0::DOUBLE ELSE stddev_samp(post_accuracy) END', 'std')},
  {d(_ci('post_accuracy', '-'), 'ci_lower')}, {d(_ci('post_accuracy', '+'), 'ci_upper')} FROM pq GROUP BY 1""")
CTES["pr"] = "\n UNION ALL ".join(f"""SELECT '{a} vs {b}' AS comparison, seed, x.post_f1 AS first_value, y.post_f1 AS second_value, x.post_f1 - y.post_f1 AS difference
  FROM pq x JOIN pq y USING (seed) WHERE x.method = '{a}' AND y.method = '{b}'""" for a, b in (("ADAPTIVE", "STATIC"), ("ADAPTIVE", "NO_DRIFT_SIGNAL"), ("STATIC", "EDGE_ONLY"), ("ADAPTIVE_RETRAINED", "ADAPTIVE")))
_ORDER.append("pr")
sql("paired_by_seed", f"SELECT seed, {d('first_value', 'first_value')}, {d('second_value', 'second_value')}, {d('difference', 'difference')} FROM pr WHERE comparison = 'ADAPTIVE vs STATIC'")
CTES["ps"] = """SELECT comparison, count(*) AS n_replicates, avg(first_value) AS m1, avg(second_value) AS m2, avg(difference) AS md, stddev_samp(difference) AS sd,
  max(difference) - min(difference) > 1e-12 + 1e-5 * abs(avg(difference)) AS tested FROM pr GROUP BY 1"""
_ORDER.append("ps")
# Two-sided p of Student's t with 4 degrees of freedom in closed form.
_t = "(md / (sd / sqrt(n_replicates)))"
_u = f"(abs({_t}) / sqrt(4.0 + {_t} * {_t}))"
sql("paired_test", f"""SELECT comparison, n_replicates, CASE WHEN tested THEN 'Paired t-test' ELSE 'Exact zero-variance paired difference' END AS test_name,
  {d(f'CASE WHEN tested THEN {_t} ELSE 0.0::DOUBLE END', 'statistic')}, {d(f'CASE WHEN tested THEN 1.0 - {_u} * (1.0 + 0.5 * (1.0 - {_u} * {_u})) ELSE 1.0::DOUBLE END', 'p_value')},
  {d('m1', 'm1_mean')}, {d('m2', 'm2_mean')}, {d('md', 'mean_difference')}, {d(f'CASE WHEN sd < 1e-12 THEN md ELSE md - {_T} * sd / sqrt(n_replicates) END', 'diff_ci_95_lower')},
  {d(f'CASE WHEN sd < 1e-12 THEN md ELSE md + {_T} * sd / sqrt(n_replicates) END', 'diff_ci_95_upper')} FROM ps""")
sql("run_consistency", f"""SELECT count(*) AS n_runs, count(DISTINCT (method, seed)) AS n_method_seed,
  {' + '.join(f"count(*) FILTER (WHERE NOT ({c} BETWEEN 0 AND 1))" for c in ('pre_accuracy', 'post_accuracy', 'pre_f1', 'post_f1'))} AS n_out_of_bounds,
  count(*) FILTER (WHERE isnan(post_mcc) OR isinf(post_mcc)) AS n_not_finite, count(*) FILTER (WHERE edge_count + cloud_count + hybrid_count <> total_decisions) AS n_bad_share_sum
  FROM pq JOIN rt USING (method, seed)""")
# ---- monitoring ----------------------------------------------------------------------------------------------------
_inc = "(cloud_fallback OR model_used LIKE '%cloud%' OR coalesce(error LIKE '%cloud%', false))"
sql("telemetry_summary", f"""SELECT series_id, count(*) AS total_decisions, {n_if('success', 'successful_executions')}, {n_if('NOT success', 'failed_executions')},
  {n_if("selected_action = 'EDGE'", 'edge_count')}, {n_if("selected_action = 'CLOUD'", 'cloud_count')}, {n_if("selected_action = 'HYBRID'", 'hybrid_count')}, {n_if('cloud_fallback', 'hybrid_fallback_count')},
  {n_if(f"NOT success AND (selected_action = 'EDGE' OR (selected_action = 'HYBRID' AND NOT {_inc}))", 'edge_failure_count')},
  {n_if(f"NOT success AND (selected_action = 'CLOUD' OR (selected_action = 'HYBRID' AND {_inc}))", 'cloud_failure_count')},
  {d('sum(total_latency_s)', 'total_latency_s')}, {d('avg(total_latency_s)', 'mean_latency_s')}, {d('min(total_latency_s)', 'min_latency_s')}, {d('max(total_latency_s)', 'max_latency_s')} FROM lg GROUP BY 1""")
_mst = lambda c, n: f"count({c}) AS {n}_count, {d(f'avg({c})', f'{n}_mean')}, {d(f'min({c})', f'{n}_min')}, {d(f'max({c})', f'{n}_max')}, {d(f'max_by({c}, row_idx) FILTER (WHERE {c} IS NOT NULL)', f'{n}_current')}"
sql("monitoring_snapshot", f"""
  SELECT *, {', '.join(d(f'n_{a} * 100.0::DOUBLE / total_observations', f'{a}_share') for a in ('edge', 'cloud', 'hybrid'))},
    {d('CASE WHEN n_hybrid > 0 THEN hybrid_fallbacks::DOUBLE / n_hybrid ELSE 0.0::DOUBLE END', 'hybrid_fallback_rate')}, {d('n_successful::DOUBLE / total_observations', 'success_rate')},
    concat_ws('|', CASE WHEN reliability_current < 0.5 THEN 'reliability_degraded' END, CASE WHEN current_drift_detected OR current_is_persistent THEN 'drift_active' END,
      CASE WHEN n_failed > 0 THEN 'execution_failures_recorded' END) AS active_alerts
  FROM (SELECT series_id, count(*) AS total_observations, max_by(selected_action, row_idx) AS current_selected_action, max_by(alarm, row_idx) AS current_drift_detected,
      max_by(per, row_idx) AS current_is_persistent, {d('max_by(raw_severity, row_idx)', 'current_raw_severity')}, {n_if("selected_action = 'EDGE'", 'n_edge')}, {n_if("selected_action = 'CLOUD'", 'n_cloud')},
      {n_if("selected_action = 'HYBRID'", 'n_hybrid')}, {n_if('selected_action <> was', 'n_switches')}, {n_if("selected_action = 'HYBRID' AND cloud_fallback", 'hybrid_fallbacks')},
      {n_if("selected_action = 'HYBRID' AND success", 'hybrid_successes')}, {n_if('success', 'n_successful')}, {n_if('NOT success', 'n_failed')},
      {n_if("selected_action = 'EDGE' AND NOT success", 'edge_failures')}, {n_if("selected_action = 'CLOUD' AND NOT success", 'cloud_failures')},
      {_mst('edge_latency_s', 'edge_latency')}, {_mst('cloud_latency_s', 'cloud_latency')}, {_mst('smoothed_severity', 'severity')}, {_mst('reliability', 'reliability')}
    FROM (SELECT lg.*, ap.alarm, ap.per, ap.raw_severity, ap.smoothed_severity, ap.reliability, lag(selected_action) OVER (PARTITION BY lg.series_id ORDER BY lg.row_idx) AS was
      FROM lg JOIN ap ON ap.series_id = lg.series_id AND ap.row_idx = lg.row_idx) GROUP BY series_id)""")
sql("model_health", f"""
  SELECT series_id, model_id, count(*) AS total_executions, {n_if('ok', 'successful_executions')}, {n_if('NOT ok', 'failed_executions')},
    {d('max_by(lat, row_idx) FILTER (WHERE lat IS NOT NULL)', 'last_latency_s')}, max_by(status, row_idx) AS last_execution_status,
    max_by(problem, row_idx) FILTER (WHERE problem IS NOT NULL) AS last_error
  FROM (SELECT series_id, row_idx, 'edge' AS model_id, success OR selected_action = 'HYBRID' AS ok, edge_latency_s AS lat,
      CASE WHEN selected_action = 'HYBRID' THEN 'SUCCESS' ELSE execution_status END AS status, CASE WHEN selected_action = 'EDGE' AND NOT success THEN coalesce(error, 'Execution failure') END AS problem
    FROM lg WHERE selected_action <> 'CLOUD'
    UNION ALL SELECT series_id, row_idx, 'cloud', success, cloud_latency_s, execution_status, CASE WHEN NOT success THEN coalesce(error, 'Execution failure') END FROM lg WHERE in_cloud)
  GROUP BY 1, 2""")

# ---- feedback and adaptation ------------------------------------------------------------------------------------------
sql("delayed_feedback", f"SELECT {_id}, edge_pred, label, arrival_index, is_labeled, causal FROM fb")
sql("eligible_feedback", f"SELECT {_id}, label, arrival_index FROM el")
sql("eligible_count_asof", f"SELECT {_id}, n_eligible FROM ec")
sql("adaptation_triggers", """
  SELECT series_id, row_idx, fired, CASE WHEN fired THEN 'ELIGIBLE' WHEN cooling THEN 'COOLDOWN' ELSE 'IDLE' END AS state,
    CASE WHEN fired THEN 'eligible' WHEN cooling THEN 'cooldown:' || (50 - since) WHEN raw_severity <= 0.3 THEN 'not_persistent' WHEN smoothed_severity < 0.35 THEN 'low_severity' ELSE 'few_samples' END AS reason
  FROM (SELECT *, NOT fired AND coalesce(since < 50, false) AS cooling FROM (
    SELECT ec.*, f.place IS NOT NULL AS fired, ec.row_idx - last_value(f.place IGNORE NULLS) OVER (PARTITION BY ec.series_id ORDER BY ec.row_idx) AS since
    FROM ec LEFT JOIN f50 f ON f.series_id = ec.series_id AND f.place = ec.row_idx))""")
sql("version_audit", """SELECT series_id, attempt, row_idx, 'v' || (done - ok::INT + 2) AS version, 'v' || (done - ok::INT + 1) AS parent_version, 'v' || (done + 1) AS active_version,
  CASE WHEN ok THEN 'ACTIVE' ELSE 'REJECTED' END AS status FROM va""")
sql("version_rollup", f"SELECT series_id, 'v' || (max(done) + 1) AS active_version, count(*) AS n_attempts, {n_if('ok', 'version_update_count')} FROM va GROUP BY 1")
sql("adaptation_rollup", """SELECT s.series_id, count(atm.attempt) AS adaptation_events_count, CASE WHEN count(atm.attempt) > 0 THEN 'TRIGGERED' ELSE 'NOT TRIGGERED' END AS adaptation_status
  FROM (SELECT DISTINCT series_id FROM rel) s LEFT JOIN atm ON atm.series_id = s.series_id GROUP BY 1""")
sql("stratified_sample", "SELECT event_id, y FROM smp")
CTES["cg"] = f"""SELECT series_id, {matrix('y', '(z_k > 0.8)::INT', 'c_')}, {matrix('y', '(z_value > 0.5)::INT', 'a_')}, count(*) AS validation_samples FROM n WHERE role = 'baseline_validation' GROUP BY 1"""
_ORDER.append("cg")
_cand, _act = macro("c_tp", "c_fp", "c_fn", "c_tn")["f1"], macro("a_tp", "a_fp", "a_fn", "a_tn")["f1"]
sql("candidate_gate", f"""SELECT series_id, {d('c', 'candidate_metric')}, {d('a', 'active_metric')}, {d('c - a', 'metric_delta')}, validation_samples,
  CASE WHEN c < 0.45 THEN 'below_minimum' WHEN c < a - 0.05 THEN 'regression' ELSE 'accepted' END AS reason, CASE WHEN c >= 0.45 AND c >= a - 0.05 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status
  FROM (SELECT series_id, validation_samples, {_cand} AS c, {_act} AS a FROM cg)""")

# ---- models ----------------------------------------------------------------------------------------------------------
sql("edge_model_fit", "SELECT label, n, " + ", ".join(f"{d(f'{c}__sum', f'{c}__sum')}, {d(f'{c}__sq', f'{c}__sq')}" for c in ("z_value", "z_k", "state")) + " FROM nb")
sql("edge_model", f"SELECT event_id, {d('p1', 'p1')} FROM nbs")
CTES["mc"] = f"""SELECT model, {matrix('y', 'p')} FROM (SELECT 'edge' AS model, y, (p1 >= 0.5)::INT AS p FROM nbs
  UNION ALL SELECT 'cloud', y, ({CLOUD_P1} >= 0.5)::INT FROM nbs) GROUP BY 1"""
_ORDER.append("mc")
sql("model_comparison", f"SELECT model, {_show}, tp + fp + fn + tn AS sample_count, tp, fp, fn, tn FROM mc")
sql("causal_fit_data", f"SELECT y, state, count(*) AS n, {d('avg(z_value)', 'mean_z')} FROM n WHERE role = 'baseline_train' GROUP BY 1, 2")
CTES["fs"] = """
  SELECT series_id, -1::BIGINT AS row_idx, 'EDGE' AS action, 'EDGE' AS previous_action FROM rel WHERE row_idx = 0
  UNION ALL
  SELECT g.series_id, g.row_idx, CASE WHEN g.reliability >= 0.7 THEN 'EDGE' WHEN g.reliability < 0.3 THEN 'CLOUD'
    WHEN g.reliability < 0.5 AND p.action = 'EDGE' THEN 'HYBRID' ELSE p.action END, p.action
  FROM fs p JOIN rel g ON g.series_id = p.series_id AND g.row_idx = p.row_idx + 1"""
_ORDER.append("fs")
sql("flagship", f"""SELECT series_id, count(*) AS total_decisions, {n_if("action = 'EDGE'", 'edge_count')}, {n_if("action = 'CLOUD'", 'cloud_count')}, {n_if("action = 'HYBRID'", 'hybrid_count')},
  {d("count(*) FILTER (WHERE action = 'CLOUD') * 100.0::DOUBLE / count(*)", 'offloading_ratio')}, count(*) FILTER (WHERE row_idx > 0 AND action <> previous_action) AS switch_count,
  {d('avg(reliability)', 'mean_reliability')}, {d('max(smoothed_severity)', 'max_severity')} FROM fs JOIN rel USING (series_id, row_idx) GROUP BY 1""")

_bin = lambda c: f"CAST(least(greatest(floor(({c} + 4.0::DOUBLE) / 0.25::DOUBLE), 0), 31) AS INTEGER)"
_impure = lambda k, n: f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {k} / {n} * (1.0::DOUBLE - {k}::DOUBLE / {n}) END"
CTES["tb"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_bin(c)} AS bin, count(*) AS k, sum(y) AS k1 FROM n WHERE role = 'baseline_train' GROUP BY 2" for c in ("z_value", "z_k"))
CTES["tcum"] = """SELECT feature, bin, sum(k) OVER (PARTITION BY feature ORDER BY bin) AS l, sum(k1) OVER (PARTITION BY feature ORDER BY bin) AS l1,
  sum(k) OVER (PARTITION BY feature) AS n, sum(k1) OVER (PARTITION BY feature) AS positive FROM tb"""
_ORDER += ["tb", "tcum"]
sql("edge_tree_gains", f"""SELECT feature, bin, {d(f"CASE WHEN n > l THEN {_impure('positive', 'n')} - l::DOUBLE / n * ({_impure('l1', 'l')}) - (n - l)::DOUBLE / n * ({_impure('(positive - l1)', '(n - l)')}) ELSE 0.0::DOUBLE END", 'gain')},
  n::BIGINT AS n, positive::BIGINT AS positive FROM tcum""")

# ---- retraining cycles -----------------------------------------------------------------------------------------------------
CTES["tc"] = f"""SELECT series_id, row_idx FROM (SELECT *, count(*) FILTER (WHERE raw_severity > 0.55) OVER ({SER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS alarms FROM rel)
  WHERE alarms >= 4 AND smoothed_severity >= 0.35 AND row_idx >= 39"""
CTES["tf"] = """
  SELECT series_id, min(row_idx) AS place FROM tc GROUP BY series_id
  UNION ALL
  SELECT * FROM (SELECT f.series_id, (SELECT min(c.row_idx) FROM tc c WHERE c.series_id = f.series_id AND c.row_idx >= f.place + 50) AS place
    FROM tf f) WHERE place IS NOT NULL"""
CTES["ta2"] = "SELECT series_id, place, row_number() OVER (PARTITION BY series_id ORDER BY place) - 1 AS attempt FROM tf"
CTES["tr"] = """
  SELECT a.series_id, a.attempt, z_value, z_k, y FROM ta2 a JOIN sc ON sc.series_id = a.series_id AND sc.row_idx <= a.place - 15 AND sc.row_idx > a.place - 115
  UNION ALL SELECT a.series_id, a.attempt, z_value, z_k, y FROM ta2 a JOIN n ON n.series_id = a.series_id AND n.role = 'baseline_train'"""
_moments = lambda k: f"count(*) FILTER (WHERE y = {k}) AS cnt{k}, " + ", ".join(
    f"avg({c}) FILTER (WHERE y = {k}) AS {c}_m{k}, var_pop({c}) FILTER (WHERE y = {k}) AS {c}_v{k}" for c in ("z_value", "z_k"))
CTES["tm"] = f"SELECT series_id, attempt, {_moments(0)}, {_moments(1)} FROM tr GROUP BY series_id, attempt"
CTES["t1"] = f"SELECT {_moments(0)}, {_moments(1)} FROM n WHERE role = 'baseline_train'"
_half = lambda k: f"ln(cnt{k} / (cnt0 + cnt1)) - 0.5::DOUBLE * (" + " + ".join(
    f"ln(2.0 * pi() * {c}_v{k}) + pow({c} - {c}_m{k}, 2) / {c}_v{k}" for c in ("z_value", "z_k")) + ")"
_p1 = f"1.0 / (1.0 + exp(({_half(0)}) - ({_half(1)})))"
CTES["tv"] = f"SELECT n.series_id, tm.attempt, y, ({_p1} >= 0.5)::INT AS p FROM n JOIN tm ON tm.series_id = n.series_id WHERE role = 'baseline_validation'"
CTES["t0"] = f"SELECT n.series_id, y, ({_p1} >= 0.5)::INT AS p FROM n CROSS JOIN t1 WHERE role = 'baseline_validation'"
CTES["tg"] = f"""SELECT a.series_id, a.attempt, a.place, c.f AS candidate_metric, b.f AS first_metric FROM ta2 a
  JOIN (SELECT series_id, attempt, {_scores['f1']} AS f FROM (SELECT series_id, attempt, {matrix('y', 'p')} FROM tv GROUP BY 1, 2)) c ON c.series_id = a.series_id AND c.attempt = a.attempt
  JOIN (SELECT series_id, {_scores['f1']} AS f FROM (SELECT series_id, {matrix('y', 'p')} FROM t0 GROUP BY 1)) b ON b.series_id = a.series_id"""
CTES["ts_"] = """
  SELECT series_id, attempt, place, candidate_metric, first_metric AS base, candidate_metric >= 0.4 AND candidate_metric >= first_metric - 0.05 AS ok,
    (candidate_metric >= 0.4 AND candidate_metric >= first_metric - 0.05)::BIGINT AS done,
    CASE WHEN candidate_metric >= 0.4 AND candidate_metric >= first_metric - 0.05 THEN candidate_metric ELSE first_metric END AS hold FROM tg WHERE attempt = 0
  UNION ALL
  SELECT g.series_id, g.attempt, g.place, g.candidate_metric, p.hold, g.candidate_metric >= 0.4 AND g.candidate_metric >= p.hold - 0.05,
    p.done + (g.candidate_metric >= 0.4 AND g.candidate_metric >= p.hold - 0.05)::BIGINT,
    CASE WHEN g.candidate_metric >= 0.4 AND g.candidate_metric >= p.hold - 0.05 THEN g.candidate_metric ELSE p.hold END
  FROM ts_ p JOIN tg g ON g.series_id = p.series_id AND g.attempt = p.attempt + 1"""
CTES["tw"] = f"""
  SELECT x.series_id, x.row_idx, x.y, coalesce('v' || (s.done + 1), 'v1') AS model_version,
    CASE WHEN s.series_id IS NULL THEN x.p_first ELSE (SELECT {_p1} FROM tm WHERE tm.series_id = s.series_id AND tm.attempt = s.attempt) END AS p1
  FROM (SELECT sc.series_id, sc.row_idx, sc.y, z_value, z_k, {_p1} AS p_first FROM sc CROSS JOIN t1) x
  ASOF LEFT JOIN (SELECT * FROM ts_ WHERE ok) s ON s.series_id = x.series_id AND x.row_idx > s.place"""
CTES["tl"] = """
  SELECT * FROM (SELECT fb.*, row_number() OVER (PARTITION BY fb.series_id ORDER BY fb.row_idx DESC) AS back
    FROM fb JOIN (SELECT series_id, max(place) AS as_of FROM ta2 GROUP BY 1) a ON a.series_id = fb.series_id
    WHERE is_labeled AND causal AND arrival_index <= as_of AND fb.row_idx <= as_of AND fb.row_idx > as_of - 100) WHERE back <= 40"""
_ORDER += ["tc", "tf", "ta2", "tr", "tm", "t1", "tv", "t0", "tg", "ts_", "tw", "tl"]
sql("training_union", f"""SELECT origin, label, count(*) AS n, {d('avg(z_value)', 'mean_z')} FROM (SELECT 'baseline' AS origin, y AS label, z_value FROM smp UNION ALL SELECT 'feedback', label, z_value FROM tl) GROUP BY 1, 2""")
sql("retrain_metadata", """SELECT 'v2' AS candidate_version, 'v1' AS parent_version, a + b AS total_samples_trained, a AS baseline_samples_used, b AS feedback_samples_used,
  2 AS feature_count, 42 AS random_seed, CASE WHEN b BETWEEN 25 AND 1000 THEN 'TRAINED' ELSE 'REFUSED' END AS status,
  CASE WHEN b < 25 THEN 'too few labels' WHEN b > 1000 THEN 'more labels than the buffer holds' END AS reason FROM (SELECT (SELECT count(*) FROM smp) AS a, (SELECT count(*) FROM tl) AS b)""")
sql("adaptation_cycles", f"""SELECT series_id, attempt, place AS trigger_idx, {d('candidate_metric', 'candidate_metric')}, {d('base', 'active_metric')}, ok AS accepted,
  'v' || (done - ok::INT + 2) AS version, 'v' || (done - ok::INT + 1) AS parent_version, 'v' || (done + 1) AS active_version, CASE WHEN ok THEN 'ACTIVE' ELSE 'REJECTED' END AS status FROM ts_""")
sql("adapted_answers", f"SELECT series_id, row_idx, y, model_version, {d('p1', 'p1')}, (p1 >= 0.5)::INT AS prediction FROM tw")
CTES["tx"] = f"SELECT model_version, {matrix('y', '(p1 >= 0.5)::INT')} FROM tw GROUP BY 1"
_ORDER.append("tx")
sql("adapted_metrics", f"SELECT model_version, {_show}, tp + fp + fn + tn AS sample_count, tp, fp, fn, tn FROM tx")

_one = lambda name, body: f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM ({body}) q"
sql("sink_result_tables", "\n UNION ALL ".join([
    *[_one(n, "SELECT method, seed FROM rt") for n in ("reliability_metrics", "routing_metrics", "hybrid_metrics", "prediction_metrics", "latency_metrics")],
    _one("baseline_model_metrics", "SELECT model FROM mc"), _one("drift_metrics", "SELECT DISTINCT seed, series_id FROM sp"),
    _one("adaptation_metrics", "SELECT attempt FROM ts_"), _one("model_version_metrics", "SELECT DISTINCT series_id FROM ts_"),
    _one("network_metrics", "SELECT DISTINCT seed FROM lg WHERE network_latency_s IS NOT NULL"), _one("execution_metrics", "SELECT DISTINCT selected_action, seed FROM lg"),
    _one("ablation_metrics", "SELECT DISTINCT method FROM rt"), _one("statistical_results", "SELECT comparison FROM ps"),
]))

# ---- streaming: the drained stream equals the batch answer ---------------------------------------------------------------
CTES["ws"] = """
  SELECT g.start_index, q.* FROM (SELECT series_id, unnest(range(0, n_rows - 20 + 1, 5)) AS start_index FROM len WHERE role = 'inference' AND n_rows >= 20) g
  JOIN o q ON q.series_id = g.series_id AND q.role = 'inference' AND q.row_idx >= g.start_index AND q.row_idx < g.start_index + 20"""
_ORDER.append("ws")
sql("stream_windows", f"""SELECT series_id, start_index, start_index + 20 AS end_index, {d('avg(value)', 'mean')}, {d('min(value)', 'minimum')}, {d('max(value)', 'maximum')},
  false AS is_late FROM ws GROUP BY series_id, start_index""")
sql("stream_ordering", "SELECT series_id, row_idx, event_id, false AS is_late FROM o WHERE role = 'inference'")
sql("stream_late_rows", """SELECT series_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS n_folded, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-23') AS n_late FROM t GROUP BY 1""")
sql("stream_monitor", f"""SELECT series_id, count(*) AS total_observations, {n_if("selected_action = 'EDGE'", 'n_edge')}, {n_if("selected_action = 'CLOUD'", 'n_cloud')}, {n_if("selected_action = 'HYBRID'", 'n_hybrid')},
  {n_if('NOT success', 'n_failed')}, {n_if('cloud_fallback', 'n_fallbacks')}, {d('avg(total_latency_s)', 'mean_latency_s')}, {d('max(total_latency_s)', 'max_latency_s')} FROM lg GROUP BY 1""")
sql("stream_feedback", f"""SELECT event_id, (value > 60)::INT AS prediction, CASE WHEN in_time THEN y END AS label,
  {stamp('CASE WHEN in_time THEN ts + to_hours(k::BIGINT) END', 'arrival_ts')}, in_time AS is_labeled
  FROM (SELECT *, coalesce(event_type <> 'view' AND k <= 72, false) AS in_time FROM t WHERE role = 'inference')""")
sql("stream_feedback_late", f"""SELECT event_id, y AS label, {stamp('ts + to_hours(k::BIGINT)', 'arrival_ts')} FROM t WHERE role = 'inference' AND event_type <> 'view' AND k > 72""")
# The 25 columns of a telemetry row, its alerts and the newest rows of every device.
CTES["tele"] = """
  SELECT series_id, row_idx, lg.row_idx AS observation_index, epoch_us(rel.ts) / 1e6 AS timestamp, reliability, confidence, error_ema, smoothed_severity AS drift_severity, 1.0::DOUBLE AS quality,
    selected_action, lag(selected_action) OVER (PARTITION BY series_id ORDER BY row_idx) AS previous_action, 'event type of ' || model_used AS decision_reason, edge_pred AS prediction,
    model_used, execution_status, cloud_fallback, edge_latency_s, cloud_latency_s, CASE WHEN selected_action = 'HYBRID' THEN total_latency_s END AS hybrid_latency_s, 'v1' AS model_version,
    raw_severity > 0.55 AS drift_detected, count(*) FILTER (WHERE raw_severity > 0.55) OVER (PARTITION BY series_id ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 8 AS is_persistent,
    raw_severity, smoothed_severity, 'event_type' AS controller_policy, network_latency_s, packet_lost, success
  FROM lg JOIN rel USING (series_id, row_idx)"""
_ORDER.append("tele")
_floats = ("timestamp", "reliability", "confidence", "error_ema", "drift_severity", "quality", "edge_latency_s", "cloud_latency_s", "hybrid_latency_s", "raw_severity", "smoothed_severity", "network_latency_s")
_texts = ("observation_index", "selected_action", "previous_action", "decision_reason", "prediction", "model_used", "execution_status", "cloud_fallback", "model_version", "drift_detected", "is_persistent", "controller_policy", "packet_lost")
sql("stream_recent", f"""SELECT series_id, {', '.join([*_texts, *(d(c, c) for c in _floats)])}
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY row_idx DESC) AS place FROM tele) WHERE place <= 5""")
sql("stream_alerts", """SELECT series_id, alert, count(*) AS n, min(row_idx) AS first_row FROM (SELECT series_id, row_idx, unnest([
    CASE WHEN reliability < 0.5 THEN 'reliability_degraded' END, CASE WHEN drift_detected OR is_persistent OR smoothed_severity > 0.35 THEN 'drift_active' END,
    CASE WHEN NOT success THEN 'execution_failure_detected' END, CASE WHEN cloud_fallback THEN 'cloud_fallback_active' END, CASE WHEN packet_lost THEN 'packet_loss' END]) AS alert
  FROM tele) WHERE alert IS NOT NULL GROUP BY 1, 2""")
