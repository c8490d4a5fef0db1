"""The queries again as plain SQL, for DuckDB.

Common parts are named sub-queries; each query lists the ones it needs.
"""

from __future__ import annotations

from tallyhouse.operators.budget import ALERT_TTL_MS, WARN_PERCENTS
from tallyhouse.operators.dedup import RETENTION_MS
from tallyhouse.plans.registry import (
    BASELINE, BUDGET_SCALE, BUDGETS_RESET_MS, BUDGETS_SET_MS, NOW_MS, PERIOD, RERATE_END_MS, RERATED, TIER_SCALE,
)
from tallyhouse.sources.price_lists import (
    BASELINE_CACHE_READ, BASELINE_CACHE_READ_DEFAULT, BASELINE_DEFAULT, BASELINE_PRICES,
    BASELINE_REASONING, BASELINE_REASONING_DEFAULT, STANDARD, TIERED,
)
from tallyhouse.sources.sample_tables import MODEL_NAMES

NAMES = "[" + ", ".join(f"'{m}'" for m in MODEL_NAMES) + "]"
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "embedding_tokens"]
TOTAL = " + ".join(TOKENS)
MONTH = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m')"
DAY = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d')"
CUST = "tenant_id, customer_id"
KEYS = "tenant_id, customer_id, model_id"
SURVIVOR = ", ".join(["ts_ms", *TOKENS, "latency_ms", "parent_span_id NULLS FIRST", "session_id", "key_id"])


def model(key):
    return f"{NAMES}[{key} % 10 + 1]"


def provider(key):
    return (f"CASE WHEN {key} % 10 IN (2, 3) THEN 'anthropic' WHEN {key} % 10 = 6 THEN 'google' "
            f"WHEN {key} % 10 = 7 THEN 'deepseek' WHEN {key} % 10 = 9 THEN 'custom' ELSE 'openai' END")


def total(expression, name):
    return f"CAST(sum({expression}) AS BIGINT) AS {name}"


def normalized(column, catalog):
    listed = ", ".join(f"'{m}'" for m in catalog["models"])
    prefixes = ", ".join(f"'{p}'" for p in catalog["prefix_models"])
    return (f"CASE WHEN {column} IN ({listed}) THEN {column} ELSE "
            f"coalesce([p FOR p IN [{prefixes}] IF starts_with({column}, p)][1], {column}) END")


def raw(scale=1):
    q = f"CAST(l_quantity AS BIGINT) * {scale}"
    return f"""raw AS (
  SELECT 'li-' || l_orderkey || '-' || l_linenumber AS event_id, 't' || (c_nationkey % 5) AS tenant_id,
    'cust_' || (o_custkey % 200) AS customer_id,
    CASE WHEN l_orderkey % 10 = 0 THEN 'span_' || l_orderkey END AS parent_span_id,
    {provider('l_partkey')} AS provider, {model('l_partkey')} AS model_id,
    {q} * 137 AS input_tokens, {q} * (10 + l_linenumber) AS output_tokens,
    CASE WHEN l_partkey % 4 = 0 THEN {q} * 31 ELSE 0 END AS cache_read_tokens,
    CASE WHEN l_suppkey % 6 = 0 THEN {q} * 7 ELSE 0 END AS cache_write_tokens,
    CASE WHEN l_returnflag = 'R' THEN {q} * 55 ELSE 0 END AS reasoning_tokens,
    CASE WHEN l_partkey % 10 = 8 THEN {q} * 90 ELSE 0 END AS embedding_tokens,
    epoch_ms(l_shipdate) + ((l_partkey * 7919 + l_linenumber * 104729 + l_suppkey * 31) % 86400) * 1000 AS ts_ms,
    l_partkey % 2000 AS latency_ms, 'sess_' || (l_orderkey % 5000) AS session_id,
    CASE WHEN l_linestatus = 'F' THEN 'production' ELSE 'staging' END AS environment,
    c_mktsegment AS feature, CAST(l_suppkey % 50 AS VARCHAR) AS room_id, l_linenumber = 7 AS heartbeat,
    'key_' || (o_custkey % 400) AS key_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


RETRIED = """retried AS (
  SELECT * FROM raw UNION ALL
  SELECT * REPLACE (ts_ms + CASE WHEN cache_write_tokens > 0 THEN 1000 ELSE 5400000 END AS ts_ms)
  FROM raw WHERE cache_write_tokens > 0 OR cache_read_tokens > 0)"""


def clean(catalog=STANDARD, source="raw"):
    return f"""billable AS (
  SELECT * REPLACE ({normalized('model_id', catalog)} AS model_id), ts_ms - ts_ms % 10000 AS window_start_ms
  FROM {source} WHERE NOT heartbeat),
clean AS (
  SELECT * EXCLUDE (pick) FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEYS}, window_start_ms, event_id ORDER BY {SURVIVOR}) AS pick,
      count(*) OVER (PARTITION BY {KEYS}, window_start_ms, event_id) AS copies
    FROM billable) WHERE pick = 1)"""


def flat_prices():
    rows = ", ".join(
        f"('{m}', CAST({p.get('input_per_m', 1.0)} AS DOUBLE), CAST({p.get('output_per_m', 3.0)} AS DOUBLE), "
        f"CAST({p.get('embedding_per_m', 0.1)} AS DOUBLE))"
        for m, p in STANDARD["models"].items()
    )
    return f"prices(m, pin, pout, pemb) AS (VALUES {rows})"


def half_up(x):
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


FLAT_COST = " + ".join([
    half_up("input_tokens * pin"), half_up("output_tokens * pout"), half_up("cache_read_tokens * pin * 0.5"),
    half_up("reasoning_tokens * pout"), half_up("cache_write_tokens * pin"), half_up("embedding_tokens * pemb"),
])


def priced(scale=1, source="raw"):
    extra = [RETRIED] if source == "retried" else []
    return [raw(scale), *extra, clean(STANDARD, source), flat_prices(), f"""priced AS (
  SELECT *, {FLAT_COST} AS cost_micro, {TOTAL} AS total_tokens, {MONTH} AS period FROM (
    SELECT clean.*, coalesce(pin, 1.0::DOUBLE) AS pin, coalesce(pout, 3.0::DOUBLE) AS pout, coalesce(pemb, 0.1::DOUBLE) AS pemb
    FROM clean LEFT JOIN prices ON model_id = m))"""]


# Tiers: (model, tier number, lower bound, upper bound, prices), upper bound
# exclusive; each category's tokens are laid end to end from the volume before.
TIER_ROWS = """tiers(m, mode, lo, hi, pin, pout, pemb) AS (VALUES
  ('gpt-4o-mini', 'volume', 0::BIGINT, 10000000::BIGINT, 0.15::DOUBLE, 0.60::DOUBLE, 0.1::DOUBLE),
  ('gpt-4o-mini', 'volume', 10000000, 100000000, 0.12, 0.48, 0.1),
  ('gpt-4o-mini', 'volume', 100000000, 9223372036854775807, 0.10, 0.40, 0.1),
  ('claude-sonnet-4', 'graduated', 0, 1000000, 2.00, 4.00, 0.1),
  ('claude-sonnet-4', 'graduated', 1000000, 9223372036854775807, 1.00, 2.00, 0.1),
  ('other', 'flat', 0, 9223372036854775807, 1.00, 3.00, 0.1))"""

STAMPED = f"""stamped AS (
  SELECT *, {TOTAL} AS total_tokens, {MONTH} AS month,
    coalesce(CAST(sum({TOTAL}) OVER (PARTITION BY {KEYS}, {MONTH} ORDER BY ts_ms, event_id, {', '.join(TOKENS)}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS volume_before,
    row_number() OVER () AS rid
  FROM clean)"""


def tier_cost(volume):
    """Cost of each stamped row (rid) with ``volume`` tokens before it."""
    return f"""tier_priced AS (
  SELECT s.rid, CAST(sum(CASE WHEN t.mode = 'graduated' THEN
      list_sum([floor(greatest(0, least(v + e[2], t.hi) - greatest(v + e[1], t.lo)) * e[3] + 0.5) FOR e IN [
        [0, c1, t.pin], [c1, c2, t.pout], [c2, c3, t.pin * 0.5], [c3, c4, t.pout], [c4, c5, t.pin], [c5, c6, t.pemb]]])
    WHEN v >= t.lo AND v < t.hi THEN {FLAT_COST.replace('pin', 't.pin').replace('pout', 't.pout').replace('pemb', 't.pemb')}
    ELSE 0 END) AS BIGINT) AS cost_micro
  FROM (SELECT *, {volume} AS v, input_tokens AS c1, input_tokens + output_tokens AS c2,
      input_tokens + output_tokens + cache_read_tokens AS c3,
      input_tokens + output_tokens + cache_read_tokens + reasoning_tokens AS c4,
      input_tokens + output_tokens + cache_read_tokens + reasoning_tokens + cache_write_tokens AS c5,
      {TOTAL} AS c6 FROM stamped) s
  JOIN tiers t ON t.m = CASE WHEN s.model_id IN ('gpt-4o-mini', 'claude-sonnet-4') THEN s.model_id ELSE 'other' END
  GROUP BY s.rid)"""


def tiered(volume="volume_before"):
    return [raw(TIER_SCALE), clean(TIERED), TIER_ROWS, STAMPED, tier_cost(volume)]


WINDOWS = f"""windows AS (
  SELECT {KEYS}, window_start_ms, {', '.join(total(c, c) for c in TOKENS)}, {total('total_tokens', 'total_tokens')},
    {total('cost_micro', 'cost_micro')}, count(*) AS event_count, {total('greatest(latency_ms, 0)', 'total_latency_ms')},
    {total('copies - 1', 'duplicate_count')}, window_start_ms + 10000 AS window_end_ms,
    CAST(sum(greatest(latency_ms, 0)) AS BIGINT) / CAST(count(*) AS DOUBLE) AS avg_latency_ms
  FROM priced GROUP BY {KEYS}, window_start_ms)"""

ROLLUP = ", ".join([
    *[total(c, c) for c in ("input_tokens", "output_tokens", "total_tokens")], "count(*) AS event_count",
    *[total(c, c) for c in ("cost_micro", "cache_read_tokens", "reasoning_tokens")],
])

SPANS = f"""spans AS (
  SELECT tenant_id, parent_span_id, arg_max(customer_id, (ts_ms, customer_id)) AS customer_id,
    {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'cost_micro')}, count(*) AS call_count,
    min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, max(ts_ms) - min(ts_ms) AS duration_ms
  FROM priced WHERE parent_span_id IS NOT NULL GROUP BY tenant_id, parent_span_id)"""

MODEL_MONTHS = f"""model_months AS (
  SELECT {KEYS}, period, {total('cost_micro', 'cost_micro')}, count(*) AS event_count,
    {', '.join(total(c, c) for c in ('total_tokens', 'input_tokens', 'output_tokens'))}
  FROM priced GROUP BY {KEYS}, period)"""

DIMS = """dims AS (
  SELECT tenant_id, dim_key, dim_value, period, CAST(sum(cost_micro) AS BIGINT) AS cost_micro, count(*) AS event_count
  FROM (SELECT tenant_id, 'feature' AS dim_key, feature AS dim_value, period, cost_micro FROM priced WHERE cost_micro > 0
    UNION ALL SELECT tenant_id, 'room_id', room_id, period, cost_micro FROM priced WHERE cost_micro > 0)
  GROUP BY GROUPING SETS ((tenant_id, dim_key, dim_value, period), (tenant_id, dim_key, dim_value)))"""

CUSTOMER_USAGE = f"""customer_usage AS (
  SELECT customer_id, count(*) AS event_count, {', '.join(total(c, c) for c in ('input_tokens', 'output_tokens', 'total_tokens', 'cost_micro'))}
  FROM priced GROUP BY customer_id)"""

CLICKS = f"""clicks AS (
  SELECT *, {normalized('raw_model', STANDARD)} AS model_id FROM (
    SELECT 'ev-' || event_id AS event_id, event_id AS n, CAST(NULL AS VARCHAR) AS tenant_id, 'cust_' || user_id AS customer_id,
      'span_' || (event_id // 20) AS parent_span_id, {model('event_id')} AS raw_model,
      CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
      epoch_us(ts) // 1000 AS ts_ms, event_id % 500 AS latency_ms,
      epoch_us(ts) // 1000 + CASE WHEN event_id % 7 = 0 THEN 3600000 ELSE 0 END AS arrival_ms
    FROM events))"""

PRICED_CLICKS = f"""priced_clicks AS (
  SELECT *, {half_up('input_tokens * pin')} + {half_up('output_tokens * pout')} AS cost_micro,
    input_tokens + output_tokens AS total_tokens, {MONTH} AS month
  FROM (SELECT clicks.*, coalesce(pin, 1.0::DOUBLE) AS pin, coalesce(pout, 3.0::DOUBLE) AS pout
    FROM clicks LEFT JOIN prices ON model_id = m))"""


def clicks():
    return [flat_prices(), CLICKS, PRICED_CLICKS]


SEEDS = f"""budgets AS (
  SELECT 't' || (c_nationkey % 5) AS tenant_id, 'cust_' || (c_custkey % 200) AS customer_id,
    greatest(0, CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS BIGINT)) AS cents, max(c_custkey % 2) = 1 AS odd
  FROM customer GROUP BY 1, 2),
seeds AS (
  SELECT {CUST}, {BUDGETS_SET_MS}::BIGINT AS ts_ms, 0 AS seq, 'first' AS ref, 'set' AS kind, cents * 100 AS amount_micro,
    CASE WHEN odd THEN cents * 20 END AS alert_threshold_micro, CAST(NULL AS VARCHAR) AS model_id FROM budgets
  UNION ALL SELECT {CUST}, {BUDGETS_RESET_MS}, 0, 'again', 'set', cents * 100,
    CASE WHEN odd THEN cents * 20 END, NULL FROM budgets WHERE CAST(substr(customer_id, 6) AS INT) % 7 = 0
  UNION ALL SELECT 't' || (c_nationkey % 5), 'cust_' || (o_custkey % 200), epoch_ms(o_orderdate), 1, 'order-' || o_orderkey,
    'topup', CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT), NULL, NULL
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1-%')"""

CHARGES = f"""charges AS (
  SELECT {CUST}, window_end_ms AS ts_ms, 3 AS seq, model_id || '|' || window_start_ms AS ref, 'cost' AS kind,
    cost_micro AS amount_micro, CAST(NULL AS BIGINT) AS alert_threshold_micro, model_id FROM windows)"""

ADJUSTED = f"""by_model AS (
  SELECT {KEYS}, {ROLLUP} FROM priced GROUP BY {KEYS}),
adjusted AS (
  SELECT *, CAST(floor(exact + 0.5) AS BIGINT) AS adjustment_micro FROM (
    SELECT *, input_tokens * CAST({RERATED['new_input_price'] - RERATED['old_input_price']} AS DOUBLE)
      + output_tokens * CAST({RERATED['new_output_price'] - RERATED['old_output_price']} AS DOUBLE) AS exact
    FROM by_model WHERE model_id = '{RERATED['model_id']}') WHERE abs(exact) > 1000)"""


def ledger(moves="SELECT * FROM seeds UNION ALL SELECT * FROM charges", tables=None):
    order = "ORDER BY ts_ms, seq, ref ROWS UNBOUNDED PRECEDING"
    return [*(tables or [*priced(BUDGET_SCALE), WINDOWS, SEEDS, CHARGES]), f"""moves AS ({moves}),
epochs AS (
  SELECT *, CAST(sum((kind = 'set')::INT) OVER (PARTITION BY {CUST} {order}) AS BIGINT) AS epoch,
    CASE WHEN kind IN ('set', 'topup') THEN amount_micro ELSE -amount_micro END AS signed FROM moves),
summed AS (
  SELECT *, CAST(sum(signed) OVER w AS BIGINT) AS s,
    CAST(sum(CASE WHEN kind = 'topup' THEN amount_micro ELSE 0 END) OVER w AS BIGINT) AS topup_micro,
    CAST(sum(CASE WHEN kind = 'cost' THEN amount_micro ELSE 0 END) OVER w AS BIGINT) AS deducted_micro,
    first_value(amount_micro) OVER w AS initial_micro,
    first_value(coalesce(CAST(alert_threshold_micro AS DOUBLE), amount_micro * CAST(0.1 AS DOUBLE))) OVER w AS threshold_micro
  FROM epochs WHERE epoch > 0 WINDOW w AS (PARTITION BY {CUST}, epoch {order})),
floored AS (
  SELECT *, greatest(0, -(min(s) OVER (PARTITION BY {CUST}, epoch {order}))) AS debt_micro FROM summed),
ledger AS (
  SELECT *, s + debt_micro AS balance_micro,
    CASE WHEN kind <> 'set' THEN lag(s + debt_micro) OVER (PARTITION BY {CUST}, epoch ORDER BY ts_ms, seq, ref) END AS balance_before_micro
  FROM floored)""", f"""last_state AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY {CUST} ORDER BY ts_ms DESC, seq DESC, ref DESC) = 1)"""]


LINKS = """links AS (
  SELECT 'cust_' || n AS customer_id, CASE WHEN n % 9 <> 3 THEN 'cus_' || n END AS stripe_id,
    CASE WHEN n % 6 = 0 THEN 'mtr_' || n END AS metronome_id, CASE WHEN n % 9 = 3 THEN 'orb_' || n END AS orb_id
  FROM (SELECT DISTINCT c_custkey % 200 AS n FROM customer) WHERE n % 3 = 0)"""

MEASURES = ["event_count", "input_tokens", "output_tokens", "cost_micro"]
DELTAS = f"""marks AS (
  SELECT customer_id, count(*) AS last_event_count, {total('input_tokens', 'last_input_tokens')},
    {total('output_tokens', 'last_output_tokens')}, {total('cost_micro', 'last_cost_micro')}
  FROM priced WHERE ts_ms < {BUDGETS_RESET_MS} GROUP BY customer_id),
deltas AS (
  SELECT * FROM (SELECT customer_id, stripe_id, metronome_id, orb_id, {', '.join(MEASURES)},
      {', '.join(f'greatest(0, {m} - coalesce(last_{m}, 0)) AS new_{m}' for m in MEASURES)}
    FROM customer_usage JOIN links USING (customer_id) LEFT JOIN marks USING (customer_id))
  WHERE {' OR '.join(f'new_{m} > 0' for m in MEASURES)})"""


def export_delta_tables():
    return [*priced(), CUSTOMER_USAGE, LINKS, DELTAS]


REVENUE = """revenue AS (
  SELECT 'cust_' || (o_custkey % 200) AS customer_id, strftime(o_orderdate, '%Y-%m') AS period,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / CAST(1e8 AS DOUBLE) AS revenue_usd
  FROM orders WHERE o_custkey % 200 >= 20 GROUP BY 1, 2)"""


def usd(x):
    return f"{x} / CAST(1e6 AS DOUBLE)"


def economics(period=PERIOD, name="economics", by="customer_id", revenue="revenue"):
    return f"""{name} AS (
  SELECT {by}, '{period}' AS period, revenue_usd, cost_usd, margin_usd,
    CASE WHEN revenue_usd > 0 THEN margin_usd / revenue_usd * 100 END AS margin_pct,
    CASE WHEN revenue_usd IS NULL THEN 'unknown_revenue' WHEN margin_usd < 0 THEN 'loss' ELSE 'profitable' END AS status
  FROM (SELECT {by}, revenue_usd, cost_usd, revenue_usd - cost_usd AS margin_usd FROM (
      SELECT {by}, {usd('CAST(sum(cost_micro) AS BIGINT)')} AS cost_usd FROM model_months
      WHERE period = '{period}' GROUP BY {by})
    LEFT JOIN (SELECT {by}, revenue_usd FROM {revenue} WHERE period = '{period}') USING ({by})))"""


TENANT_REVENUE = """tenant_revenue AS (
  SELECT 't' || (c_nationkey % 5) AS tenant_id, 'cust_' || (o_custkey % 200) AS customer_id, strftime(o_orderdate, '%Y-%m') AS period,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / CAST(1e8 AS DOUBLE) AS revenue_usd
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 200 >= 20 GROUP BY ALL)"""


def money(x):
    """Dollars with two digits, halves of the shortest decimal text upward."""
    return f"CAST(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12)) AS DECIMAL(38, 2)) AS VARCHAR)"


UNIT_ADVICE = """CASE status WHEN 'unknown_revenue' THEN 'Connect revenue (OpenMeter overlay or POST /intelligence/revenue)'
        WHEN 'loss' THEN 'Customer losing money — suggest plan upgrade or usage cap'
        ELSE CASE WHEN margin_pct < 10 THEN 'Low margin — review model mix or pricing' END END AS recommendation"""


def months():
    return [*priced(BUDGET_SCALE), MODEL_MONTHS, DIMS, REVENUE]


def exact_sum(x):
    return f"CAST(sum(CAST(floor({x} * 1e8 + 0.5) AS BIGINT)) AS DOUBLE) / 1e8"


def contributors(scope="TRUE"):
    pair = (f"CAST(sum(CASE WHEN period = '{PERIOD}' THEN cost_micro ELSE 0 END) AS BIGINT) AS cur, "
            f"CAST(sum(CASE WHEN period = '{BASELINE}' THEN cost_micro ELSE 0 END) AS BIGINT) AS base")
    two = f"period IN ('{PERIOD}', '{BASELINE}')"
    return f"""totals AS (
  SELECT *, CASE WHEN baseline_cost_usd <> 0 THEN delta_usd / baseline_cost_usd * 100 ELSE 0 END AS delta_pct FROM (
    SELECT {usd('coalesce(cur, 0)')} AS total_cost_usd, {usd('coalesce(base, 0)')} AS baseline_cost_usd,
      {usd('coalesce(cur - base, 0)')} AS delta_usd
    FROM (SELECT {pair} FROM model_months WHERE {two} AND {scope}))),
contributors AS (
  SELECT dimension, key, {usd('cur')} AS current_cost_usd, {usd('base')} AS baseline_cost_usd,
    {usd('(cur - base)')} AS delta_usd,
    CASE WHEN base <> 0 THEN {usd('(cur - base)')} / ({usd('base')}) * 100 ELSE 0 END AS delta_pct,
    CASE WHEN t.delta_usd <> 0 THEN {usd('(cur - base)')} / t.delta_usd * 100 ELSE 0 END AS share_of_total_delta_pct
  FROM (
    SELECT 'model' AS dimension, model_id AS key, {pair} FROM model_months WHERE {two} AND {scope} GROUP BY model_id
    UNION ALL SELECT 'customer', customer_id, {pair} FROM model_months WHERE {two} AND {scope} GROUP BY customer_id
    UNION ALL SELECT dim_key, dim_value, {pair} FROM dims WHERE {two} GROUP BY dim_key, dim_value),
    (SELECT delta_usd FROM totals) t
  ORDER BY abs(cur - base) DESC, dimension, key LIMIT 10)"""


SUMMARY = f"""summary AS (
  SELECT totals.*, printf('Cost %+.1f%% vs {BASELINE}. Top driver: %s %s (%.0f%% of change).',
    totals.delta_pct, top.dimension, top.key, top.share_of_total_delta_pct) AS summary
  FROM totals, (SELECT * FROM contributors ORDER BY abs(delta_usd) DESC, dimension, key LIMIT 1) top)"""

OFFERS = " UNION ALL ".join(
    f"SELECT {i} AS i, '{m}' AS offer, CAST({p.get('input_per_m', 1.0)} AS DOUBLE) AS oin, CAST({p.get('output_per_m', 3.0)} AS DOUBLE) AS oout"
    for i, (m, p) in enumerate(STANDARD["models"].items())
)


def cheaper(source):
    return f"""offers AS ({OFFERS}),
cheaper AS (
  SELECT s.*, coalesce({half_up('input_tokens * o.oin')} + {half_up('output_tokens * o.oout')},
      {half_up('input_tokens * 1.0::DOUBLE')} + {half_up('output_tokens * 3.0::DOUBLE')}) AS from_cost_micro
  FROM {source} s LEFT JOIN offers o ON o.offer = s.model_id),
best AS (
  SELECT c.*, b.offer AS to_model, b.cost AS to_cost_micro FROM cheaper c
  LEFT JOIN LATERAL (SELECT offer, i, {half_up('c.input_tokens * oin')} + {half_up('c.output_tokens * oout')} AS cost
    FROM offers WHERE {half_up('c.input_tokens * oin')} + {half_up('c.output_tokens * oout')} < c.from_cost_micro
    ORDER BY cost, i LIMIT 1) b ON TRUE)"""


def advice(by="customer_id"):
    goal = "(cost_usd / (1.0::DOUBLE - 0.3::DOUBLE))"
    known = "status <> 'unknown_revenue'"
    sure = f"CASE WHEN prior AND {known} THEN 'high' ELSE 'medium' END"
    gain = f"({usd('from_cost_micro')} - {usd('to_cost_micro')})"
    before = f"FROM model_months WHERE period = '{BASELINE}'"
    prior = f"(SELECT count(*) > 0 {before})" if by == "customer_id" else f"tenant_id IN (SELECT tenant_id {before})"
    raised = f"'Raise price to $' || {money(goal)} || '/mo for 30% margin (current $' || {money('revenue_usd')} || ')'"
    switched = (f"'Switch ' || model_id || ' → ' || to_model || ': $' || {money(usd('from_cost_micro'))} || '/mo → $' || {money(usd('to_cost_micro'))} "
                f"|| '/mo ($+' || {money(gain)} || '/mo)'")
    own = economics() if by == "customer_id" else economics(by=by, revenue="tenant_revenue")
    return [*months(), TENANT_REVENUE, own, f"""dearest AS (
  SELECT {by}, model_id, greatest(input_tokens, 1) AS input_tokens, greatest(output_tokens, 1) AS output_tokens FROM (
    SELECT {by}, model_id, {total('cost_micro', 'cost_micro')}, {total('input_tokens', 'input_tokens')},
      {total('output_tokens', 'output_tokens')}
    FROM model_months WHERE period = '{PERIOD}' GROUP BY {by}, model_id)
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY cost_micro DESC, model_id) = 1)""", cheaper("dearest"), f"""facts AS (
  SELECT economics.*, best.* EXCLUDE ({by}), {prior} AS prior
  FROM economics LEFT JOIN best USING ({by})),
advice AS (
  SELECT {by}, period, 'connect_revenue' AS action, CAST(NULL AS DOUBLE) AS current_margin_pct,
    CAST(NULL AS DOUBLE) AS roi_annual_usd, 'medium' AS confidence,
    'Connect revenue via OpenMeter overlay or POST /intelligence/revenue' AS suggested_change FROM facts WHERE NOT ({known})
  UNION ALL SELECT {by}, period, 'price_increase', margin_pct, ({goal} - revenue_usd) * 12, {sure}, {raised} FROM facts WHERE status = 'loss'
  UNION ALL SELECT {by}, period, 'model_switch', margin_pct, {gain} * 12, {sure}, {switched} FROM facts WHERE {known} AND to_model IS NOT NULL
  UNION ALL SELECT {by}, period, 'price_increase', margin_pct, greatest(0, ({goal} - revenue_usd) * 12), {sure},
    'Low margin — consider price increase to $' || {money(goal)} || '/mo'
  FROM facts WHERE status = 'profitable' AND model_id IS NULL AND margin_pct < 10)"""]


def forecast(keys, budget):
    group = f"GROUP BY {keys}" if keys else ""
    first = f"{keys}, " if keys else ""
    return f"""forecasts AS (
  SELECT '{PERIOD}' AS period, {first}mtd_cost_usd, forecast_eom_cost_usd, budget_usd,
    forecast_eom_cost_usd - budget_usd AS variance_usd,
    CASE WHEN budget_usd IS NULL THEN 'no_budget' WHEN forecast_eom_cost_usd > budget_usd THEN 'over_budget'
      WHEN forecast_eom_cost_usd > budget_usd * 0.85::DOUBLE THEN 'at_risk' ELSE 'on_track' END AS status
  FROM (SELECT *, mtd_cost_usd + mtd_cost_usd / elapsed * greatest(30 - elapsed, 0) AS forecast_eom_cost_usd FROM (
    SELECT {first}{usd('CAST(sum(cost_micro) AS BIGINT)')} AS mtd_cost_usd, greatest(count(DISTINCT {DAY}), 21) AS elapsed
    FROM priced WHERE {DAY} LIKE '{PERIOD}%' {group}) {budget}))"""


CUSTOMER_FORECASTS = forecast(CUST, f"LEFT JOIN (SELECT {CUST}, cents * 100 / CAST(1e7 AS DOUBLE) AS budget_usd FROM budgets) USING ({CUST})")
ADVICE_TEXT = {
    "INTEL_COST_SPIKE": "Review top contributors and consider model switch or pricing adjustment",
    "INTEL_MARGIN_LOSS": "Review unit economics and pricing recommendations",
    "INTEL_FORECAST_RISK": "Align spend with budget or raise limits",
}

LATE = f"""late AS (
  SELECT * FROM (SELECT *, max(ts_ms) OVER (ORDER BY arrival_ms, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
    FROM clicks) WHERE ts_ms - ts_ms % 10000 + 10000 <= newest - 5000)"""

CHUNKS = f"""chunks AS (
  SELECT 'conv_' || conv_id AS stream_id, turn AS chunk_no, {normalized(model('conv_id'), STANDARD)} AS model_id,
    text AS content, CASE WHEN turn % 4 = 3 THEN length(text) * 2 END AS usage_input,
    CASE WHEN turn % 4 = 3 THEN length(text) END AS usage_output, conv_id * 1000 + turn * 700 AS chunk_ms,
    CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 400 + conv_id % 50 * 20 END AS reserved_micro
  FROM conversations WHERE role = 'assistant')"""


def case(column, table, default):
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


BASELINE_NANO = " + ".join([
    f"input_tokens * {case('model_id', {k: v[0] for k, v in BASELINE_PRICES.items()}, BASELINE_DEFAULT[0])}",
    f"output_tokens * {case('model_id', {k: v[1] for k, v in BASELINE_PRICES.items()}, BASELINE_DEFAULT[1])}",
    f"reasoning_tokens * {case('model_id', BASELINE_REASONING, BASELINE_REASONING_DEFAULT)}",
    f"cache_read_tokens * {case('model_id', BASELINE_CACHE_READ, BASELINE_CACHE_READ_DEFAULT)}",
])
MINUTES = f"""minutes AS (
  SELECT make_timestamp((ts_ms - ts_ms % 60000) * 1000) AS window_start, customer_id, provider, model_id,
    {', '.join(total(c, c) for c in ('input_tokens', 'output_tokens', 'cache_read_tokens', 'reasoning_tokens'))},
    {total(TOTAL, 'total_tokens')}, count(*) AS event_count, {total('latency_ms', 'total_latency_ms')},
    {total(BASELINE_NANO, 'cost_nano')}
  FROM raw GROUP BY 1, 2, 3, 4)"""

BY_CUSTOMER = f"by_customer AS (SELECT {CUST}, {ROLLUP} FROM priced GROUP BY {CUST})"
BY_CUSTOMER_MODEL = f"by_customer_model AS (SELECT {KEYS}, {ROLLUP} FROM priced GROUP BY {KEYS})"

REQUESTS = f"requests AS (SELECT *, concat_ws('|', event_id, ts_ms, model_id) AS request_id FROM priced)"


def spent(scope, name, cap, bucket="''"):
    """Spend of the request's scope before its time, and the scope's cap."""
    return f"""{name}_caps AS (SELECT {scope} AS scope, {cap} AS cap FROM priced WHERE {scope} IS NOT NULL GROUP BY {scope}),
{name} AS (
  SELECT request_id, {CUST}, cap, coalesce(CAST(sum(cost_micro) OVER (PARTITION BY {scope}, {bucket}
      ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent
  FROM requests JOIN {name}_caps ON {scope} = scope)"""


def on_request(name):
    return f"LEFT JOIN {name} ON {name}.request_id = r.request_id AND {name}.tenant_id = r.tenant_id AND {name}.customer_id = r.customer_id"


def digest(columns, rows, by=None):
    """Rows and digest of a table: ``columns`` with their types' texts, in name order."""
    texts = {c: f"CAST(CAST({c} AS DECIMAL(38, 9)) AS VARCHAR)" if c == "avg_latency_ms" else f"CAST({c} AS VARCHAR)" for c in columns}
    row = " || ".join(f"coalesce(length({texts[c]}) || ':' || {texts[c]}, '-')" for c in sorted(columns))
    return f"SELECT {by + ', ' if by else ''}count(*) AS rows, coalesce(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)), 0) AS digest FROM ({rows}){' GROUP BY ' + by if by else ''}"


def build(parts, select):
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name, parts, select):
        q[name] = build(parts, select)

    # Cleaning
    add("decoded_events", [CLICKS], "SELECT n AS arrival_seq, event_id, customer_id, raw_model AS model_id, input_tokens, output_tokens, 0::BIGINT AS reasoning_tokens, ts_ms FROM clicks WHERE n % 97 <> 0")
    add("rejected_events", [], "SELECT event_id AS arrival_seq, substr('{\"eventId\":\"ev-' || event_id || '\",\"customerId\":', 1, 20) AS value FROM events WHERE event_id % 97 = 0")
    add("provider_payloads", [raw()], f"""SELECT provider, model_id, count(*) AS requests, {', '.join(total(c, c) for c in TOKENS[:3])},
        {total("CASE WHEN provider = 'anthropic' THEN cache_write_tokens ELSE 0 END", 'cache_write_tokens')},
        {total("CASE WHEN provider = 'anthropic' THEN 0 ELSE reasoning_tokens END", 'reasoning_tokens')}, 0::BIGINT AS embedding_tokens
        FROM raw GROUP BY provider, model_id""")
    add("billable_events", [raw()], f"SELECT {CUST}, count(*) AS events FROM raw WHERE NOT heartbeat GROUP BY {CUST}")
    bad = {"customer_id": "latency_ms % 53 = 0", "input_tokens": "latency_ms % 47 = 0", "environment": "latency_ms % 41 = 0"}
    add("valid_events", [raw()], f"SELECT tenant_id, environment, count(*) AS events, {total('input_tokens', 'input_tokens')} FROM raw WHERE NOT ({' OR '.join(bad.values())}) GROUP BY tenant_id, environment")
    add("quarantined_events", [raw()], "SELECT concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in bad.items()) + f") AS errors, count(*) AS events FROM raw WHERE {' OR '.join(bad.values())} GROUP BY 1")
    add("rejected_metadata", [raw()], """SELECT CASE WHEN latency_ms % 31 = 0 THEN 'empty_value' WHEN latency_ms % 29 = 0 THEN 'accepted'
        WHEN heartbeat THEN 'key_not_allowed' ELSE 'accepted' END AS reason, count(*) AS events FROM raw GROUP BY 1""")
    add("filled_defaults", [raw()], f"""SELECT {CUST}, max(t) AS last_ts_ms, count(*) FILTER (t = {NOW_MS}) AS defaulted
        FROM (SELECT *, CASE WHEN latency_ms % 10 = 3 THEN {NOW_MS} ELSE ts_ms END AS t FROM raw) GROUP BY {CUST}""")
    add("generated_ids", [raw()], f"SELECT {CUST}, count(*) AS events, count(DISTINCT CASE WHEN latency_ms % 10 <> 3 THEN event_id END) + count(*) FILTER (latency_ms % 10 = 3) AS ids, count(*) FILTER (latency_ms % 10 <> 3) AS own_ids FROM raw GROUP BY {CUST}")
    add("total_tokens", [raw()], f"SELECT model_id, {total(TOTAL, 'total_tokens')}, max({TOTAL}) AS largest FROM raw GROUP BY model_id")
    add("normalized_models", [raw()], f"SELECT model_id AS raw_model_id, {normalized('model_id', STANDARD)} AS model_id, count(*) AS events FROM raw GROUP BY 1, 2")
    add("scoped_tenants", [raw()], "SELECT nullif(tenant_id, 't0') AS tenant_id, count(*) AS events FROM raw GROUP BY 1")
    add("billing_periods", [raw()], f"SELECT {MONTH} AS month, {DAY} AS day, count(*) AS events FROM raw GROUP BY 1, 2")
    add("aggregation_keys", [raw()], """SELECT CASE WHEN latency_ms % 3 = 0 THEN tenant_id END AS tenant_id, customer_id,
        CASE WHEN latency_ms % 3 = 2 THEN 'unknown' ELSE model_id END AS model_id, count(*) AS events FROM raw GROUP BY 1, 2, 3""")
    add("revenue_overlay", [], f"""SELECT 'cust_' || (o_custkey % 200) AS customer_id, '{PERIOD}' AS period,
        arg_max(o_totalprice, o_orderkey) AS revenue_usd, 'overlay' AS source FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
    add("revenue_overlay_counts", [], "SELECT count(*) FILTER (o_orderstatus = 'F') AS revenue_rows, count(*) FILTER (o_orderstatus <> 'F') AS ignored_rows FROM orders")

    # Pricing
    add("flat_prices", priced(), f"SELECT {KEYS}, event_id, ts_ms, cost_micro FROM priced")
    add("customer_model_costs", [*priced(), MODEL_MONTHS], f"SELECT {KEYS}, period, cost_micro, event_count, total_tokens, input_tokens, output_tokens FROM model_months ORDER BY cost_micro DESC, {KEYS}, period LIMIT 10")
    add("volume_stamps", [raw(), clean(), STAMPED], f"SELECT {KEYS}, month, event_id, ts_ms, volume_before FROM stamped")
    add("tiered_prices", tiered(), f"SELECT {KEYS}, event_id, ts_ms, volume_before, tier_priced.cost_micro FROM stamped JOIN tier_priced USING (rid)")
    add("untiered_prices", tiered("0::BIGINT"), f"SELECT {KEYS}, {total('tier_priced.cost_micro', 'cost_micro')} FROM stamped JOIN tier_priced USING (rid) GROUP BY {KEYS}")
    add("span_costs_flat_and_actual", [*tiered(), tier_cost("0::BIGINT").replace("tier_priced", "flat_priced")],
        f"""SELECT tenant_id, parent_span_id, {total('f.cost_micro', 'span_cost_flat_micro')}, {total('t.cost_micro', 'span_cost_actual_micro')}
        FROM stamped JOIN tier_priced t USING (rid) JOIN flat_priced f USING (rid) WHERE parent_span_id IS NOT NULL GROUP BY 1, 2""")
    add("request_estimates", [flat_prices()], f"""SELECT conv_id, turn, model_id,
        greatest(1, {half_up('512 * coalesce(pin, 1.0::DOUBLE)')} + {half_up('wanted * coalesce(pout, 3.0::DOUBLE)')}) AS estimate_micro
        FROM (SELECT conv_id, turn, {normalized(model('conv_id'), STANDARD)} AS model_id,
          CASE WHEN turn % 3 = 0 OR length(text) = 0 THEN 1024 ELSE length(text) END AS wanted FROM conversations)
        LEFT JOIN prices ON model_id = m""")
    add("stream_kill_points", [flat_prices(), CHUNKS], """SELECT stream_id, chunk_no, input_tokens, output_tokens, estimate_micro, reserved_micro FROM (
        SELECT *, input_tokens * coalesce(pin, 1.0::DOUBLE) + output_tokens * coalesce(pout, 3.0::DOUBLE) AS estimate_micro FROM (
          SELECT *, CAST(sum(CASE WHEN usage_output IS NOT NULL THEN usage_output WHEN length(content) > 0 THEN greatest(1, length(content) // 4) ELSE 0 END)
              OVER (PARTITION BY stream_id, segment ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS output_tokens,
            coalesce(max(usage_input) OVER (PARTITION BY stream_id, segment), 0) AS input_tokens
          FROM (SELECT *, count(usage_output) OVER (PARTITION BY stream_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING) AS segment FROM chunks))
        LEFT JOIN prices ON model_id = m) WHERE reserved_micro > 0 AND estimate_micro > reserved_micro
        QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY chunk_no) = 1""")
    add("heartbeat_deltas", [CHUNKS], """SELECT stream_id, interval_ms, output_tokens - before AS delta_tokens FROM (
        SELECT *, greatest(0, coalesce(max(output_tokens) OVER (PARTITION BY stream_id ORDER BY interval_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before
        FROM (SELECT stream_id, chunk_ms - chunk_ms % 2000 AS interval_ms, arg_max(coalesce(usage_output, length(content) // 4), chunk_ms) AS output_tokens
          FROM chunks GROUP BY 1, 2)) WHERE output_tokens > before""")
    switch = f"""scenarios AS (
      SELECT {CUST}, model_id AS from_model, input_tokens, output_tokens, {NAMES}[event_count % 10 + 1] AS to_model, event_count % 4 + 1 AS monthly_occurrences
      FROM by_customer_model)"""
    cost = lambda a: usd(f"({half_up(f'input_tokens * coalesce({a}.pin, 1.0::DOUBLE)')} + {half_up(f'output_tokens * coalesce({a}.pout, 3.0::DOUBLE)')})")
    add("model_switches", [*priced(), BY_CUSTOMER_MODEL, switch], f"""SELECT *, (from_cost_usd - to_cost_usd) * 12 * monthly_occurrences AS annual_savings_usd FROM (
        SELECT s.*, {cost('f')} AS from_cost_usd, {cost('t')} AS to_cost_usd FROM scenarios s
        LEFT JOIN prices f ON f.m = s.from_model LEFT JOIN prices t ON t.m = {normalized('s.to_model', STANDARD)})""")
    add("prompt_reductions", [*priced(), BY_CUSTOMER], f"""SELECT *, cost_usd * (input_reduction_pct / 100.0::DOUBLE) * 0.5::DOUBLE * 12 AS annual_savings_usd FROM (
        SELECT {CUST}, {usd('cost_micro')} AS cost_usd, CAST(event_count % 50 AS DOUBLE) AS input_reduction_pct FROM by_customer)""")
    add("token_grants", [*priced(), BY_CUSTOMER], f"""SELECT *, (new_customers * avg_revenue_per_customer_usd - (grant_tokens * per_token) * new_customers) * 12 AS annual_profit_delta_usd
        FROM (SELECT *, customer_count * (signup_lift_pct / 100.0::DOUBLE) AS new_customers, CASE WHEN grant_tokens > 0 THEN cost_usd / grant_tokens ELSE 0 END AS per_token
          FROM (SELECT {CUST}, {usd('cost_micro')} AS cost_usd, event_count % 3 * 100000 AS grant_tokens, CAST(event_count % 20 AS DOUBLE) AS signup_lift_pct,
            49.0::DOUBLE AS avg_revenue_per_customer_usd, event_count AS customer_count FROM by_customer))""".replace("SELECT *, (new", "SELECT * EXCLUDE (new_customers, per_token), (new"))
    add("baseline_prices", [raw()], f"SELECT event_id, model_id, ts_ms, {BASELINE_NANO} AS cost_nano FROM raw")
    parts = """parts AS (SELECT p_partkey AS doc, p_partkey % 5 AS mode, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END AS n,
        p_size % 3 = 1 AS open, p_size FROM part)"""
    name = "'model-' || doc"
    add("catalog_violations", [parts], f"""
        SELECT doc AS doc_id, NULL AS model_id, 'unsupported_volume_scope' AS rule FROM parts WHERE doc % 11 = 0
        UNION ALL SELECT doc, NULL, 'missing_defaults' FROM parts WHERE doc % 7 = 0
        UNION ALL SELECT doc, {name}, 'invalid_pricing_mode' FROM parts WHERE mode = 4
        UNION ALL SELECT doc, {name}, 'flat_with_tiers' FROM parts WHERE mode = 1 AND n > 0
        UNION ALL SELECT doc, {name}, 'tiers_required' FROM parts WHERE mode IN (2, 3) AND n = 0
        UNION ALL SELECT doc, {name}, 'bounds_not_increasing' FROM parts WHERE n > 0 AND NOT open AND p_size >= 25
        UNION ALL SELECT doc, {name}, 'last_tier_not_open' FROM parts WHERE n > 0 AND NOT open""")
    add("snapshot_prices", [*priced()[:-1], f"""changed AS (
        SELECT clean.*, coalesce(pin, 4.0::DOUBLE) AS pin, coalesce(pout, 8.0::DOUBLE) AS pout, coalesce(pemb, 0.1::DOUBLE) AS pemb
        FROM clean LEFT JOIN prices ON model_id = m)"""], f"SELECT model_id, {total(FLAT_COST, 'cost_micro')}, count(*) AS events FROM changed GROUP BY model_id")

    # Deduplication
    add("window_dedup", [raw(), RETRIED, clean(STANDARD, "retried")], f"SELECT {KEYS}, window_start_ms, event_id, ts_ms, copies FROM clean")
    add("ttl_dedup", [raw(), RETRIED, f"""firsts AS (
        SELECT event_id, ts_ms, {KEYS} FROM (SELECT * REPLACE ({normalized('model_id', STANDARD)} AS model_id) FROM retried WHERE NOT heartbeat)
        QUALIFY row_number() OVER (PARTITION BY event_id, ts_ms ORDER BY {SURVIVOR}) = 1)""", """kept AS (
        SELECT event_id, min(ts_ms) AS ts_ms FROM firsts GROUP BY event_id
        UNION ALL SELECT event_id, ts_ms FROM (SELECT f.event_id, min(f.ts_ms) AS ts_ms FROM kept k JOIN firsts f
          ON f.event_id = k.event_id AND f.ts_ms >= k.ts_ms + 3600000 GROUP BY f.event_id, k.ts_ms))"""],
        f"SELECT event_id, ts_ms, {KEYS} FROM firsts JOIN kept USING (event_id, ts_ms)")
    deduped = [raw(), f"""firsts AS (
        SELECT * REPLACE ({normalized('model_id', STANDARD)} AS model_id) FROM raw WHERE NOT heartbeat
        QUALIFY row_number() OVER (PARTITION BY event_id, ts_ms ORDER BY {SURVIVOR}) = 1)""", f"""kept AS (
        SELECT event_id, min(ts_ms) AS ts_ms FROM firsts GROUP BY event_id
        UNION ALL SELECT event_id, ts_ms FROM (SELECT f.event_id, min(f.ts_ms) AS ts_ms FROM kept k JOIN firsts f
          ON f.event_id = k.event_id AND f.ts_ms >= k.ts_ms + {RETENTION_MS['dedup']} GROUP BY f.event_id, k.ts_ms))"""]
    # Sequential rules, one event of every customer per step of the recursion.
    add("package_drawdown", [*deduped, f"""draws AS (
        SELECT customer_id, event_id, ts_ms, {TOTAL} AS total_tokens, row_number() OVER (PARTITION BY customer_id ORDER BY ts_ms, event_id) AS k
        FROM firsts JOIN kept USING (event_id, ts_ms) WHERE CAST(substr(customer_id, 6) AS INT) % 5 = 0)""", """steps AS (
        SELECT *, total_tokens <= 50000 AS accepted, 50000 - CASE WHEN total_tokens <= 50000 THEN total_tokens ELSE 0 END AS remaining_tokens FROM draws WHERE k = 1
        UNION ALL SELECT d.*, d.total_tokens <= s.remaining_tokens, s.remaining_tokens - CASE WHEN d.total_tokens <= s.remaining_tokens THEN d.total_tokens ELSE 0 END
        FROM steps s JOIN draws d ON d.customer_id = s.customer_id AND d.k = s.k + 1)"""],
        "SELECT customer_id, event_id, ts_ms, total_tokens, accepted, remaining_tokens FROM steps")
    add("tenant_packages", [*deduped, f"""draws AS (
        SELECT {CUST}, event_id, ts_ms, {TOTAL} AS total_tokens, 20000 + 10000 * CAST(substr(tenant_id, 2) AS BIGINT) AS size,
          row_number() OVER (PARTITION BY {CUST} ORDER BY ts_ms, event_id) AS k
        FROM firsts JOIN kept USING (event_id, ts_ms) WHERE CAST(substr(customer_id, 6) AS INT) % 3 = 0)""", """steps AS (
        SELECT *, total_tokens <= size AS accepted, size - CASE WHEN total_tokens <= size THEN total_tokens ELSE 0 END AS remaining_tokens FROM draws WHERE k = 1
        UNION ALL SELECT d.*, d.total_tokens <= s.remaining_tokens, s.remaining_tokens - CASE WHEN d.total_tokens <= s.remaining_tokens THEN d.total_tokens ELSE 0 END
        FROM steps s JOIN draws d ON d.tenant_id = s.tenant_id AND d.customer_id = s.customer_id AND d.k = s.k + 1)"""],
        f"SELECT {CUST}, event_id, ts_ms, total_tokens, accepted, remaining_tokens FROM steps")
    add("hold_ledger", [*ledger(), REQUESTS, f"""actions AS (
        SELECT {CUST}, parent_span_id, cost_micro AS amount, ts_ms, 'a|' || request_id AS action_id, CAST(NULL AS VARCHAR) AS reserve_id FROM requests
        UNION ALL SELECT {CUST}, parent_span_id, cost_micro, ts_ms + latency_ms * 3000000, 'b|' || request_id, 'a|' || request_id FROM requests),
      caps AS (SELECT parent_span_id, CAST(sum(cost_micro) AS BIGINT) * 3 // 4 AS cap FROM requests WHERE parent_span_id IS NOT NULL GROUP BY 1),
      acts AS MATERIALIZED (
        SELECT a.*, cap, coalesce(l.balance_micro, 0) AS balance, row_number() OVER (PARTITION BY a.tenant_id, a.customer_id ORDER BY a.ts_ms, action_id) AS k
        FROM actions a ASOF LEFT JOIN (
          SELECT {CUST}, ts_ms, balance_micro FROM ledger QUALIFY row_number() OVER (PARTITION BY {CUST}, ts_ms ORDER BY seq DESC, ref DESC) = 1) l
          ON a.tenant_id = l.tenant_id AND a.customer_id = l.customer_id AND a.ts_ms >= l.ts_ms
        LEFT JOIN caps ON caps.parent_span_id = a.parent_span_id)""", f"""held_steps AS (
        SELECT DISTINCT {CUST}, 0::BIGINT AS k, CAST(NULL AS VARCHAR) AS action_id, CAST(NULL AS VARCHAR) AS reason, 0::BIGINT AS held,
          CAST([] AS STRUCT(id VARCHAR, span VARCHAR, amount BIGINT)[]) AS opened FROM acts
        UNION ALL
        SELECT {CUST}, k, action_id, reason, held + CASE reason WHEN 'reserved' THEN amount WHEN 'released' THEN -amount ELSE 0 END,
          CASE reason WHEN 'reserved' THEN list_append(opened, {{'id': action_id, 'span': CASE WHEN cap IS NOT NULL THEN parent_span_id END, 'amount': amount}})
            WHEN 'released' THEN list_filter(opened, lambda o: o.id <> reserve_id) ELSE opened END
        FROM (
          SELECT a.*, s.held, s.opened, CASE
            WHEN a.reserve_id IS NOT NULL THEN CASE WHEN len(list_filter(s.opened, lambda o: o.id = a.reserve_id)) > 0 THEN 'released' ELSE 'not_reserved' END
            WHEN a.balance - s.held < a.amount THEN 'insufficient_balance'
            WHEN coalesce(coalesce(list_sum(list_transform(list_filter(s.opened, lambda o: o.span = a.parent_span_id), lambda o: o.amount)), 0) + a.amount > a.cap, FALSE)
              THEN 'hierarchy_reserve' ELSE 'reserved' END AS reason
          FROM held_steps s JOIN acts a ON a.tenant_id = s.tenant_id AND a.customer_id = s.customer_id AND a.k = s.k + 1))"""],
        f"SELECT {CUST}, action_id, reason IN ('reserved', 'released') AS accepted, held AS held_micro, reason FROM held_steps WHERE k > 0")
    add("warn_ladder", [*ledger(), f"""charged AS (
        SELECT *, balance_micro <= 0 AS spent_out, CASE WHEN initial_micro + topup_micro > 0 THEN
            least(100.0::DOUBLE, greatest(0, initial_micro + topup_micro - balance_micro) / CAST(initial_micro + topup_micro AS DOUBLE) * 100.0::DOUBLE) END AS spent_pct
        FROM (SELECT *, first_value(alert_threshold_micro) OVER (PARTITION BY {CUST}, epoch ORDER BY ts_ms, seq, ref ROWS UNBOUNDED PRECEDING) AS explicit FROM ledger)
        WHERE kind = 'cost'),
      tested AS (
        SELECT {CUST}, ts_ms, ref, balance_micro, spent_pct, rung,
          NOT spent_out AND coalesce(CASE WHEN rung = 100 THEN balance_micro <= explicit ELSE spent_pct >= rung END, FALSE) AS hit,
          row_number() OVER (PARTITION BY {CUST}, rung ORDER BY ts_ms, seq, ref) AS k
        FROM charged, (VALUES {', '.join(f'({p})' for p in (*WARN_PERCENTS, 100))}) r(rung)),
      ladder AS (
        SELECT *, hit AS warned, CASE WHEN hit THEN ts_ms END AS clock FROM tested WHERE k = 1
        UNION ALL SELECT t.*, t.hit AND (l.clock IS NULL OR t.ts_ms - l.clock >= {ALERT_TTL_MS}),
          CASE WHEN t.hit THEN CASE WHEN l.clock IS NULL OR t.ts_ms - l.clock >= {ALERT_TTL_MS} THEN t.ts_ms ELSE l.clock END END
        FROM ladder l JOIN tested t ON t.tenant_id = l.tenant_id AND t.customer_id = l.customer_id AND t.rung = l.rung AND t.k = l.k + 1)"""],
        f"""SELECT {CUST}, ts_ms, ref, rung, CASE WHEN rung = 100 THEN 'BUDGET_LOW' ELSE 'BUDGET_WARN' END AS alert, balance_micro, spent_pct FROM ladder WHERE warned
        UNION ALL SELECT {CUST}, ts_ms, ref, 0, 'BUDGET_EXHAUSTED', balance_micro, spent_pct FROM charged WHERE spent_out""")
    add("windows_applied_once", [*priced(), WINDOWS], f"SELECT {KEYS}, window_start_ms, cost_micro FROM windows WHERE window_start_ms >= {BUDGETS_RESET_MS}")
    add("upserted_spans", [*priced(), SPANS], """SELECT tenant_id, parent_span_id, CASE WHEN call_count > 3 THEN total_tokens ELSE 0 END AS total_tokens,
        cost_micro, CASE WHEN call_count > 3 THEN 2 ELSE 1 END AS version FROM spans""")

    # Usage
    every = f"{KEYS}, window_start_ms, {', '.join(TOKENS)}, total_tokens, cost_micro, event_count, total_latency_ms, duplicate_count, window_end_ms, avg_latency_ms"
    add("usage_windows", [*priced(source="retried"), WINDOWS], f"SELECT {every} FROM windows")
    add("merged_windows", [*priced(), WINDOWS], f"SELECT {every} FROM windows")
    add("usage_global", [*priced(), WINDOWS], f"""SELECT tenant_id, {', '.join(total(c, c) for c in ('total_tokens', 'input_tokens', 'output_tokens', 'event_count', 'cost_micro'))},
        max(window_end_ms) AS last_window_end_ms FROM windows GROUP BY tenant_id""")
    add("usage_by_customer", priced(), f"SELECT {CUST}, {ROLLUP} FROM priced GROUP BY {CUST}")
    add("usage_by_customer_model", priced(), f"SELECT {KEYS}, {ROLLUP} FROM priced GROUP BY {KEYS}")
    grains = {"minute": "%Y-%m-%d %H:%M", "day": "%Y-%m-%d", "month": "%Y-%m"}
    add("usage_rollup", priced(), " UNION ALL ".join(
        f"SELECT {CUST}, '{g}' AS grain, strftime(make_timestamp(ts_ms * 1000), '{f}') AS bucket, {ROLLUP} FROM priced GROUP BY {CUST}, bucket" for g, f in grains.items()))
    add("usage_rollup_window_end", priced(), " UNION ALL ".join(
        f"SELECT {CUST}, '{g}' AS grain, strftime(make_timestamp((window_start_ms + 10000) * 1000), '{grains[g]}') AS bucket, {ROLLUP} FROM priced GROUP BY {CUST}, bucket" for g in ("day", "month")))
    add("usage_by_customer_model_month", [*priced(), MODEL_MONTHS], "SELECT * FROM model_months")
    add("usage_by_session", priced(), f"""SELECT tenant_id, session_id, arg_max(customer_id, (ts_ms, customer_id)) AS customer_id, {ROLLUP}, max(ts_ms) AS last_ts_ms
        FROM priced GROUP BY tenant_id, session_id""")
    add("retained_sessions", priced(), f"SELECT session_id, max(ts_ms) AS last_ts_ms FROM priced GROUP BY tenant_id, session_id HAVING max(ts_ms) >= {BUDGETS_RESET_MS} - 90 * 86400000::BIGINT")
    add("usage_by_span", [*priced(), SPANS], "SELECT * FROM spans")
    add("span_sessions", clicks(), f"""SELECT parent_span_id, CAST(NULL AS VARCHAR) AS tenant_id, arg_max(customer_id, (ts_ms, customer_id)) AS customer_id,
        {', '.join(total(c, c) for c in ('total_tokens', 'input_tokens', 'output_tokens'))}, 0::BIGINT AS reasoning_tokens, {total('cost_micro', 'cost_micro')},
        count(*) AS call_count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, max(ts_ms) - min(ts_ms) AS duration_ms
        FROM (SELECT *, sum(opens) OVER (PARTITION BY parent_span_id ORDER BY ts_ms, n ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT *, (ts_ms - coalesce(lag(ts_ms) OVER (PARTITION BY parent_span_id ORDER BY ts_ms, n), -1e15) > 60000)::INT AS opens FROM priced_clicks))
        GROUP BY parent_span_id, session""")
    add("usage_by_dim", [*priced(), DIMS], "SELECT * FROM dims")
    add("usage_per_minute", [raw(), MINUTES], "SELECT * FROM minutes")
    add("minute_totals", [raw(), MINUTES], f"SELECT {total('total_tokens', 'total_tokens')}, {total('event_count', 'total_events')}, CAST(sum(cost_nano) AS DOUBLE) / 1e9 AS total_cost_usd FROM minutes")
    add("global_period_costs", [*priced(), MODEL_MONTHS], f"SELECT period, {total('cost_micro', 'cost_micro')} FROM model_months GROUP BY period")
    add("customer_period_costs", [*priced(), MODEL_MONTHS], f"SELECT period, customer_id, {total('cost_micro', 'cost_micro')} FROM model_months GROUP BY period, customer_id")
    add("model_period_costs", [*priced(), MODEL_MONTHS], f"SELECT period, model_id, {total('cost_micro', 'cost_micro')} FROM model_months WHERE period IN ('{PERIOD}', '{BASELINE}') GROUP BY period, model_id")
    add("late_event_costs", [*priced(), MODEL_MONTHS], f"SELECT period, model_id, {total('cost_micro', 'cost_micro')} FROM model_months WHERE period IN ('{PERIOD}', '{BASELINE}') GROUP BY period, model_id")
    add("global_daily_costs", priced(), f"SELECT {DAY} AS day, {total('cost_micro', 'cost_micro')} FROM priced GROUP BY 1")
    add("customer_daily_costs", priced(), f"SELECT {DAY} AS day, {CUST}, {total('cost_micro', 'cost_micro')} FROM priced WHERE period = '{PERIOD}' GROUP BY ALL")
    add("feature_cost_series", [*priced(), DIMS], f"SELECT period, dim_value, {total('cost_micro', 'cost_micro')} FROM dims WHERE dim_key = 'feature' AND period IN ('{BASELINE}', '{PERIOD}') GROUP BY ALL")
    add("tenant_plan_usage", priced(), f"""SELECT tenant_id, plan, total_events, total_tokens, total_cost_micro, events_this_month, customers, max_events_per_month, max_customers,
        max_events_per_month >= 0 AND events_this_month > max_events_per_month AS over_events, max_customers >= 0 AND customers > max_customers AS over_customers
        FROM (SELECT tenant_id, count(*) AS total_events, {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'total_cost_micro')},
          count(*) FILTER (period = '{PERIOD}') AS events_this_month, count(DISTINCT customer_id) AS customers,
          ['free', 'growth', 'scale', 'enterprise'][CAST(substr(tenant_id, 2) AS INT) % 4 + 1] AS plan FROM priced GROUP BY tenant_id)
        JOIN (VALUES ('free', 100000::BIGINT, 10::BIGINT), ('growth', 10000000, 1000), ('scale', 100000000, 10000), ('enterprise', -1, -1)) l(plan, max_events_per_month, max_customers) USING (plan)""")
    add("spend_by_key", priced(), f"""SELECT key_id, 'day' AS grain, {DAY} AS bucket, {total('cost_micro', 'cost_micro')} FROM priced WHERE cost_micro > 0 GROUP BY ALL
        UNION ALL SELECT key_id, 'month', period, {total('cost_micro', 'cost_micro')} FROM priced WHERE cost_micro > 0 GROUP BY ALL""")
    add("freshness", [*priced(), WINDOWS], f"SELECT newest_ms, ({NOW_MS} - newest_ms) // 1000 AS lag_seconds, ({NOW_MS} - newest_ms) // 1000 > 60 AS stalled FROM (SELECT max(window_end_ms) AS newest_ms FROM windows)")
    add("top_spans", [*priced(), SPANS], f"""SELECT {CUST}, row_number() OVER (PARTITION BY {CUST} ORDER BY cost_micro DESC, parent_span_id) AS rank, parent_span_id, cost_micro
        FROM spans QUALIFY rank <= 3""")
    for by, column in (("cost", "cost_micro"), ("tokens", "total_tokens")):
        add(f"top_customers_by_{by}", [*priced(), BY_CUSTOMER], f"SELECT {CUST}, cost_micro, total_tokens FROM by_customer ORDER BY {column} DESC, {CUST} LIMIT 10")
    add("live_series", priced(), f"""SELECT bucket_ms, event_count, cost_micro, CAST(sum(event_count) OVER (ORDER BY bucket_ms) AS BIGINT) AS running_events,
        CAST(sum(cost_micro) OVER (ORDER BY bucket_ms) AS BIGINT) AS running_cost_micro
        FROM (SELECT ts_ms - ts_ms % 60000 AS bucket_ms, count(*) AS event_count, {total('cost_micro', 'cost_micro')} FROM priced GROUP BY 1)""")

    # Budgets
    add("budget_ledger", ledger(), f"SELECT {CUST}, ts_ms, ref, kind, epoch, amount_micro, balance_micro, debt_micro, coalesce(balance_before_micro, 0) AS balance_before_micro, topup_micro, deducted_micro FROM ledger")
    alert = "CASE WHEN balance_micro <= 0 {first} THEN 'BUDGET_EXHAUSTED' WHEN balance_micro > 0 AND balance_micro <= threshold_micro AND balance_before_micro > threshold_micro THEN 'BUDGET_LOW' END"
    for n, first in (("budget_alerts", ""), ("first_budget_alerts", "AND balance_before_micro > 0")):
        add(n, ledger(), f"SELECT {CUST}, ts_ms, ref, model_id, {alert.format(first=first)} AS alert, amount_micro AS window_cost_micro, balance_micro FROM ledger WHERE kind = 'cost' AND {alert.format(first=first)} IS NOT NULL")
    add("budget_status", [*ledger(), BY_CUSTOMER], f"""SELECT {CUST}, balance_micro, 0::BIGINT AS held_micro, balance_micro AS effective_micro, debt_micro,
        coalesce(b.cost_micro, 0) AS spent_micro, balance_micro <= 0 AS exhausted FROM last_state LEFT JOIN by_customer b USING ({CUST})""")
    drift = f"""drifts AS (SELECT {CUST}, balance_micro, initial_micro + topup_micro - deducted_micro AS expected_micro, debt_micro,
        balance_micro - (initial_micro + topup_micro - deducted_micro) AS drift_micro,
        balance_micro - (initial_micro + topup_micro - deducted_micro) - debt_micro AS drift_net_of_debt_micro FROM last_state)"""
    add("balance_drifts", [*ledger(), drift], "SELECT * FROM drifts WHERE abs(drift_micro) > 10000")
    add("balance_drift_report", [*ledger(), drift], f"SELECT * FROM drifts WHERE abs(drift_micro) > 10000 ORDER BY {CUST} LIMIT 100")
    add("balance_drift_summary", [*ledger(), drift], "SELECT count(*) AS customers_scanned, count(*) FILTER (abs(drift_micro) > 10000) AS drift_count FROM drifts")
    add("rebuilt_balances", ledger(), f"SELECT {CUST}, balance_micro, debt_micro, deducted_micro FROM last_state WHERE tenant_id = 't1'")
    measures = ["input_tokens", "output_tokens", "total_tokens", "event_count", "cost_micro", "cache_read_tokens", "reasoning_tokens"]
    own, key = ["tenant_id", "customer_id"], ["tenant_id", "customer_id", "model_id"]
    rebuilt = {
        "usage_windows": ([*key, "window_start_ms", *TOKENS, "total_tokens", "cost_micro", "event_count", "total_latency_ms", "duplicate_count", "window_end_ms", "avg_latency_ms"], "SELECT * FROM windows"),
        "usage_global": (["tenant_id", *measures[:5], "last_window_end_ms"], f"""SELECT tenant_id, {', '.join(total(c, c) for c in measures[:5])}, max(window_end_ms) AS last_window_end_ms FROM windows GROUP BY tenant_id"""),
        "usage_by_customer": ([*own, *measures], "SELECT * FROM by_customer"),
        "usage_by_customer_model": ([*key, *measures], "SELECT * FROM by_customer_model"),
        "usage_by_customer_model_month": ([*key, "period", *measures[:5]], "SELECT * FROM model_months"),
        "usage_rollup": ([*own, "grain", "bucket", *measures], " UNION ALL ".join(
            f"SELECT {CUST}, '{g}' AS grain, strftime(make_timestamp(ts_ms * 1000), '{f}') AS bucket, {ROLLUP} FROM priced GROUP BY {CUST}, bucket" for g, f in grains.items())),
        "usage_by_session": (["tenant_id", "session_id", "customer_id", *measures, "last_ts_ms"], f"""SELECT tenant_id, session_id, arg_max(customer_id, (ts_ms, customer_id)) AS customer_id,
            {ROLLUP}, max(ts_ms) AS last_ts_ms FROM priced GROUP BY tenant_id, session_id"""),
        "span_usage": (["tenant_id", "parent_span_id", "customer_id", "total_tokens", "cost_micro", "call_count", "first_ts_ms", "last_ts_ms", "duration_ms"], "SELECT * FROM spans"),
        "usage_by_dim": (["tenant_id", "dim_key", "dim_value", "period", "cost_micro", "event_count"], "SELECT * FROM dims"),
        "spend_by_key": (["key_id", "grain", "bucket", "cost_micro"], f"""SELECT key_id, 'day' AS grain, {DAY} AS bucket, {total('cost_micro', 'cost_micro')} FROM priced WHERE cost_micro > 0 GROUP BY ALL
            UNION ALL SELECT key_id, 'month', period, {total('cost_micro', 'cost_micro')} FROM priced WHERE cost_micro > 0 GROUP BY ALL"""),
        "budget_ledger": ([*own, "ts_ms", "seq", "ref", "kind", "epoch", "amount_micro", "balance_micro", "debt_micro", "topup_micro", "deducted_micro"], "SELECT * FROM ledger"),
        "budget_state": ([*own, "balance_micro", "debt_micro", "topup_micro", "deducted_micro"], "SELECT * FROM last_state"),
        "budget_alerts": ([*own, "ts_ms", "ref", "model_id", "alert", "window_cost_micro", "balance_micro"], f"""SELECT {CUST}, ts_ms, ref, model_id, {alert.format(first='')} AS alert,
            amount_micro AS window_cost_micro, balance_micro FROM ledger WHERE kind = 'cost' AND {alert.format(first='')} IS NOT NULL"""),
    }
    add("rebuild_digests", [*ledger(), SPANS, MODEL_MONTHS, DIMS, BY_CUSTOMER, BY_CUSTOMER_MODEL, "digests AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, rows, CAST(digest AS VARCHAR) AS digest FROM ({digest(columns, rows)})" for name, (columns, rows) in rebuilt.items()) + ")"],
        "SELECT d.*, side FROM digests d, (VALUES ('kept'), ('rebuilt')) s(side)")
    month_columns = rebuilt["usage_by_customer_model_month"][0]
    add("rebuild_stale_tenants", [*priced(BUDGET_SCALE), MODEL_MONTHS, f"stale AS ({digest(month_columns, MODEL_MONTHS.split('AS (', 1)[1][:-1].replace('FROM priced', "FROM priced WHERE NOT (tenant_id IN ('t1', 't3') AND latency_ms % 5 = 0)"), 'tenant_id')})",
        f"whole AS ({digest(month_columns, 'SELECT * FROM model_months', 'tenant_id')})"],
        """SELECT tenant_id, w.rows - coalesce(s.rows, 0) AS rows_diff, CAST(w.digest - coalesce(s.digest, 0) AS VARCHAR) AS digest_diff FROM whole w LEFT JOIN stale s USING (tenant_id)
        WHERE w.rows <> coalesce(s.rows, 0) OR w.digest <> coalesce(s.digest, 0)""")
    seen = f"""seen AS (
      SELECT r.*, l.balance_micro FROM requests r ASOF LEFT JOIN (
        SELECT {CUST}, ts_ms, balance_micro FROM ledger QUALIFY row_number() OVER (PARTITION BY {CUST}, ts_ms ORDER BY seq DESC, ref DESC) = 1) l
      ON r.tenant_id = l.tenant_id AND r.customer_id = l.customer_id AND r.ts_ms >= l.ts_ms)"""
    add("asof_balances", [*ledger(), REQUESTS, seen], f"SELECT {CUST}, ts_ms, request_id, balance_micro FROM seen")
    over = lambda n: f"coalesce({n}.spent + r.cost_micro > {n}.cap, FALSE)"
    add("check_decisions", [
        *ledger(), REQUESTS, seen,
        spent("parent_span_id", "span", "sum(cost_micro) // 2"), spent("session_id", "sess", "max(cost_micro) * 4"),
        spent("key_id", "kday", "max(cost_micro) * 2", DAY), spent("key_id", "kmonth", "max(cost_micro) * 3", "period"), f"""gates AS (
      SELECT r.*, CASE WHEN balance_micro IS NULL THEN 'no_budget_configured' WHEN balance_micro <= 0 THEN 'budget_exhausted'
        WHEN r.cost_micro > 0 AND balance_micro < r.cost_micro THEN 'insufficient_balance'
        WHEN {over('span')} OR {over('sess')} THEN 'hierarchy_cap' WHEN {over('kday')} THEN 'api_key_daily_budget'
        WHEN {over('kmonth')} THEN 'api_key_monthly_budget' ELSE 'ok' END AS reason
      FROM seen r {on_request('span')} {on_request('sess')} {on_request('kday')} {on_request('kmonth')}),
    limited AS (
      SELECT *, coalesce(sum((reason IN ('ok', 'no_budget_configured'))::INT) OVER (PARTITION BY {CUST}, ts_ms // 60000 ORDER BY ts_ms, request_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM gates),
    final AS (
      SELECT * REPLACE (CASE WHEN b.customer_id IS NOT NULL AND used >= 1 THEN 'rate_limited' ELSE reason END AS reason)
      FROM (SELECT l.*, bb.customer_id AS limit_customer FROM limited l LEFT JOIN budgets bb USING ({CUST})) b)""".replace("b.customer_id IS NOT NULL", "limit_customer IS NOT NULL")],
        f"SELECT {CUST}, request_id, balance_micro, reason, reason IN ('ok', 'no_budget_configured') AS allowed FROM final")

    # Billing
    add("rerate_between", [*priced(), ADJUSTED.replace("FROM priced", f"FROM priced WHERE window_start_ms >= {BUDGETS_RESET_MS} AND window_start_ms + 10000 <= {RERATE_END_MS}")],
        f"SELECT {KEYS}, input_tokens, output_tokens, adjustment_micro FROM adjusted")
    add("rerate_preview", [*priced(), ADJUSTED], f"SELECT {KEYS}, input_tokens, output_tokens, adjustment_micro FROM adjusted ORDER BY adjustment_micro, {CUST} LIMIT 50")
    add("rerate_preview_totals", [*priced(), ADJUSTED], f"SELECT count(*) AS customers_affected, coalesce({total('adjustment_micro', 'x')[:-5]}, 0) AS total_adjustment_micro FROM adjusted")
    for n, keys in (("rerated_customers", CUST), ("rerated_tenants", "tenant_id")):
        add(n, [*priced(), ADJUSTED], f"""SELECT {keys}, {total('b.cost_micro + coalesce(adjustment_micro, 0)', 'cost_micro')}, {total('coalesce(adjustment_micro, 0)', 'adjustment_micro')}
            FROM by_model b LEFT JOIN (SELECT {KEYS}, adjustment_micro FROM adjusted) USING ({KEYS}) GROUP BY {keys}""")
    single = ADJUSTED.replace("FROM priced", f"FROM (SELECT * REPLACE ({', '.join(f'{c} // {BUDGET_SCALE} AS {c}' for c in ('input_tokens', 'output_tokens'))}) FROM priced)")
    add("rerated_balances", ledger(
        f"SELECT * FROM seeds UNION ALL SELECT * FROM charges UNION ALL SELECT {CUST}, {NOW_MS}, 2, 'rerate|' || model_id, 'rerate', adjustment_micro, NULL, model_id FROM adjusted",
        [*priced(BUDGET_SCALE), WINDOWS, SEEDS, CHARGES, single]), f"SELECT {CUST}, balance_micro, debt_micro FROM last_state")
    add("rerate_replay", [*tiered(), f"""replayed AS (
        SELECT {KEYS}, month AS period, {total('t.cost_micro', 'old_micro')}, {total(f"CASE WHEN model_id = 'gpt-4o-mini' THEN {FLAT_COST} ELSE t.cost_micro END", 'new_micro')}
        FROM (SELECT *, 0.11::DOUBLE AS pin, 0.5::DOUBLE AS pout, 0.1::DOUBLE AS pemb FROM stamped) JOIN tier_priced t USING (rid) GROUP BY {KEYS}, month)"""],
        "SELECT *, new_micro - old_micro AS delta_micro FROM replayed WHERE new_micro <> old_micro")
    add("billable_customers", [*priced(), CUSTOMER_USAGE, LINKS], "SELECT customer_id, cost_micro, stripe_id, metronome_id, orb_id FROM customer_usage JOIN links USING (customer_id)")
    add("linked_customers", [LINKS], "SELECT customer_id FROM links")
    add("export_deltas", export_delta_tables(), "SELECT * FROM deltas")
    sent = half_up("new_cost_micro / 10000::DOUBLE")
    add("export_marks", export_delta_tables(), f"""SELECT customer_id, {', '.join(f'coalesce(last_{m}, 0) AS last_{m}' for m in MEASURES[:3])},
        coalesce(last_cost_micro, 0) + coalesce(reported, 0) AS last_cost_micro
        FROM marks FULL JOIN (SELECT customer_id, {sent} * 10000 AS reported FROM deltas WHERE {sent} > 0) USING (customer_id)""")
    total_cents = half_up("cost_micro / 10000::DOUBLE")
    add("export_cycles", [*priced(), LINKS], f"""SELECT customer_id, platform, {total_cents} AS cents, TRUE AS keys_differ
        FROM (SELECT customer_id, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM priced WHERE ts_ms < {NOW_MS} GROUP BY customer_id)
        JOIN (SELECT customer_id, unnest([CASE WHEN stripe_id IS NOT NULL THEN 'stripe' END, CASE WHEN orb_id IS NOT NULL THEN 'orb' END]) AS platform FROM links) USING (customer_id)
        WHERE platform IS NOT NULL AND {total_cents} > 0""")
    key = lambda period, mode, suffix: f"'meter-' || customer_id || '-{period}-{mode}{suffix}'"
    row = lambda p, n, k, v, u, w: f"SELECT customer_id, '{p}' AS platform, {p}_id AS external_id, '{n}' AS name, {k} AS idempotency_key, {v} AS value, '{u}' AS unit FROM deltas WHERE {p}_id IS NOT NULL AND {w}"
    e = lambda suffix="": key("1998010100", "events", suffix)
    add("export_rows_events", export_delta_tables(), " UNION ALL ".join([
        row("stripe", "token_events_processed", e(), "new_event_count", "events", "new_event_count > 0"),
        *[row("metronome", "token_usage", e("-" + c), f"new_{c}", c, "(new_event_count > 0 OR new_input_tokens > 0)") for c in ("input_tokens", "output_tokens", "event_count")],
        row("orb", "token_usage", e("-input"), "new_input_tokens", "input", "new_input_tokens > 0"),
        row("orb", "token_usage", e("-output"), "new_output_tokens", "output", "new_output_tokens > 0")]))
    cents = half_up("new_cost_micro / 10000::DOUBLE")
    c = lambda suffix="": key("1998-01", "cost", suffix)
    add("export_rows_cost", export_delta_tables(), " UNION ALL ".join([
        row("stripe", "token_cost_usd_cents", c(), cents, "cents", f"{cents} > 0"),
        row("metronome", "token_usage", c(), f"{cents} * 10000", "micro_usd", f"{cents} > 0"),
        row("orb", "token_usage", c("-cost"), cents, "cents", f"{cents} > 0")]))
    add("due_exports", [], "SELECT * FROM (SELECT 'cust_' || (o_custkey % 200) AS target, strftime(max(o_orderdate), '%Y-%m') AS last_period FROM orders GROUP BY 1) WHERE last_period <> '2001-07'")
    add("usage_quantities", [*priced(), MODEL_MONTHS], f"SELECT customer_id, period, CAST(sum(total_tokens) AS BIGINT) / CAST(1e6 AS DOUBLE) AS quantity_m_tokens FROM model_months WHERE period = '{PERIOD}' GROUP BY 1, 2")
    add("usage_cloudevents", [*priced(), CUSTOMER_USAGE], f"SELECT customer_id, 'meter-' || customer_id || '-{PERIOD}' AS id, customer_id AS subject, total_tokens FROM customer_usage")
    add("external_gaps", priced(), f"""SELECT {CUST}, our_tokens, their_tokens, our_tokens - their_tokens AS gap_tokens FROM (
        SELECT {CUST}, {total('total_tokens', 'our_tokens')}, coalesce(CAST(sum(total_tokens) FILTER (environment = 'staging' OR cache_read_tokens = 0) AS BIGINT), 0) AS their_tokens
        FROM priced GROUP BY {CUST}) WHERE abs(our_tokens - their_tokens) > 10000""")

    # Intelligence
    add("root_cause", [*months(), contributors()], "SELECT * FROM contributors")
    add("root_cause_of_customer", [*months(), contributors("customer_id = 'cust_24'")], "SELECT * FROM contributors")
    add("root_cause_totals", [*months(), contributors()], "SELECT * FROM totals")
    add("root_cause_summary", [*months(), contributors(), SUMMARY], "SELECT summary FROM summary")
    add("unit_economics", [*months(), economics()], f"SELECT *, {UNIT_ADVICE} FROM economics")
    add("profitability_totals", [*months(), economics()], f"""SELECT revenue_usd, cost_usd, loss_customer_count, revenue_usd - cost_usd AS margin_usd,
        (revenue_usd - cost_usd) / nullif(revenue_usd, 0) * 100 AS margin_pct FROM (
        SELECT {exact_sum('revenue_usd')} AS revenue_usd, {exact_sum('cost_usd')} AS cost_usd, count(*) FILTER (status = 'loss') AS loss_customer_count FROM economics)""")
    add("profitability_products", [*months(), economics()], f"""SELECT product, period, cost_usd, revenue_usd, revenue_usd - cost_usd AS margin_usd,
        CASE WHEN revenue_usd > 0 THEN (revenue_usd - cost_usd) / revenue_usd * 100 END AS margin_pct FROM (
          SELECT dim_value AS product, period, {usd('cost_micro')} AS cost_usd,
            CASE WHEN earned <> 0 THEN earned * ({usd('cost_micro')} / whole) END AS revenue_usd
          FROM (SELECT dim_key, dim_value, period, {total('cost_micro', 'cost_micro')} FROM dims GROUP BY ALL), (SELECT {exact_sum('revenue_usd')} AS earned FROM economics),
            (SELECT {usd('CAST(sum(cost_micro) AS BIGINT)')} AS whole FROM dims WHERE dim_key = 'feature' AND period = '{PERIOD}')
          WHERE dim_key = 'feature' AND period = '{PERIOD}')""")
    add("profitability_trend", [*months()], f"""SELECT period, cost_usd, CASE WHEN earned > 0 THEN earned END AS revenue_usd,
        CASE WHEN earned > 0 THEN earned - cost_usd END AS margin_usd FROM (
          SELECT period, {usd('CAST(sum(cost_micro) AS BIGINT)')} AS cost_usd, {exact_sum('revenue_usd')} AS earned FROM (
            SELECT customer_id, period, sum(cost_micro) AS cost_micro FROM model_months WHERE period BETWEEN '1998-01' AND '{PERIOD}' GROUP BY 1, 2)
          LEFT JOIN revenue USING (customer_id, period) GROUP BY period)""")
    add("cheaper_models", [*priced(), BY_CUSTOMER_MODEL, cheaper("by_customer_model")], f"SELECT {KEYS}, from_cost_micro, to_model, to_cost_micro FROM best")
    add("pricing_recommendations", advice(), "SELECT * EXCLUDE (suggested_change) FROM advice")
    add("recommendation_texts", advice(), "SELECT * FROM advice")
    add("tenant_recommendations", advice(CUST), "SELECT * FROM advice")
    add("tenant_economics", [*months(), TENANT_REVENUE, economics(by=CUST, revenue="tenant_revenue")], f"SELECT *, {UNIT_ADVICE} FROM economics")
    add("top_recommendations", advice(), "SELECT customer_id, action, roi_annual_usd FROM advice ORDER BY coalesce(roi_annual_usd, 0) DESC, customer_id, action LIMIT 5")
    add("global_forecast", [*priced(BUDGET_SCALE), forecast("", ", (SELECT CAST(NULL AS DOUBLE) AS budget_usd)")],
        "SELECT *, printf('MTD $%.2f; forecast EOM $%.2f (no budget configured)', mtd_cost_usd, forecast_eom_cost_usd) AS summary FROM forecasts")
    add("customer_forecasts", [*priced(BUDGET_SCALE), SEEDS, CUSTOMER_FORECASTS], "SELECT * FROM forecasts")
    add("forecast_risk_alerts", [*priced(BUDGET_SCALE), SEEDS, CUSTOMER_FORECASTS], "SELECT 'INTEL_FORECAST_RISK' AS type, period, count(*) AS alerts FROM forecasts WHERE status IN ('at_risk', 'over_budget') GROUP BY period")
    add("margin_loss_alert", [*months(), economics(), economics(BASELINE, "earlier"), """fresh AS (
        SELECT customer_id FROM economics WHERE status = 'loss' AND customer_id NOT IN (SELECT customer_id FROM earlier WHERE status = 'loss'))"""],
        f"""SELECT 'INTEL_MARGIN_LOSS' AS type, '{PERIOD}' AS period, n || ' new unprofitable customer(s): ' ||
        (SELECT string_agg(customer_id, ', ' ORDER BY customer_id) FROM (SELECT * FROM fresh ORDER BY customer_id LIMIT 5)) ||
        CASE WHEN n > 5 THEN ' (+' || (n - 5) || ' more)' ELSE '' END AS summary, '{ADVICE_TEXT['INTEL_MARGIN_LOSS']}' AS recommendation
        FROM (SELECT count(*) AS n FROM fresh) WHERE n > 0""")
    add("cost_spike_alert", [*months(), contributors(), SUMMARY], f"""SELECT 'INTEL_COST_SPIKE' AS type, '{PERIOD}' AS period, summary, '{ADVICE_TEXT['INTEL_COST_SPIKE']}' AS recommendation
        FROM summary WHERE baseline_cost_usd > 0 AND delta_pct > -100""")
    add("debounced_alerts", [*months()], """SELECT DISTINCT 'INTEL_FORECAST_RISK' AS type, period FROM model_months
        WHERE NOT (period < '1998-01' AND CAST(substr(period, 6, 2) AS INT) * 10000000 < 86400000)""")
    add("report_headline", [*months(), contributors(), SUMMARY, economics()], f"""SELECT '{PERIOD}' AS period, '{BASELINE}' AS baseline_period,
        summary || CASE WHEN n > 0 THEN ' ' || n || ' customer(s) unprofitable.' ELSE '' END AS headline
        FROM summary, (SELECT count(*) AS n FROM economics WHERE status = 'loss')""")

    # Parts of the report
    for part, same in (("contributors", "root_cause"), ("profitability", "profitability_totals"), ("by_customer", "unit_economics"),
                       ("by_product", "profitability_products"), ("forecast", "global_forecast")):
        q[f"report_{part}"] = q[same]
    q["report_losses"] = q["unit_economics"] + " WHERE status = 'loss'"
    q["report_trend"] = q["profitability_trend"].replace("BETWEEN '1998-01'", "BETWEEN '1998-04'")
    add("report_root_cause", [*months(), contributors(), SUMMARY], "SELECT * FROM summary")
    add("report_recommendations", advice(), "SELECT * FROM advice ORDER BY coalesce(roi_annual_usd, 0) DESC, customer_id, action LIMIT 5")
    eom, left = money("forecast_eom_cost_usd"), money("budget_usd")
    told = f"""CASE status WHEN 'no_budget' THEN 'MTD $' || {money('mtd_cost_usd')} || '; forecast EOM $' || {eom} || ' (no budget configured)'
        WHEN 'over_budget' THEN 'Forecast EOM $' || {eom} || ' exceeds budget $' || {left} || ' by $' || {money('variance_usd')}
        WHEN 'at_risk' THEN 'Forecast EOM $' || {eom} || ' is at risk vs budget $' || {left} ELSE 'Forecast EOM $' || {eom} || ' on track vs budget $' || {left} END AS summary"""
    add("forecast_summaries", [*priced(BUDGET_SCALE), SEEDS, CUSTOMER_FORECASTS], f"SELECT {CUST}, status, {told} FROM forecasts")
    add("forecast_risk_texts", [*priced(BUDGET_SCALE), SEEDS, CUSTOMER_FORECASTS], f"""SELECT {CUST}, 'INTEL_FORECAST_RISK' AS type, period, {told}, '{ADVICE_TEXT['INTEL_FORECAST_RISK']}' AS recommendation
        FROM forecasts WHERE status IN ('at_risk', 'over_budget')""")
    add("cost_spike_customers", months(), f"""SELECT {CUST}, 'INTEL_COST_SPIKE' AS type, '{PERIOD}' AS period, printf('Cost %+.1f%% vs {BASELINE}.', pct) AS summary, '{ADVICE_TEXT['INTEL_COST_SPIKE']}' AS recommendation
        FROM (SELECT {CUST}, ({usd('(cur - base)')}) / ({usd('base')}) * 100 AS pct FROM (SELECT {CUST}, CAST(sum(CASE WHEN period = '{PERIOD}' THEN cost_micro ELSE 0 END) AS BIGINT) AS cur,
          CAST(sum(CASE WHEN period = '{BASELINE}' THEN cost_micro ELSE 0 END) AS BIGINT) AS base FROM model_months GROUP BY {CUST}) WHERE base > 0) WHERE pct > 25""")

    # Streams: rows the watermark has closed when the input ends
    add("stream_accepted_events", [CLICKS], "SELECT event_id, customer_id, raw_model AS model_id, input_tokens, output_tokens, 0::BIGINT AS reasoning_tokens, ts_ms, latency_ms FROM clicks WHERE n % 97 <> 0 AND n % 89 <> 0")
    add("stream_rejected_events", [], "SELECT CASE WHEN event_id % 97 = 0 THEN 'json' ELSE 'latency_ms' END AS errors, substr('{\"eventId\":\"ev-' || event_id || '\",\"customerId\":', 1, 20) AS head FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0")
    add("stream_kept_spans", clicks(), f"""SELECT tenant_id, parent_span_id, arg_max(customer_id, (ts_ms, customer_id)) AS customer_id, {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'cost_micro')},
        count(*) AS call_count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM priced_clicks GROUP BY tenant_id, parent_span_id""")
    add("stream_kept_minutes", clicks(), f"SELECT {CUST}, ts_ms - ts_ms % 60000 AS start_ms, count(*) AS event_count, {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'cost_micro')} FROM priced_clicks GROUP BY ALL")
    closed = "(SELECT max(ts_ms) - 5000 FROM clicks)"
    add("stream_windows", clicks(), f"""SELECT {KEYS}, start AS window_start_ms, start + 10000 AS window_end_ms, {', '.join(total(c, c) for c in ('input_tokens', 'output_tokens'))},
        0::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens, 0::BIGINT AS reasoning_tokens, 0::BIGINT AS embedding_tokens,
        {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'cost_micro')}, count(*) AS event_count, {total('latency_ms', 'total_latency_ms')},
        CAST(sum(latency_ms) AS BIGINT) / CAST(count(*) AS DOUBLE) AS avg_latency_ms
        FROM (SELECT *, ts_ms - ts_ms % 10000 AS start FROM priced_clicks) WHERE start + 10000 <= {closed} GROUP BY {KEYS}, start""")
    q["stream_span_sessions"] = q["span_sessions"] + f" HAVING max(ts_ms) + 60000 <= {closed}"
    order = "PARTITION BY customer_id, model_id, month ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    add("stream_volume_stamps", clicks(), f"SELECT event_id, customer_id, model_id, month, coalesce(CAST(sum(total_tokens) OVER ({order}) AS BIGINT), 0) AS volume_before FROM priced_clicks")
    arrival = "((length(event_id) + ascii(split_part(event_id, '-', 2))) % 4) * 100000000000000 - ts_ms"
    by_arrival = f"PARTITION BY {KEYS}, {MONTH} ORDER BY {arrival}, event_id, input_tokens, output_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    add("stream_month_volumes", [raw(TIER_SCALE), clean(TIERED)],
        f"SELECT event_id, {KEYS}, {MONTH} AS month, coalesce(CAST(sum({TOTAL}) OVER ({by_arrival}) AS BIGINT), 0) AS volume_before FROM clean")
    click_stamped = f"""stamped AS (
      SELECT *, n AS rid, {TOTAL} AS total_tokens, coalesce(CAST(sum({TOTAL}) OVER ({order}) AS BIGINT), 0) AS volume_before FROM (
        SELECT tenant_id, customer_id, {normalized('raw_model', TIERED)} AS model_id, n, ts_ms, {MONTH} AS month,
          input_tokens * 20000 AS input_tokens, output_tokens * 20000 AS output_tokens,
          {', '.join(f'0::BIGINT AS {c}' for c in TOKENS[2:])} FROM clicks))"""
    add("stream_tiered_windows", [CLICKS, TIER_ROWS, click_stamped, tier_cost("volume_before")],
        f"""SELECT {KEYS}, ts_ms - ts_ms % 10000 AS window_start_ms, count(*) AS event_count, {total('total_tokens', 'total_tokens')}, {total('cost_micro', 'cost_micro')}
        FROM stamped JOIN tier_priced USING (rid) WHERE ts_ms - ts_ms % 10000 + 10000 <= {closed} GROUP BY ALL""")
    q["stream_volume_batches"] = q["stream_volume_stamps"]
    click_rollup = f"{', '.join(total(c, c) for c in ('input_tokens', 'output_tokens', 'total_tokens'))}, count(*) AS event_count, {total('cost_micro', 'cost_micro')}, 0::BIGINT AS cache_read_tokens, 0::BIGINT AS reasoning_tokens"
    add("stream_rollup", clicks(), " UNION ALL ".join(
        f"SELECT {CUST}, '{g}' AS grain, strftime(make_timestamp(ts_ms * 1000), '{f}') AS bucket, {click_rollup} FROM priced_clicks GROUP BY {CUST}, bucket" for g, f in grains.items()))
    add("stream_landed_events", [CLICKS], f"SELECT event_id, customer_id, ts_ms, {DAY} AS day FROM clicks")
    add("stream_dedup", [CLICKS], "SELECT event_id, ts_ms FROM clicks")
    add("late_events", [CLICKS, LATE], "SELECT event_id, customer_id, ts_ms, arrival_ms FROM late")
    q["stream_late_events"] = q["late_events"]
    add("replayed_late_events", [CLICKS], f"SELECT customer_id, count(*) AS events, {total('input_tokens', 'input_tokens')} FROM clicks GROUP BY customer_id")

    def charged_budgets(charges, scale):
        """Balance, debt and alert after each charge of (customer_id, model_id, start, cost_micro)."""
        return [f"""charged AS (
        SELECT customer_id, start + 10000 AS ts_ms, model_id || '|' || start AS ref, CAST(sum(cost_micro) AS BIGINT) AS cost_micro
        FROM ({charges}) GROUP BY customer_id, model_id, start),
      moves AS (
        SELECT 'cust_' || c_custkey AS customer_id, 0::BIGINT AS ts_ms, 0 AS seq, 'first' AS ref, 'set' AS kind, CAST(floor(abs(c_acctbal) * {scale} + 0.5) AS BIGINT) AS amount_micro FROM customer
        UNION ALL SELECT customer_id, ts_ms, 3, ref, 'cost', cost_micro FROM charged WHERE customer_id IN (SELECT 'cust_' || c_custkey FROM customer)),
      summed AS (SELECT *, CAST(sum(CASE WHEN kind = 'set' THEN amount_micro ELSE -amount_micro END) OVER (PARTITION BY customer_id ORDER BY ts_ms, seq, ref ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s,
        max(CASE WHEN kind = 'set' THEN amount_micro END) OVER (PARTITION BY customer_id) * 0.1::DOUBLE AS threshold FROM moves),
      floored AS (SELECT *, greatest(0, -(min(s) OVER (PARTITION BY customer_id ORDER BY ts_ms, seq, ref ROWS UNBOUNDED PRECEDING))) AS debt_micro FROM summed),
      states AS (SELECT *, s + debt_micro AS balance_micro, lag(s + debt_micro) OVER (PARTITION BY customer_id ORDER BY ts_ms, seq, ref) AS before FROM floored)"""]

    budget_states = """SELECT CAST(NULL AS VARCHAR) AS tenant_id, customer_id, ts_ms, ref, kind, amount_micro, balance_micro, debt_micro,
        CASE WHEN kind = 'cost' AND balance_micro <= 0 THEN 'BUDGET_EXHAUSTED' WHEN kind = 'cost' AND balance_micro <= threshold AND before > threshold THEN 'BUDGET_LOW' END AS alert FROM states"""
    add("stream_budget", [*clicks(), *charged_budgets(f"SELECT *, ts_ms - ts_ms % 10000 AS start FROM priced_clicks WHERE ts_ms - ts_ms % 10000 + 10000 <= {closed}", 10)], budget_states)
    add("stream_metered_budgets", [CLICKS, TIER_ROWS, click_stamped, tier_cost("volume_before"), *charged_budgets(
        "SELECT customer_id, model_id, cost_micro, ts_ms - ts_ms % 10000 AS start FROM stamped JOIN tier_priced USING (rid)", 200_000)], budget_states)
    return q
