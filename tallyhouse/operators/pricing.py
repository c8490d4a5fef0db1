"""Event prices in whole microdollars.

One dollar per million tokens is one microdollar per token, so a category
costs ``tokens * price`` rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import half_up
from ..functions.running import HOT_ROWS, Running, find_hot, running
from ..functions.tables import known_table
from ..schema import TOKEN_COLUMNS
from ..sources import price_lists as lists
from ..sources.catalog import OPEN_END, Catalog, ModelPrice
from .cleaning import normalized_model

# The order in which categories use up graduated volume, and
# the tier price each category pays.
CATEGORY_PRICE = {
    "input_tokens": "input",
    "output_tokens": "output",
    "cache_read_tokens": "cache",
    "reasoning_tokens": "output",
    "cache_write_tokens": "input",
    "embedding_tokens": "embed",
}


def _price_columns(catalog: Catalog):
    """(rows, default row, names, schema) of the catalog, one column per tier bound and price."""
    tier_count = catalog.tier_count

    def row(m: ModelPrice):
        cells = [m.model_id, m.mode]
        padded = list(m.tiers) + [None] * (tier_count - len(m.tiers))
        for t in padded:
            cells += [t.lo, t.hi, t.input, t.output, t.embed] if t else [OPEN_END, OPEN_END, 0.0, 0.0, 0.0]
        return tuple(cells)

    names = ["_model", "_mode"] + [
        f"_{part}{i}" for i in range(tier_count)
        for part in ("lo", "hi", "input", "output", "embed")
    ]
    types = ["string", "string"] + ["bigint", "bigint", "double", "double", "double"] * tier_count
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return [row(m) for m in catalog.models.values()], row(catalog.defaults), names, schema


def _at_tier(catalog: Catalog, tier: dict[str, Column]) -> Column:
    """Whole event at one tier; the cache price is a share of the input price."""
    cost = None
    for tokens, price in CATEGORY_PRICE.items():
        amount = (
            F.col(tokens) * tier["input"] * F.lit(catalog.cache_read_multiplier)
            if price == "cache" else F.col(tokens) * tier[price]
        )
        cost = half_up(amount) if cost is None else cost + half_up(amount)
    return cost


def _selected_tier(catalog: Catalog, volume: Column) -> dict[str, Column]:
    """Prices of the tier that holds ``volume``."""
    def pick(part):
        chosen = F.col(f"_{part}{catalog.tier_count - 1}")
        for i in reversed(range(catalog.tier_count - 1)):
            chosen = F.when(volume < F.col(f"_hi{i}"), F.col(f"_{part}{i}")).otherwise(chosen)
        return chosen

    return {part: pick(part) for part in ("input", "output", "embed")}


def _graduated(catalog: Catalog, volume: Column) -> Column:
    """Each category's tokens split over the tiers they fall into.

    The categories lie one after another from ``volume`` on; a tier's share of
    a category is the overlap of two intervals.
    """
    cost, start = F.lit(0).cast("bigint"), volume
    for tokens, price in CATEGORY_PRICE.items():
        end = start + F.col(tokens)
        for i in range(catalog.tier_count):
            overlap = F.greatest(
                F.lit(0), F.least(end, F.col(f"_hi{i}")) - F.greatest(start, F.col(f"_lo{i}"))
            )
            rate = (
                F.col(f"_input{i}") * F.lit(catalog.cache_read_multiplier)
                if price == "cache" else F.col(f"_{price}{i}")
            )
            cost = cost + half_up(overlap * rate)
        start = end
    return cost


def price_events(
    df: DataFrame, catalog: Catalog, volume: Column | int | str = 0, out: str = "cost_micro"
) -> DataFrame:
    """Add the event price ``out``; ``model_id`` must be a normalised name.

    ``volume`` is the month volume before the event (a column, or 0 for spans
    and what-ifs). Spark broadcasts the catalog if it is
    small; models it does not list pay the default price.
    """
    volume = F.col(volume) if isinstance(volume, str) else volume if isinstance(volume, Column) else F.lit(volume)
    rows, defaults, names, schema = _price_columns(catalog)
    prices = known_table(df.sparkSession, rows, schema)
    joined = df.join(prices, F.col("model_id") == F.col("_model"), "left")
    priced = joined.withColumns(
        {n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names[1:], defaults[1:])}
    )
    cost = _at_tier(catalog, _selected_tier(catalog, volume))
    if catalog.uses("graduated") or catalog.defaults.mode == "graduated":
        cost = F.when(F.col("_mode") == "graduated", _graduated(catalog, volume)).otherwise(cost)
    return priced.withColumn(out, cost).drop(*names)


def _request(df: DataFrame, **tokens: Column) -> DataFrame:
    """Rows shaped like events, for pricing something that has not happened."""
    return df.withColumns(
        {c: tokens.get(c, F.lit(0)).cast("bigint") for c in TOKEN_COLUMNS}
    )


# Tokens assumed for a request that does not say.
ESTIMATE_INPUT_TOKENS = 512
ESTIMATE_OUTPUT_TOKENS = 1024


def estimate_requests(df: DataFrame, catalog: Catalog, model: str = "model_id", max_tokens: str = "max_tokens") -> DataFrame:
    """Add ``estimate_micro``: the price of a request before it is sent, at least one micro."""
    shaped = _request(
        df.withColumn("model_id", normalized_model(F.col(model), catalog)),
        input_tokens=F.lit(ESTIMATE_INPUT_TOKENS),
        output_tokens=F.when(F.col(max_tokens) > 0, F.col(max_tokens)).otherwise(ESTIMATE_OUTPUT_TOKENS),
    )
    return (
        price_events(shaped, catalog, out="estimate_micro")
        .withColumn("estimate_micro", F.greatest(F.col("estimate_micro"), F.lit(1)))
        .drop(*TOKEN_COLUMNS)
    )


def stream_kill_points(chunks: DataFrame, catalog: Catalog, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First chunk of each stream whose estimated cost exceeds its hold.

    ``chunks``: ``stream_id, chunk_no, model_id, content, usage_input,
    usage_output, reserved_micro``. Content adds a quarter of its length to
    the output count; a reported usage replaces the counts. A stream without
    a hold is never stopped. Output: one row per stopped stream.
    """
    estimate = F.when(
        F.coalesce(F.length("content"), F.lit(0)) > 0,
        F.greatest(F.lit(1), F.floor(F.length("content") / 4)),
    ).otherwise(0).cast("bigint")
    hot = find_hot(chunks, ["stream_id"], hot_rows)
    counted = running(
        chunks.withColumn("_estimate", estimate),
        ["stream_id"],
        ["chunk_no"],
        {
            "_all": Running("sum", "_estimate"),
            "_input": Running("last", "usage_input"),
        },
        hot,
    )
    # Output so far: the last reported count plus what was estimated since.
    marked = counted.withColumn("_mark", F.when(F.col("usage_output").isNotNull(), F.struct("usage_output", "_all")))
    marked = running(
        marked, ["stream_id"], ["chunk_no"], {"_seen": Running("last", "_mark")}, hot
    )
    tokens = marked.select(
        "stream_id", "chunk_no", "model_id", "reserved_micro",
        F.coalesce("_input", F.lit(0)).alias("input_tokens"),
        (
            F.col("_all") - F.coalesce("_seen._all", F.lit(0))
            + F.coalesce("_seen.usage_output", F.lit(0))
        ).alias("output_tokens"),
    )
    prices = _first_tier_prices(df=chunks, catalog=catalog)
    priced = (
        tokens.withColumn("_name", normalized_model(F.col("model_id"), catalog))
        .join(prices, F.col("_name") == F.col("_model"), "left")
        .withColumn(
            "estimate_micro",
            F.col("input_tokens") * F.coalesce("_in", F.lit(catalog.defaults.tiers[0].input))
            + F.col("output_tokens") * F.coalesce("_out", F.lit(catalog.defaults.tiers[0].output)),
        )
    )
    over = (F.col("reserved_micro") > 0) & (F.col("estimate_micro") > F.col("reserved_micro"))
    facts = F.struct("chunk_no", "input_tokens", "output_tokens", "estimate_micro", "reserved_micro")
    return (
        priced.filter(over)
        .groupBy("stream_id")
        .agg(F.min_by(facts, "chunk_no").alias("_kill"))
        .select("stream_id", "_kill.*")
    )


def _first_tier_prices(df: DataFrame, catalog: Catalog) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(m.model_id, m.tiers[0].input, m.tiers[0].output) for m in catalog.models.values()],
        "_model string, _in double, _out double",
    )


def heartbeat_deltas(chunks: DataFrame, interval_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Output tokens newly seen in each interval of a stream.

    ``chunks``: ``stream_id, chunk_ms, output_tokens`` with cumulative counts.
    Intervals without growth since the last report are left out.
    """
    bucket = F.col("chunk_ms") - F.pmod(F.col("chunk_ms"), F.lit(interval_ms))
    ends = (
        chunks.groupBy("stream_id", bucket.alias("interval_ms"))
        .agg(F.max_by("output_tokens", "chunk_ms").alias("output_tokens"))
    )
    # A report moves the mark only upward, so the mark is a running maximum.
    marked = running(
        ends, ["stream_id"], ["interval_ms"],
        {"_mark": Running("max", "output_tokens", inclusive=False)}, hot_rows,
    )
    return (
        marked.withColumn(
            "delta_tokens",
            F.col("output_tokens") - F.greatest(F.lit(0), F.coalesce("_mark", F.lit(0))),
        )
        .filter(F.col("delta_tokens") > 0)
        .select("stream_id", "interval_ms", "delta_tokens")
    )


def model_cost_usd(df: DataFrame, catalog: Catalog, model: str, out: str) -> DataFrame:
    """Add the dollar cost of ``input_tokens``/``output_tokens`` on a model."""
    kept = df.columns
    shaped = _request(
        df.withColumnsRenamed({c: f"_keep_{c}" for c in kept})
        .withColumn("model_id", normalized_model(F.col(f"_keep_{model}"), catalog)),
        input_tokens=F.col("_keep_input_tokens"),
        output_tokens=F.col("_keep_output_tokens"),
    )
    priced = price_events(shaped, catalog, out="_cost")
    return priced.select(*[F.col(f"_keep_{c}").alias(c) for c in kept], (F.col("_cost") / 1e6).alias(out))


def simulate_model_switch(scenarios: DataFrame, catalog: Catalog) -> DataFrame:
    """What a model switch saves in a year.

    ``scenarios``: ``input_tokens, output_tokens, from_model, to_model,
    monthly_occurrences`` plus any other columns.
    """
    both = model_cost_usd(
        model_cost_usd(scenarios, catalog, "from_model", "from_cost_usd"), catalog, "to_model", "to_cost_usd"
    )
    saved = F.col("from_cost_usd") - F.col("to_cost_usd")
    return both.withColumns(
        {
            "annual_savings_usd": saved * 12 * F.col("monthly_occurrences"),
            "notes": F.format_string(
                "Switch %s → %s: $%.2f/mo → $%.2f/mo ($%+.2f/mo)",
                "from_model", "to_model", "from_cost_usd", "to_cost_usd", saved,
            ),
        }
    )


def simulate_prompt_reduction(scenarios: DataFrame) -> DataFrame:
    """What shorter prompts save: input is taken as half of the cost."""
    monthly = F.col("cost_usd") * (F.col("input_reduction_pct") / F.lit(100.0)) * F.lit(0.5)
    return scenarios.withColumns(
        {
            "annual_savings_usd": monthly * 12,
            "notes": F.format_string(
                "Reduce input tokens by %.0f%% → ~$%.2f/mo saved", "input_reduction_pct", monthly
            ),
        }
    )


def simulate_token_grant(scenarios: DataFrame) -> DataFrame:
    """What a free token grant earns through extra sign-ups."""
    per_token = F.when(F.col("grant_tokens") > 0, F.col("cost_usd") / F.col("grant_tokens")).otherwise(0.0)
    customers = F.col("customer_count") * (F.col("signup_lift_pct") / F.lit(100.0))
    grant = (F.col("grant_tokens") * per_token) * customers
    return scenarios.withColumns(
        {
            "annual_profit_delta_usd": (customers * F.col("avg_revenue_per_customer_usd") - grant) * 12,
            "notes": F.format_string(
                "+%.0f new customers @ $%.2f/mo revenue; grant cost $%.2f/mo",
                customers, "avg_revenue_per_customer_usd", grant,
            ),
        }
    )


def _case(model: Column, table: dict, default: int) -> Column:
    value = None
    for name, price in table.items():
        value = F.when(model == name, price) if value is None else value.when(model == name, price)
    return value.otherwise(default)


def price_events_baseline(df: DataFrame) -> DataFrame:
    """Add ``cost_nano`` under the store-then-query price rule.

    Exact model names only; no cache-write or embedding cost. Whole
    nanodollars keep the sums exact.
    """
    model = F.col("model_id")
    input_price = _case(model, {k: v[0] for k, v in lists.BASELINE_PRICES.items()}, lists.BASELINE_DEFAULT[0])
    output_price = _case(model, {k: v[1] for k, v in lists.BASELINE_PRICES.items()}, lists.BASELINE_DEFAULT[1])
    reasoning = _case(model, lists.BASELINE_REASONING, lists.BASELINE_REASONING_DEFAULT)
    cached = _case(model, lists.BASELINE_CACHE_READ, lists.BASELINE_CACHE_READ_DEFAULT)
    return df.withColumn(
        "cost_nano",
        F.col("input_tokens") * input_price + F.col("output_tokens") * output_price
        + F.col("reasoning_tokens") * reasoning + F.col("cache_read_tokens") * cached,
    )
