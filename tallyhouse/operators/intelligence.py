"""Cost intelligence: root cause, economics, advice, forecast and alerts.

All operators work on monthly or daily cost tables, which are small next to
the events: ``customer_costs(customer_id, period, cost_micro)``,
``model_costs(customer_id, model_id, period, cost_micro, input_tokens,
output_tokens)``, ``dim_costs(dim_key, dim_value, period, cost_micro)``,
``daily(day, cost_micro)`` and ``revenue(customer_id, period, revenue_usd)``.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.money import usd
from ..functions.periods import days_in_month, previous_period, trailing_periods
from ..functions.tables import known_table
from ..schema import DIMENSIONS
from ..sources.catalog import OPEN_END, Catalog, ModelPrice
from .cleaning import normalize_models

# Shown contributors and recommendations, margin goals, spike
# and risk thresholds, and the time between two alerts of one kind.
TOP_CONTRIBUTORS = 10
TOP_RECOMMENDATIONS = 5
TARGET_MARGIN = 0.30
LOW_MARGIN_PCT = 10
COST_SPIKE_PCT = 25
AT_RISK_SHARE = 0.85
ALERT_DEBOUNCE_MS = 86_400_000
ASSUMED_INPUT_TOKENS = 1_000_000
ASSUMED_OUTPUT_TOKENS = 500_000

# Advice texts.
ADVICE = {
    "loss": "Customer losing money — suggest plan upgrade or usage cap",
    "low_margin": "Low margin — review model mix or pricing",
    "unknown_revenue": "Connect revenue (OpenMeter overlay or POST /intelligence/revenue)",
    "connect_revenue": "Connect revenue via OpenMeter overlay or POST /intelligence/revenue",
    "INTEL_COST_SPIKE": "Review top contributors and consider model switch or pricing adjustment",
    "INTEL_MARGIN_LOSS": "Review unit economics and pricing recommendations",
    "INTEL_FORECAST_RISK": "Align spend with budget or raise limits",
}


def _share(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, 0 when the whole is 0."""
    return F.when(whole != 0, part / F.when(whole != 0, whole) * 100).otherwise(0.0)


def _two_periods(costs: DataFrame, keys: list[str], period: str, baseline: str) -> DataFrame:
    """Current and baseline cost per key in one pass over both months."""
    def cost_in(p):
        return F.sum(F.when(F.col("period") == p, F.col("cost_micro")).otherwise(0))

    return costs.filter(F.col("period").isin(period, baseline)).groupBy(*keys).agg(
        cost_in(period).alias("current_micro"), cost_in(baseline).alias("baseline_micro")
    )


def root_cause_totals(
    customer_costs: DataFrame, period: str, baseline: str, customer: str | None = None, keys: list[str] | None = None
) -> DataFrame:
    """One row, or one of each of ``keys``: total cost of both months, change in dollars and percent."""
    scoped = customer_costs if customer is None else customer_costs.filter(F.col("customer_id") == customer)
    totals = _two_periods(scoped, keys or [], period, baseline).select(
        *(keys or []),
        usd(F.coalesce("current_micro", F.lit(0))).alias("total_cost_usd"),
        usd(F.coalesce("baseline_micro", F.lit(0))).alias("baseline_cost_usd"),
        usd(F.coalesce(F.col("current_micro") - F.col("baseline_micro"), F.lit(0))).alias("delta_usd"),
    )
    return totals.withColumn("delta_pct", _share(F.col("delta_usd"), F.col("baseline_cost_usd")))


def root_cause(
    customer_costs: DataFrame,
    model_costs: DataFrame,
    dim_costs: DataFrame,
    period: str,
    baseline: str,
    customer: str | None = None,
    n: int = TOP_CONTRIBUTORS,
    dims: list[str] = DIMENSIONS,
) -> DataFrame:
    """The ``n`` largest cost changes by model, customer and dimension.

    ``customer`` scopes models and customers; dimensions are never scoped.
    """
    def scoped(df):
        return df if customer is None else df.filter(F.col("customer_id") == customer)

    def contributors(df, dimension, key):
        return _two_periods(df.withColumn("_key", F.col(key)), ["_key"], period, baseline).select(
            F.lit(dimension).alias("dimension"), F.col("_key").alias("key"), "current_micro", "baseline_micro"
        )

    positive = dim_costs.filter((F.col("cost_micro") > 0) & F.col("dim_key").isin(*dims))
    every = contributors(scoped(model_costs), "model", "model_id").unionByName(
        contributors(scoped(customer_costs), "customer", "customer_id")
    ).unionByName(
        _two_periods(positive, ["dim_key", "dim_value"], period, baseline).select(
            F.col("dim_key").alias("dimension"), F.col("dim_value").alias("key"), "current_micro", "baseline_micro"
        )
    )
    top = every.withColumn("_delta", F.col("current_micro") - F.col("baseline_micro")).orderBy(
        F.desc(F.abs("_delta")), "dimension", "key"
    ).limit(n)
    total = root_cause_totals(customer_costs, period, baseline, customer).select(
        "delta_usd"
    )
    delta = usd(F.col("_delta"))
    return top.withColumn("_total_delta", total.scalar()).select(
        "dimension", "key",
        usd(F.col("current_micro")).alias("current_cost_usd"),
        usd(F.col("baseline_micro")).alias("baseline_cost_usd"),
        delta.alias("delta_usd"),
        _share(delta, usd(F.col("baseline_micro"))).alias("delta_pct"),
        _share(delta, F.col("_total_delta")).alias("share_of_total_delta_pct"),
    )


def root_cause_summary(totals: DataFrame, contributors: DataFrame, baseline: str) -> DataFrame:
    """The one-row totals with the summary sentence."""
    top = contributors.orderBy(F.desc(F.abs("delta_usd")), "dimension", "key").limit(1).select(
        F.struct("dimension", "key", F.col("share_of_total_delta_pct").alias("share"))
    )
    head = F.format_string(f"Cost %+.1f%% vs {baseline}. ", F.col("delta_pct"))
    driver = F.format_string("Top driver: %s %s (%.0f%% of change).", "_top.dimension", "_top.key", "_top.share")
    return totals.withColumn("_top", top.scalar()).withColumn(
        "summary",
        F.concat(head, F.when(F.col("_top").isNull(), "No significant contributors.").otherwise(driver)),
    ).drop("_top")


def change_summary(totals: DataFrame, baseline: str) -> DataFrame:
    """Totals by key with the sentence of their change alone."""
    return totals.withColumn("summary", F.format_string(f"Cost %+.1f%% vs {baseline}.", "delta_pct"))


def unit_economics(
    customer_costs: DataFrame, revenue: DataFrame, period: str, keys: list[str] = ["customer_id"]
) -> DataFrame:
    """Revenue, cost and margin of each customer with cost in the month.

    ``keys`` name a customer in both tables: with ``CUSTOMER`` customers of two tenants with one name
    are two, and a customer without a tenant is its own.
    """
    costs = customer_costs.filter(F.col("period") == period).groupBy(*keys).agg(
        usd(F.sum("cost_micro")).alias("cost_usd")
    )
    known = revenue.filter(F.col("period") == period).select(*keys, "revenue_usd")
    rows = null_safe_join(costs, known, keys, "left").withColumn("margin_usd", F.col("revenue_usd") - F.col("cost_usd"))
    margin_pct = F.when(
        F.col("revenue_usd") > 0,
        F.col("margin_usd") / F.when(F.col("revenue_usd") > 0, F.col("revenue_usd")) * 100,
    )
    status = (
        F.when(F.col("revenue_usd").isNull(), "unknown_revenue")
        .when(F.col("margin_usd") < 0, "loss")
        .otherwise("profitable")
    )
    advice = (
        F.when(F.col("status") == "unknown_revenue", ADVICE["unknown_revenue"])
        .when(F.col("status") == "loss", ADVICE["loss"])
        .when(F.col("margin_pct") < LOW_MARGIN_PCT, ADVICE["low_margin"])
    )
    return (
        rows.withColumn("margin_pct", margin_pct)
        .withColumn("status", status)
        .withColumn("recommendation", advice)
        .select(
            *keys, F.lit(period).alias("period"), "revenue_usd", "cost_usd",
            "margin_usd", "margin_pct", "status", "recommendation",
        )
    )


def _exact_sum(dollars: str) -> Column:
    """Sum of dollars in whole hundred-millionths, the same in any order."""
    return F.sum(F.floor(F.col(dollars) * 1e8 + 0.5).cast("decimal(28,0)")).cast("double") / 1e8


def profitability_totals(economics: DataFrame) -> DataFrame:
    """One row: revenue, cost and margin of a month, and customers at a loss."""
    totals = economics.agg(
        _exact_sum("revenue_usd").alias("revenue_usd"),
        _exact_sum("cost_usd").alias("cost_usd"),
        F.count(F.when(F.col("status") == "loss", 1)).alias("loss_customer_count"),
    ).withColumn("margin_usd", F.col("revenue_usd") - F.col("cost_usd"))
    return totals.withColumn(
        "margin_pct", F.col("margin_usd") / F.when(F.col("revenue_usd") != 0, F.col("revenue_usd")) * 100
    )


def profitability_products(economics: DataFrame, dim_costs: DataFrame, period: str) -> DataFrame:
    """Revenue shared out to features by their part of the feature cost."""
    features = dim_costs.filter(
        (F.col("dim_key") == "feature") & (F.col("period") == period) & (F.col("cost_micro") > 0)
    )
    products = features.groupBy("dim_value").agg(F.sum("cost_micro").alias("cost_micro"))  # of all tenants
    rows = products.withColumns(
        {
            "_cost": features.agg(usd(F.sum("cost_micro"))).scalar(),
            "_revenue": economics.agg(_exact_sum("revenue_usd")).scalar(),
        }
    )
    cost = usd(F.col("cost_micro"))
    return (
        rows.select(
            F.col("dim_value").alias("product"), F.lit(period).alias("period"), cost.alias("cost_usd"),
            F.when(F.col("_revenue") != 0, F.col("_revenue") * (cost / F.col("_cost"))).alias("revenue_usd"),
        )
        .withColumn("margin_usd", F.col("revenue_usd") - F.col("cost_usd"))
        .withColumn(
            "margin_pct",
            F.when(
                F.col("revenue_usd") > 0,
                F.col("margin_usd") / F.when(F.col("revenue_usd") > 0, F.col("revenue_usd")) * 100,
            ),
        )
    )


def profitability_trend(
    customer_costs: DataFrame, revenue: DataFrame, period: str, months: int = 3
) -> DataFrame:
    """Cost, revenue and margin per month; revenue counts customers with cost that month."""
    periods = trailing_periods(period, max(1, min(months, 12)))
    costs = customer_costs.filter(F.col("period").isin(*periods)).groupBy("customer_id", "period").agg(
        F.sum("cost_micro").alias("cost_micro")
    )
    earned = revenue.select("customer_id", "period", "revenue_usd")
    found = costs.join(earned, ["customer_id", "period"], "left").groupBy("period").agg(
        usd(F.sum("cost_micro")).alias("cost_usd"), _exact_sum("revenue_usd").alias("_earned")
    )
    calendar = customer_costs.sparkSession.createDataFrame([(p,) for p in periods], "period string")
    revenue_usd = F.when(F.col("_earned") > 0, F.col("_earned"))
    return (
        calendar.join(found, "period", "left")
        .select("period", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), revenue_usd.alias("revenue_usd"))
        .withColumn("margin_usd", F.col("revenue_usd") - F.col("cost_usd"))
    )


def profitability(
    customer_costs: DataFrame, dim_costs: DataFrame, revenue: DataFrame, period: str, months: int = 3
) -> dict[str, DataFrame]:
    """The dashboard: totals, by_customer, by_product and trend."""
    economics = unit_economics(customer_costs, revenue, period)
    return {
        "totals": profitability_totals(economics),
        "by_customer": economics.orderBy(F.asc_nulls_first("margin_usd"), "customer_id"),
        "by_product": profitability_products(economics, dim_costs, period).orderBy(
            F.asc_nulls_last("margin_usd"), "product"
        ),
        "trend": profitability_trend(customer_costs, revenue, period, months).orderBy("period"),
    }


def cheaper_model(usage: DataFrame, catalog: Catalog) -> DataFrame:
    """The cheapest catalog model for each row's ``input_tokens``/``output_tokens``.

    Adds ``from_cost_micro``, and ``to_model, to_cost_micro`` where some other
    model is cheaper; of equally cheap ones the first listed. A row is priced on its own model, which is
    looked up by a join, and on the models that no earlier one undercuts everywhere (``cheapest_candidates``),
    as an array inside the row; nothing is multiplied out.
    """
    offers = F.array(*[
        F.struct(F.expr(_request_cost(m)).alias("cost"), F.lit(i).alias("i"), F.lit(m.model_id).alias("model"))
        for i, m in enumerate(cheapest_candidates(catalog))
    ])
    own_tiers = known_table(
        usage.sparkSession,
        [(name, [{"lo": lo, "hi": hi, "input": i, "output": o} for lo, hi, i, o in _billed_tiers(m)]) for name, m in catalog.models.items()],
        "_listed string, _tiers array<struct<lo:bigint,hi:bigint,input:double,output:double>>",
    )
    # The columns of the input stay as they are, names that normalising uses among them.
    named = normalize_models(usage.select(F.struct(*usage.columns).alias("_row"), "model_id"), catalog)
    found = named.select("_row.*", F.col("model_id").alias("_name")).join(own_tiers, F.col("_name") == F.col("_listed"), "left")
    own = _tiers_cost("0L", "input_tokens", "input") + _tiers_cost("input_tokens", "input_tokens + output_tokens", "output")
    priced = found.withColumns(
        {
            "from_cost_micro": F.when(F.col("_tiers").isNull(), F.expr(_request_cost(catalog.defaults))).otherwise(own),
            "_best": F.array_min(offers) if catalog.models else F.lit(None).cast("struct<cost:bigint,i:int,model:string>"),
        }
    )
    better = F.col("_best.cost") < F.col("from_cost_micro")
    return priced.withColumns(
        {
            "to_model": F.when(better, F.col("_best.model")),
            "to_cost_micro": F.when(better, F.col("_best.cost")),
        }
    ).drop("_name", "_listed", "_tiers", "_best")


def _billed_tiers(model: ModelPrice) -> list[tuple[int, int, float, float]]:
    """What a request from volume 0 pays; only graduated models reach beyond their first tier."""
    if model.mode != "graduated":
        return [(0, OPEN_END, model.tiers[0].input, model.tiers[0].output)]
    return [(t.lo, t.hi, t.input, t.output) for t in model.tiers]


def cheapest_candidates(catalog: Catalog) -> list[ModelPrice]:
    """Models that can be the cheapest for some request, in listed order.

    A model that is listed after one with the same tier bounds and no higher price in any tier and category
    never wins: each rounded part of its cost is as high or higher, and of equal costs the
    first listed wins. Models with other tier bounds are not compared. Of n models in any
    order few are left, so this takes n times few steps on the driver.
    """
    kept: dict[tuple, list[tuple[ModelPrice, list[float]]]] = {}
    for name, model in catalog.models.items():
        tiers = _billed_tiers(model)
        prices = [p for _, _, *both in tiers for p in both]
        rivals = kept.setdefault(tuple(t[:2] for t in tiers), [])
        if not any(all(r <= p for r, p in zip(theirs, prices)) for _, theirs in rivals):
            rivals.append((replace(model, model_id=name), prices))
    listed = {name: i for i, name in enumerate(catalog.models)}
    return sorted((m for rivals in kept.values() for m, _ in rivals), key=lambda m: listed[m.model_id])


def _tiers_cost(start: str, end: str, price: str) -> Column:
    """Cost of one category by the row's own ``_tiers``, rounded per tier."""
    return F.expr(
        f"aggregate(_tiers, 0L, (sum, t) -> sum + CAST(floor(greatest(0L, least({end}, t.hi) - greatest({start}, t.lo)) * t.{price} + 0.5D) AS BIGINT))"
    )


def _request_cost(model: ModelPrice) -> str:
    """SQL price of input then output tokens from volume 0.

    Only graduated models reach beyond their first tier.
    """
    if model.mode != "graduated":
        first = model.tiers[0]
        return " + ".join(
            f"CAST(floor({tokens} * {price!r}D + 0.5D) AS BIGINT)"
            for tokens, price in (("input_tokens", first.input), ("output_tokens", first.output))
        )
    parts = [("0L", "input_tokens", "input"), ("input_tokens", "input_tokens + output_tokens", "output")]
    return " + ".join(
        f"CAST(floor(greatest(0L, least({end}, {t.hi}L) - greatest({start}, {t.lo}L)) * {getattr(t, price)!r}D + 0.5D) AS BIGINT)"
        for start, end, price in parts for t in model.tiers
    )


def pricing_recommendations(
    economics: DataFrame, model_costs: DataFrame, catalog: Catalog, period: str, keys: list[str] = ["customer_id"]
) -> DataFrame:
    """Advice per customer: connect revenue, raise the price, or switch the dearest model.

    A thin margin alone is advised on only for customers without model rows. ``keys`` are those of ``economics``;
    with the tenant among them, advice is surer by what the tenant itself used in the month before.
    """
    prior = model_costs.filter(F.col("period") == previous_period(period))
    scope = [k for k in keys if k != "customer_id"]
    of_period = model_costs.filter(F.col("period") == period)
    dearest = of_period.groupBy(*keys, "model_id").agg(
        *[F.sum(c).alias(c) for c in ("cost_micro", "input_tokens", "output_tokens")]
    ).groupBy(*keys).agg(
        F.min_by(
            F.struct("model_id", "input_tokens", "output_tokens"),
            F.struct((-F.col("cost_micro")).alias("c"), "model_id"),
        ).alias("_m")
    ).select(
        *keys, "_m.model_id",
        F.greatest(F.coalesce("_m.input_tokens", F.lit(ASSUMED_INPUT_TOKENS)), F.lit(1)).alias("input_tokens"),
        F.greatest(F.coalesce("_m.output_tokens", F.lit(ASSUMED_OUTPUT_TOKENS)), F.lit(1)).alias("output_tokens"),
    )
    switch = cheaper_model(dearest, catalog)
    rows = null_safe_join(economics, switch, keys, "left")
    if scope:
        active = prior.select(*scope).distinct().withColumn("_active", F.lit(True))
        rows = null_safe_join(rows, active, scope, "left").withColumn("_has_prior", F.col("_active").isNotNull())
    else:
        rows = rows.withColumn("_has_prior", prior.agg(F.count("*") > 0).scalar())
    known = F.col("status") != "unknown_revenue"
    confidence = F.when(F.col("_has_prior") & known, "high").otherwise("medium")
    goal = F.col("cost_usd") / F.lit(1.0 - TARGET_MARGIN)
    raise_by = (goal - F.col("revenue_usd")) * 12
    from_usd, to_usd = usd(F.col("from_cost_micro")), usd(F.col("to_cost_micro"))
    saved = from_usd - to_usd

    def advice(when, action, change, roi, sure=confidence, margin=F.col("margin_pct")):
        return F.when(
            when,
            F.struct(
                F.lit(action).alias("action"), margin.alias("current_margin_pct"),
                change.alias("suggested_change"), roi.cast("double").alias("roi_annual_usd"),
                sure.alias("confidence"),
            ),
        )

    none = F.lit(None).cast("double")
    advised = F.array_compact(
        F.array(
            advice(~known, "connect_revenue", F.lit(ADVICE["connect_revenue"]), none, F.lit("medium"), none),
            advice(
                F.col("status") == "loss", "price_increase",
                F.format_string(
                    "Raise price to $%.2f/mo for 30%% margin (current $%.2f)", goal, F.col("revenue_usd")
                ),
                raise_by,
            ),
            advice(
                known & F.col("to_model").isNotNull(), "model_switch",
                F.format_string(
                    "Switch %s → %s: $%.2f/mo → $%.2f/mo ($%+.2f/mo)",
                    "model_id", "to_model", from_usd, to_usd, saved,
                ),
                saved * 12,
            ),
            advice(
                (F.col("status") == "profitable") & F.col("model_id").isNull()
                & (F.col("margin_pct") < LOW_MARGIN_PCT),
                "price_increase",
                F.format_string("Low margin — consider price increase to $%.2f/mo", goal),
                F.greatest(F.lit(0.0), raise_by),
            ),
        )
    )
    return rows.select(*keys, "period", F.explode(advised).alias("_a")).select(
        *keys, "period", "_a.*"
    )


def ranked_recommendations(recommendations: DataFrame, n: int | None = None) -> DataFrame:
    """By yearly gain, best first; ``n`` cuts the list."""
    ordered = recommendations.orderBy(
        F.desc(F.coalesce("roi_annual_usd", F.lit(0.0))), "customer_id", "action"
    )
    return ordered if n is None else ordered.limit(n)


def forecast(
    daily: DataFrame, period: str, today: str, keys: list[str] | None = None, budgets: DataFrame | None = None
) -> DataFrame:
    """Month-end cost at the average daily rate so far, against the budget.

    ``daily``: ``day, cost_micro`` and the scope ``keys`` (none for global), and ``period`` if it is
    stored by month, so that only this month is read.
    ``budgets`` has the keys and ``budget_usd``; a global forecast takes a
    one-row table. Elapsed days are the active days or the day of the month,
    whichever is more; a past month has elapsed whole.
    """
    keys = keys or []
    daily = daily.filter(F.col("period") == period) if "period" in daily.columns else daily
    now = date.fromisoformat(today)
    month = F.lit(period)
    total_days = days_in_month(month)
    calendar_day = F.lit(now.day) if today.startswith(period) else total_days
    of_month = daily.filter(F.col("day").startswith(period)).groupBy(*keys).agg(
        F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("_micro"), F.countDistinct("day").alias("_active")
    )
    elapsed = F.greatest(F.col("_active"), calendar_day, F.lit(1))
    base = of_month.withColumn("mtd_cost_usd", usd(F.col("_micro"))).withColumn("_elapsed", elapsed)
    remaining = F.greatest(total_days - F.col("_elapsed"), F.lit(0))
    base = base.withColumn(
        "forecast_eom_cost_usd",
        F.col("mtd_cost_usd") + F.col("mtd_cost_usd") / F.col("_elapsed") * remaining,
    )
    if budgets is None:
        base = base.withColumn("budget_usd", F.lit(None).cast("double"))
    elif keys:
        base = null_safe_join(base, budgets.select(*keys, "budget_usd"), keys, "left")
    else:
        base = base.withColumn("budget_usd", budgets.select("budget_usd").limit(1).scalar())
    eom, budget = F.col("forecast_eom_cost_usd"), F.col("budget_usd")
    status = (
        F.when(budget.isNull(), "no_budget").when(eom > budget, "over_budget")
        .when(eom > budget * AT_RISK_SHARE, "at_risk").otherwise("on_track")
    )
    summary = (
        F.when(
            F.col("status") == "no_budget",
            F.format_string("MTD $%.2f; forecast EOM $%.2f (no budget configured)", "mtd_cost_usd", eom),
        )
        .when(
            F.col("status") == "over_budget",
            F.format_string("Forecast EOM $%.2f exceeds budget $%.2f by $%.2f", eom, budget, eom - budget),
        )
        .when(
            F.col("status") == "at_risk",
            F.format_string("Forecast EOM $%.2f is at risk vs budget $%.2f", eom, budget),
        )
        .otherwise(F.format_string("Forecast EOM $%.2f on track vs budget $%.2f", eom, budget))
    )
    return (
        base.withColumn("variance_usd", eom - budget)
        .withColumn("status", status)
        .withColumn("summary", summary)
        .select(
            F.lit(period).alias("period"), *keys, "mtd_cost_usd", "forecast_eom_cost_usd",
            "budget_usd", "variance_usd", "status", "summary",
        )
    )


def _alert(df: DataFrame, kind: str, period: str, summary: Column, keys: list[str] | None = None) -> DataFrame:
    return df.select(
        *(keys or []), F.lit(kind).alias("type"), F.lit(period).alias("period"),
        summary.alias("summary"), F.lit(ADVICE[kind]).alias("recommendation"),
    )


def detect_cost_spike(
    summary: DataFrame, period: str, limit_pct: float = COST_SPIKE_PCT, keys: list[str] | None = None
) -> DataFrame:
    """An alert when cost rose by more than ``limit_pct`` over a positive baseline; one of each of ``keys``."""
    spiked = summary.filter((F.col("baseline_cost_usd") > 0) & (F.col("delta_pct") > limit_pct))
    return _alert(spiked, "INTEL_COST_SPIKE", period, F.col("summary"), keys)


def detect_margin_loss(
    economics: DataFrame, previous: DataFrame, period: str
) -> tuple[DataFrame, DataFrame]:
    """(alert, new snapshot): customers at a loss that were not in ``previous``."""
    losing = economics.filter(F.col("status") == "loss").select("customer_id")
    fresh = losing.join(previous.select("customer_id"), "customer_id", "left_anti")
    # Five names and a count, whatever the number of customers.
    names = fresh.orderBy("customer_id").limit(5).agg(F.sort_array(F.collect_list("customer_id")))
    found = fresh.agg(F.count("*").alias("_n")).withColumn("_names", names.scalar()).filter("_n > 0")
    text = F.concat(
        F.col("_n").cast("string"), F.lit(" new unprofitable customer(s): "), F.concat_ws(", ", "_names"),
        F.when(F.col("_n") > 5, F.format_string(" (+%d more)", F.col("_n") - 5)).otherwise(""),
    )
    return _alert(found, "INTEL_MARGIN_LOSS", period, text), losing


def detect_forecast_risk(forecasts: DataFrame, period: str, keys: list[str] | None = None) -> DataFrame:
    """An alert for each forecast near or over its budget, with its ``keys`` if they are named."""
    risky = forecasts.filter(F.col("status").isin("at_risk", "over_budget"))
    return _alert(risky, "INTEL_FORECAST_RISK", period, F.col("summary"), keys)


def debounce_alerts(alerts: DataFrame, sent: DataFrame, now_ms: int, ttl_ms: int = ALERT_DEBOUNCE_MS) -> DataFrame:
    """Alerts not sent for the same type and period within ``ttl_ms``."""
    recent = sent.filter(F.col("sent_ms") > F.lit(now_ms - ttl_ms)).select("type", "period")
    return alerts.join(recent, ["type", "period"], "left_anti")


def report(
    customer_costs: DataFrame,
    model_costs: DataFrame,
    dim_costs: DataFrame,
    daily: DataFrame,
    revenue: DataFrame,
    catalog: Catalog,
    period: str,
    today: str,
    baseline: str | None = None,
) -> dict[str, DataFrame]:
    """All parts of the monthly report over the shared cost tables."""
    baseline = baseline or previous_period(period)
    contributors = root_cause(customer_costs, model_costs, dim_costs, period, baseline)
    summary = root_cause_summary(
        root_cause_totals(customer_costs, period, baseline), contributors, baseline
    )
    economics = unit_economics(customer_costs, revenue, period)
    losing = economics.filter(F.col("status") == "loss")
    lost = losing.agg(F.count("*"))
    headline = summary.withColumn("_lost", lost.scalar()).select(
        F.lit(period).alias("period"), F.lit(baseline).alias("baseline_period"),
        F.concat(
            F.col("summary"),
            F.when(F.col("_lost") > 0, F.format_string(" %d customer(s) unprofitable.", "_lost")).otherwise(""),
        ).alias("headline"),
    )
    dashboard = profitability(customer_costs, dim_costs, revenue, period)
    advice = pricing_recommendations(economics, model_costs, catalog, period)
    return {
        "headline": headline,
        "root_cause": summary,
        "contributors": contributors,
        "loss_customers": losing,
        **{f"profitability_{k}": v for k, v in dashboard.items()},
        "top_recommendations": ranked_recommendations(advice, TOP_RECOMMENDATIONS),
        "forecast": forecast(daily, period, today),
    }
