"""Usage events and dimension tables derived from the supplied parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Model names by ``key % 10``; two match by prefix and one has no price.
MODEL_NAMES = [
    "gpt-4o-2024-08-06", "gpt-4o-mini", "claude-sonnet-4", "claude-opus-4-20250514", "o1",
    "o3-mini", "gemini-1.5-pro", "deepseek-v4-flash", "text-embedding-3-small", "custom-llm",
]


def model_name(key: str) -> str:
    names = ", ".join(f"'{m}'" for m in MODEL_NAMES)
    return f"element_at(array({names}), cast({key} % 10 as int) + 1)"


def provider_name(key: str) -> str:
    return (
        f"CASE WHEN {key} % 10 IN (2, 3) THEN 'anthropic' WHEN {key} % 10 = 6 THEN 'google' "
        f"WHEN {key} % 10 = 7 THEN 'deepseek' WHEN {key} % 10 = 9 THEN 'custom' ELSE 'openai' END"
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def usage_events(spark: SparkSession, folder: str, scale: int = 1) -> DataFrame:
    """Multi-year usage events: one per line item, ``scale`` multiplies the tokens."""
    line = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # Orders meet their customers first, so that line items are shuffled once at most.
    owners = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = line.join(owners, line.l_orderkey == owners.o_orderkey)
    q = f"CAST(l_quantity AS BIGINT) * {scale}"
    return joined.selectExpr(
        "concat_ws('-', 'li', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS event_id",
        "concat('t', CAST(c_nationkey % 5 AS STRING)) AS tenant_id",
        "concat('cust_', CAST(o_custkey % 200 AS STRING)) AS customer_id",
        "CAST(NULL AS STRING) AS request_id",
        "CAST(NULL AS STRING) AS span_id",
        "IF(l_orderkey % 10 = 0, concat('span_', CAST(l_orderkey AS STRING)), NULL) AS parent_span_id",
        f"{provider_name('l_partkey')} AS provider",
        f"{model_name('l_partkey')} AS model_id",
        f"{q} * 137 AS input_tokens",
        f"{q} * (10 + l_linenumber) AS output_tokens",
        f"IF(l_partkey % 4 = 0, {q} * 31, 0L) AS cache_read_tokens",
        f"IF(l_suppkey % 6 = 0, {q} * 7, 0L) AS cache_write_tokens",
        f"IF(l_returnflag = 'R', {q} * 55, 0L) AS reasoning_tokens",
        f"IF(l_partkey % 10 = 8, {q} * 90, 0L) AS embedding_tokens",
        "unix_millis(CAST(l_shipdate AS TIMESTAMP)) + ((l_partkey * 7919 + l_linenumber * 104729"
        " + l_suppkey * 31) % 86400) * 1000 AS ts_ms",
        "l_partkey % 2000 AS latency_ms",
        "concat('sess_', CAST(l_orderkey % 5000 AS STRING)) AS session_id",
        "IF(l_linestatus = 'F', 'production', 'staging') AS environment",
        "IF(l_linenumber = 7,"
        " map('feature', c_mktsegment, 'room_id', CAST(l_suppkey % 50 AS STRING), '_heartbeat', 'true'),"
        " map('feature', c_mktsegment, 'room_id', CAST(l_suppkey % 50 AS STRING))) AS metadata",
        "concat('key_', CAST(o_custkey % 400 AS STRING)) AS key_id",
    )


def click_usage(events: DataFrame) -> DataFrame:
    """Short-range usage events from the ``events`` table, batch or stream."""
    return events.selectExpr(
        "concat_ws('-', 'ev', CAST(event_id AS STRING)) AS event_id",
        "CAST(NULL AS STRING) AS tenant_id",
        "concat('cust_', CAST(user_id AS STRING)) AS customer_id",
        "concat('span_', CAST(event_id DIV 20 AS STRING)) AS parent_span_id",
        f"{provider_name('event_id')} AS provider",
        f"{model_name('event_id')} AS model_id",
        "CAST(floor(value * 100) AS BIGINT) AS input_tokens",
        "CAST(floor(value * 10) AS BIGINT) AS output_tokens",
        "0L AS cache_read_tokens", "0L AS cache_write_tokens",
        "0L AS reasoning_tokens", "0L AS embedding_tokens",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms",
        "event_id % 500 AS latency_ms",
        "unix_millis(CAST(ts AS TIMESTAMP)) + IF(event_id % 7 = 0, 3600000L, 0L) AS arrival_ms",
        "event_id AS arrival_seq",
        "0 AS source_partition",
    )


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly revenue per customer; customers 0 to 19 have none recorded."""
    return (
        table(spark, folder, "orders")
        .filter("o_custkey % 200 >= 20")
        .selectExpr(
            "concat('cust_', CAST(o_custkey % 200 AS STRING)) AS customer_id",
            "date_format(CAST(o_orderdate AS TIMESTAMP), 'yyyy-MM') AS period",
            "CAST(floor(o_totalprice * 100 + 0.5D) AS BIGINT) AS cents",
        )
        .groupBy("customer_id", "period")
        .agg(F.sum("cents").alias("cents"))
        .selectExpr("customer_id", "period", "cents / 1e8D AS revenue_usd", "'orders' AS source")
    )


def tenant_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly revenue per tenant and customer, as ``revenue`` gives it per customer."""
    orders = table(spark, folder, "orders").filter("o_custkey % 200 >= 20")
    owners = table(spark, folder, "customer").selectExpr("c_custkey AS o_custkey", "concat('t', CAST(c_nationkey % 5 AS STRING)) AS tenant_id")
    return (
        orders.join(owners, "o_custkey")
        .selectExpr(
            "tenant_id", "concat('cust_', CAST(o_custkey % 200 AS STRING)) AS customer_id",
            "date_format(CAST(o_orderdate AS TIMESTAMP), 'yyyy-MM') AS period",
            "CAST(floor(o_totalprice * 100 + 0.5D) AS BIGINT) AS cents",
        )
        .groupBy("tenant_id", "customer_id", "period")
        .agg(F.sum("cents").alias("cents"))
        .selectExpr("tenant_id", "customer_id", "period", "cents / 1e8D AS revenue_usd")
    )



def budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Initial balance per (tenant, customer); odd customers name a threshold."""
    return (
        table(spark, folder, "customer")
        .selectExpr(
            "concat('t', CAST(c_nationkey % 5 AS STRING)) AS tenant_id",
            "concat('cust_', CAST(c_custkey % 200 AS STRING)) AS customer_id",
            "c_custkey % 2 = 1 AS odd",
            "CAST(floor(c_acctbal * 100 + 0.5D) AS BIGINT) AS cents",
        )
        .groupBy("tenant_id", "customer_id")
        .agg(F.sum("cents").alias("cents"), F.max("odd").alias("odd"))
        .selectExpr(
            "tenant_id", "customer_id",
            # a hundredth of the account balance, in micro-dollars
            "greatest(0L, cents) * 100L AS initial_micro",
            "IF(odd, greatest(0L, cents) * 20L, NULL) AS alert_threshold_micro",
        )
    )


def topups(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").filter("o_orderpriority LIKE '1-%'")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
        "concat('t', CAST(c_nationkey % 5 AS STRING)) AS tenant_id",
        "concat('cust_', CAST(o_custkey % 200 AS STRING)) AS customer_id",
        "unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS ts_ms",
        "CAST(floor(o_totalprice * 10 + 0.5D) AS BIGINT) AS amount_micro",
        "concat('order-', CAST(o_orderkey AS STRING)) AS ref",
    )


def billing_links(spark: SparkSession, folder: str) -> DataFrame:
    """External billing ids: every third customer has one, every sixth two."""
    ids = table(spark, folder, "customer").selectExpr("c_custkey % 200 AS n").distinct()
    return ids.filter("n % 3 = 0").selectExpr(
        "concat('cust_', CAST(n AS STRING)) AS customer_id",
        "stack(3, 'stripe', IF(n % 9 != 3, concat('cus_', CAST(n AS STRING)), NULL),"
        " 'metronome', IF(n % 6 = 0, concat('mtr_', CAST(n AS STRING)), NULL),"
        " 'orb', IF(n % 9 = 3, concat('orb_', CAST(n AS STRING)), NULL)) AS (platform, external_id)",
    ).filter("external_id IS NOT NULL")


def stream_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed replies: assistant turns are chunks, every fourth reports usage."""
    return (
        table(spark, folder, "conversations")
        .filter("role = 'assistant'")
        .selectExpr(
            "concat('conv_', CAST(conv_id AS STRING)) AS stream_id",
            "turn AS chunk_no",
            f"{model_name('conv_id')} AS model_id",
            "text AS content",
            "IF(turn % 4 = 3, CAST(length(text) AS BIGINT) * 2, NULL) AS usage_input",
            "IF(turn % 4 = 3, CAST(length(text) AS BIGINT), NULL) AS usage_output",
            "conv_id * 1000 + turn * 700 AS chunk_ms",
            "IF(conv_id % 3 = 0, 0L, 400L + conv_id % 50 * 20) AS reserved_micro",
        )
    )
