"""Canonical table schemas."""

from pyspark.sql import types as T

TOKEN_COLUMNS = [
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "reasoning_tokens",
    "embedding_tokens",
]

USAGE_EVENTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "event_id", "tenant_id", "customer_id", "request_id", "span_id",
        "parent_span_id", "provider", "model_id",
    )]
    + [T.StructField(c, T.LongType()) for c in TOKEN_COLUMNS]
    + [
        T.StructField("ts_ms", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("key_id", T.StringType()),
    ]
)

# Field names of the published JSON event, in schema order.
WIRE_NAMES = {
    "event_id": "eventId",
    "tenant_id": "tenantId",
    "customer_id": "customerId",
    "request_id": "requestId",
    "span_id": "spanId",
    "parent_span_id": "parentSpanId",
    "provider": "provider",
    "model_id": "modelId",
    "input_tokens": "inputTokens",
    "output_tokens": "outputTokens",
    "cache_read_tokens": "cacheReadTokens",
    "cache_write_tokens": "cacheWriteTokens",
    "reasoning_tokens": "reasoningTokens",
    "embedding_tokens": "embeddingTokens",
    "ts_ms": "timestamp",
    "latency_ms": "latencyMs",
    "session_id": "sessionId",
    "environment": "environment",
    "metadata": "metadata",
}

# Deployment environments the event schema allows.
ENVIRONMENTS = ["production", "staging", "development"]

# Metadata keys counted as dimensions, and the most keys allowed.
DIMENSIONS = ["room_id", "feature"]
MAX_METADATA_KEYS = 8

CUSTOMER = ["tenant_id", "customer_id"]
CUSTOMER_MODEL = ["tenant_id", "customer_id", "model_id"]
