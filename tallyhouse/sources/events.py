"""Reading, decoding and landing usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import TOKEN_COLUMNS, USAGE_EVENTS, WIRE_NAMES

_WIRE_SCHEMA = T.StructType(
    [T.StructField(wire, USAGE_EVENTS[name].dataType) for name, wire in WIRE_NAMES.items()]
    + [T.StructField("_bad", T.StringType())]
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scan stored usage events (parquet, partitioned by ``day`` when landed here)."""
    return spark.read.parquet(path)


def read_events_stream(
    spark: SparkSession,
    path: str | None = None,
    source: str = "text",
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream raw JSON events as a ``value`` column.

    The default source is a folder of JSON-lines files; ``source="kafka"``
    takes broker options and its value bytes, where that connector is
    installed. Offsets live in the query's checkpoint.
    """
    reader = spark.readStream.format(source).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(path) if path is not None else reader.load()
    return stream.withColumn("value", F.col("value").cast("string"))


def parse_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Add the fields of each row's JSON event, and ``_broken`` where the text is none.

    Unknown fields are ignored and missing counts become 0.
    """
    parsed = df.withColumn(
        "_e",
        F.from_json(column, _WIRE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    broken = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    counts = set(TOKEN_COLUMNS) | {"latency_ms"}
    fields = [
        (F.coalesce(F.col(f"_e.{wire}"), F.lit(0)) if name in counts else F.col(f"_e.{wire}")).alias(name)
        for name, wire in WIRE_NAMES.items()
    ]
    return parsed.select(*df.columns, broken.alias("_broken"), *fields)


def decode_events(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decode JSON events: (events, rejected).

    Unknown fields are ignored and missing counts become 0. Text that is not
    a JSON event is rejected.
    """
    parsed = parse_events(df, column)
    return parsed.filter(~F.col("_broken")).drop("_broken", column), parsed.filter("_broken").select(*df.columns)


def encode_events(df: DataFrame) -> Column:
    """The JSON text of each event row, in the published field names."""
    return F.to_json(
        F.struct(*[F.col(n).alias(w) for n, w in WIRE_NAMES.items() if n in df.columns])
    )


# Where each provider's response keeps its usage counts.
USAGE_PATHS = {
    "openai": {
        "input_tokens": "$.usage.prompt_tokens",
        "output_tokens": "$.usage.completion_tokens",
        "cache_read_tokens": "$.usage.prompt_tokens_details.cached_tokens",
        "reasoning_tokens": "$.usage.completion_tokens_details.reasoning_tokens",
    },
    "anthropic": {
        "input_tokens": "$.usage.input_tokens",
        "output_tokens": "$.usage.output_tokens",
        "cache_read_tokens": "$.usage.cache_read_input_tokens",
        "cache_write_tokens": "$.usage.cache_creation_input_tokens",
    },
}

_PAYLOAD = """
    id string, model string, usage struct<
        prompt_tokens bigint, completion_tokens bigint,
        prompt_tokens_details struct<cached_tokens bigint>,
        completion_tokens_details struct<reasoning_tokens bigint>,
        input_tokens bigint, output_tokens bigint,
        cache_read_input_tokens bigint, cache_creation_input_tokens bigint>
"""


def _normalize(df: DataFrame, payload: str, shape: str) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json(payload, _PAYLOAD))
    paths = USAGE_PATHS[shape]
    counts = [
        F.coalesce(F.col("_p." + paths[c].removeprefix("$.")), F.lit(0)).alias(c)
        if c in paths else F.lit(0).cast("bigint").alias(c)
        for c in TOKEN_COLUMNS
    ]
    return parsed.select(
        *[c for c in df.columns if c != payload],
        F.col("_p.id").alias("request_id"), F.col("_p.model").alias("model_id"), *counts,
    )


def normalize_openai(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Usage counts of OpenAI-compatible responses (nine providers share the shape).

    Cached tokens stay part of the prompt count, as the providers report them.
    """
    return _normalize(df, payload, "openai")


def normalize_anthropic(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Usage counts of Anthropic-style responses, with cache reads and writes."""
    return _normalize(df, payload, "anthropic")


def land_events(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of events to a parquet table partitioned by UTC day."""
    return (
        stream.withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def import_revenue(df: DataFrame, period: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Revenue overlay: (revenue rows, counts of kept and ignored rows).

    ``df`` has ``subject, customer_id, value``; for one customer the last row
    by ``seq`` wins.
    """
    is_revenue = F.lower(F.coalesce("subject", F.lit(""))) == "revenue"
    kept = (
        df.filter(is_revenue)
        .groupBy("customer_id")
        .agg(F.max_by("value", seq).alias("revenue_usd"))
        .select(
            "customer_id", F.lit(period).alias("period"), "revenue_usd",
            F.lit("overlay").alias("source"),
        )
    )
    counts = df.agg(
        F.count(F.when(is_revenue, 1)).alias("revenue_rows"),
        F.count(F.when(~is_revenue, 1)).alias("ignored_rows"),
    )
    return kept, counts
