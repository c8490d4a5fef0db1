"""Month-to-date token volume before each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import billing_month
from ..functions.running import HOT_ROWS, Running, find_hot, running
from ..schema import CUSTOMER_MODEL, TOKEN_COLUMNS
from .cleaning import total_tokens

VOLUME_ORDER = ["ts_ms", "event_id", *TOKEN_COLUMNS]


def stamp_volume(
    df: DataFrame, hot_rows: int = HOT_ROWS, sizes_from: DataFrame | None = None
) -> DataFrame:
    """Add ``volume_before``: tokens of the same customer, model and UTC month so far.

    ``sizes_from`` may be the events before deduplication, which are cheaper to
    count. Order is event time, then event id; rows that tie in both and in their
    tokens are interchangeable.
    """
    def keyed(frame):
        return frame.withColumn("month", billing_month(F.col("ts_ms")))

    keys = [*CUSTOMER_MODEL, "month"]
    hot = find_hot(keyed(df if sizes_from is None else sizes_from), keys, hot_rows)
    return running(
        keyed(df), keys, VOLUME_ORDER,
        {"volume_before": Running("sum", total_tokens(), inclusive=False)}, hot,
    ).withColumn("volume_before", F.coalesce("volume_before", F.lit(0)))
