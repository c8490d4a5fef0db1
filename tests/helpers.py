"""Small event frames for tests."""

from tallyhouse.schema import TOKEN_COLUMNS, USAGE_EVENTS


def events(spark, rows):
    """Usage events from dicts; missing counts are 0, other fields null."""
    filled = [
        tuple(
            row.get(f.name, 0 if f.name in TOKEN_COLUMNS or f.name == "latency_ms" else None)
            for f in USAGE_EVENTS.fields
        )
        for row in rows
    ]
    return spark.createDataFrame(filled, USAGE_EVENTS)


def by(frame, *keys):
    """Rows of a frame as dicts, keyed."""
    return {tuple(r[k] for k in keys): r.asDict() for r in frame.collect()}
