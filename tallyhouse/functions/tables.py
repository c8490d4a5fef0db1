"""Tables made from rows that the driver holds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def known_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Rows as a table of known size, so that Spark broadcasts it by its own choice, and only if it is small.

    A table made from a list of rows has no known size, and joins with it shuffle the other side.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows) if rows else ((),) * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields))
