"""Usage metering and cost analytics as PySpark DataFrame operators."""
