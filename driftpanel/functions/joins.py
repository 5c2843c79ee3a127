"""Joins of tables that grow with the study."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_key(df: DataFrame) -> DataFrame:
    """Mark a table with rows per subject, order, or distinct value: its join shuffles both sides by the key.

    Such tables are compact as files, so Spark takes them for small and collects them at the driver to
    broadcast them; what arrives there is several times the file and grows with the data. Tables whose size the study sets (arms,
    periods, quotas, buckets) are broadcast by name instead.
    """
    return df.hint("merge")
