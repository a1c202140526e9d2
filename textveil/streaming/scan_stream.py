"""The scan over unbounded input (an extension): masking is a stateless projection, so a
stream takes the same plan as a table. Counts per detector are kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import Registry, build_registry
from ..operators.scan import findings, mask


def mask_stream(stream: DataFrame, text_col: str = "text", registry: Registry | None = None, replacement: str | None = None) -> DataFrame:
    return mask(stream, text_col, registry, replacement)


def counts_stream(stream: DataFrame, key_cols: list[str], text_col: str = "text", registry: Registry | None = None) -> DataFrame:
    """Findings per detector so far; the state is one row for each detector."""
    return findings(stream, key_cols, text_col, registry or build_registry()).groupBy("detector").agg(F.count("*").alias("n"))
