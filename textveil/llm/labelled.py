"""Bounded samples of labelled rows for the classifiers, chosen by hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col


def some_ids(ids: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those of smallest hashed id: a sample that any order of the
    input gives alike. Only ids and labels travel, never texts."""
    return ids.orderBy(F.xxhash64(F.lit(17), id_col), id_col).limit(most)


def labels_to_learn(labels: DataFrame, column: str, k: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of labels 0 and 1 outside the held-out fold; null ids and labels are left out,
    repeated rows collapse, and an id with both labels counts as 1."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(column).isin(0, 1) & (fold_col(F.col(id_col), k) != held))
    return rows.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(column).cast("int")).alias("__y"))


LONGEST = 200_000  # bytes of a text that a classifier is fitted on; longer ones are scored only


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, text) of the chosen ids whose text has ``LONGEST`` bytes at most. ``chosen`` is of the sample's bounded size, so it is broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.filter(F.coalesce(F.octet_length("__text"), F.lit(0)) <= LONGEST)
    return rows.join(F.broadcast(chosen), "__id").select("__y", "__text")
