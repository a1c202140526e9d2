"""Scanning, masking and reporting as DataFrame projections; only the summary shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytesview import to_bytes_view
from ..functions.spans import CONFIDENCE, described, replaced
from .registry import Registry, build_registry

PROCESSED, SKIPPED, ERROR = "processed", "skipped", "error"


def _confidence(conf: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), conf.cast("int"))


def scan(df: DataFrame, text_col: str = "text", registry: Registry | None = None) -> DataFrame:
    """``df`` with ``view`` (the byte view) and ``merged`` (its findings).

    [ASSUMED] A null text has null findings; it counts as a text without any.
    """
    registry = registry or build_registry()
    return df.withColumn("view", to_bytes_view(F.col(text_col))).withColumn("merged", registry.detect_all(F.col("view")))


def findings(df: DataFrame, key_cols: list[str], text_col: str = "text", registry: Registry | None = None) -> DataFrame:
    """One row per finding: keys, pos, detector, category, start_byte, end_byte, confidence,
    masked_sample, line. Matched text isn't among them, and no text is copied to its findings."""
    registry = registry or build_registry()
    rows = scan(df.select(*key_cols, text_col), text_col, registry).filter(F.size("merged") > 0)
    rows = rows.select(*key_cols, F.posexplode(described(F.col(text_col), F.col("merged"))).alias("pos", "f"))
    return rows.select(
        *key_cols,
        F.col("pos").cast("long").alias("pos"),
        registry.name_of(F.col("f.det")).alias("detector"),
        registry.category_of(F.col("f.det")).alias("category"),
        F.col("f.start").cast("long").alias("start_byte"),
        F.col("f.end").cast("long").alias("end_byte"),
        _confidence(F.col("f.conf")).alias("confidence"),
        F.col("f.sample").alias("masked_sample"),
        F.col("f.line").cast("long").alias("line"),
    )


def raw_findings(df: DataFrame, key_cols: list[str], name: str, text_col: str = "text", place: int | None = None, **options) -> DataFrame:
    """What one detector finds before merging; ``place`` picks among detectors of one name."""
    found = [d for d in build_registry(allow=[name], **options).detectors]
    detector = found[place or 0]
    rows = df.select(*key_cols, to_bytes_view(F.col(text_col)).alias("view"))
    rows = rows.withColumn("found", detector.build(F.col("view"))).filter(F.size("found") > 0).select(*key_cols, F.explode("found").alias("f"))
    return rows.select(*key_cols, F.lit(detector.name).alias("detector"), F.lit(detector.category).alias("category"), F.col("f.start").cast("long").alias("start_byte"), F.col("f.end").cast("long").alias("end_byte"), _confidence(F.col("f.conf")).alias("confidence"))


#: Fixed value: what stands for a finding of a detector when no replacement is given.
MARKER = "[REDACTED:{}]"


def marker_of(registry: Registry, replacement: str | None):
    """The replacement of a finding: a fixed text for all, or one with the detector's name."""
    if replacement is not None:
        fixed = F.lit(replacement)
        return lambda f: fixed
    named = F.array(*[F.lit(MARKER.format(n)) for n in registry.names]) if registry.names else F.array(F.lit(""))
    return lambda f: F.get(named, f["det"])


def mask(df: DataFrame, text_col: str = "text", registry: Registry | None = None, replacement: str | None = None, out_col: str = "masked") -> DataFrame:
    """``df`` with the masked text and ``findings_count``; texts without findings pass unchanged."""
    registry = registry or build_registry()
    rows = scan(df, text_col, registry)
    masked = replaced(F.col(text_col), F.col("merged"), marker_of(registry, replacement))
    out = F.when(F.size("merged") > 0, masked).otherwise(F.col(text_col))
    return rows.withColumn(out_col, out).withColumn("findings_count", F.greatest(F.coalesce(F.size("merged"), F.lit(0)), F.lit(0)).cast("long")).drop("view", "merged")


def results(df: DataFrame, path_col: str, text_col: str = "text", registry: Registry | None = None, replacement: str | None = None) -> DataFrame:
    """One row per input: path, status, reason, findings_count, findings, masked.

    ``df`` may bring ``status`` and ``reason``; only processed rows are scanned.
    """
    registry = registry or build_registry()
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit(PROCESSED)).withColumn("reason", F.lit(None).cast("string"))
    text = F.when(F.col("status") == PROCESSED, F.col(text_col))
    rows = scan(df.withColumn("__text", text), "__text", registry)

    def report(f):
        return F.struct(registry.name_of(f["det"]).alias("detector"), registry.category_of(f["det"]).alias("category"), _confidence(f["conf"]).alias("confidence"), f["sample"].alias("masked_sample"), f["line"].alias("line"))

    masked = F.when(F.size("merged") > 0, replaced(F.col("__text"), F.col("merged"), marker_of(registry, replacement))).otherwise(F.col("__text"))
    some = F.coalesce(F.col("merged"), F.array().cast("array<struct<start:int,end:int,det:int,conf:tinyint>>"))
    return rows.withColumn("findings", F.transform(described(F.col("__text"), some), report)).withColumn("masked", masked).withColumn("findings_count", F.size(some).cast("long")).drop("view", "merged", "__text")


def findings_by_type(found: DataFrame, order_cols: list[str]) -> DataFrame:
    """(detector, n, position): counts, the greatest first, ties by first appearance in ``order_cols``."""
    first = F.min(F.struct(*order_cols))
    by = found.groupBy("detector").agg(F.count("*").alias("n"), first.alias("__first"))
    # one row for each detector is left, so the window that numbers them is small
    from pyspark.sql.window import Window

    w = Window.orderBy(F.desc("n"), "__first", "detector")
    return by.withColumn("position", F.row_number().over(w).cast("long")).select("detector", "n", "position")


def summary(res: DataFrame) -> DataFrame:
    """One row: files_processed, files_skipped, files_errored, total_findings."""
    return res.agg(
        F.count_if(F.col("status") == PROCESSED).alias("files_processed"),
        F.count_if(F.col("status") == SKIPPED).alias("files_skipped"),
        F.count_if(F.col("status") == ERROR).alias("files_errored"),
        F.coalesce(F.sum("findings_count"), F.lit(0)).cast("long").alias("total_findings"),
    )


def any_finding(res: DataFrame) -> bool:
    """The gate of fail-on-find; it stops at the first row with a finding."""
    return not res.filter(F.col("findings_count") > 0).isEmpty()


def json_rows(res: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, json): each result as one JSON object, reason only where there is one."""
    return res.select(F.col(path_col), F.to_json(F.struct(F.col(path_col).alias("path"), "status", "reason", "findings_count", "findings")).alias("json"))
