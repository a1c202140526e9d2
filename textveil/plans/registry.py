"""Registered queries of the scanner and their DuckDB SQL, one for each operator."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import is_binary
from ..operators import scan
from ..operators.registry import build_registry
from ..sources.files import judge
from . import oracle
from .planted import planted, planted_sql

PII_NAMES = ("EMAIL", "PHONE", "IP", "CREDIT_CARD", "SSN")
#: query -> (pattern, the same as a regex, its window in SQL, what SQL asks of a place first)
PATTERNS = {
    "custom_pattern": ('token = "\\w+"', 'token = "[0-9A-Za-z_]+"', 4096, "true"),
    "custom_any_byte": ("card .... .", "card [^\\n]{4} [^\\n]", 11, "true"),
    "custom_class": ("id [A-Z][^a-z, ]*", "id [A-Z][^a-z, ]*", 4100, "true"),
    "custom_optional": ("^xoxb?-[0-9]+-\\d\\d\\d-$", "xoxb?-[0-9]+-[0-9][0-9][0-9]-", 60, "true"),
    "custom_negated": ("host\\s\\D?\\d+\\.\\d*\\W", "host[ \\t\\n\\f\\r][^0-9]?[0-9]+[.][0-9]*[^0-9A-Za-z_]", 60, "true"),
    "custom_pipe": ("a|b", "a[|]b", 3, "true"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir) -> DataFrame:
    """All documents, each whole and with a made-up value added."""
    return _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))


def detect(spark, sf_dir, name: str, place: int = 0) -> DataFrame:
    return scan.raw_findings(_documents(spark, sf_dir), ["doc_id"], name, "text", place)


def detect_in_pages(spark, sf_dir, name: str, text: str) -> DataFrame:
    return scan.raw_findings(_table(spark, sf_dir, "pages"), ["page_id"], name, text)


def detect_merged(spark, sf_dir, **lists) -> DataFrame:
    return scan.findings(_documents(spark, sf_dir), ["doc_id"], "text", build_registry(**lists))


def custom_pattern(spark, sf_dir, name: str, pattern: str) -> DataFrame:
    found = scan.findings(_documents(spark, sf_dir), ["doc_id"], "text", build_registry(allow=["NONE"], patterns=[(name, pattern)]))
    return found.select("doc_id", "detector", "category", "start_byte", "end_byte", "confidence")


def mask_text(spark, sf_dir, replacement: str | None = None, **lists) -> DataFrame:
    return scan.mask(_documents(spark, sf_dir), "text", build_registry(**lists), replacement).select("doc_id", "masked", "findings_count")


def _results(spark, sf_dir, **lists) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text")
    return scan.results(docs, "path", "text", build_registry(**lists))


def findings_by_type(spark, sf_dir, **lists) -> DataFrame:
    return scan.findings_by_type(detect_merged(spark, sf_dir, **lists), ["doc_id", "pos"])


def scan_summary(spark, sf_dir) -> DataFrame:
    return scan.summary(_results(spark, sf_dir))


def report_json(spark, sf_dir) -> DataFrame:
    return scan.json_rows(_results(spark, sf_dir))


def binary_check(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("\0")).otherwise(F.lit("")))
    return docs.select("doc_id", is_binary(F.encode(F.col("text"), "UTF-8")).alias("plain"), is_binary(F.encode(F.left(bad, F.lit(1 << 30)), "UTF-8")).alias("with_nul"))


READ_LIMIT = 5000  # bytes of a content in the reading queries


def read_contents(spark, sf_dir, mode: str) -> DataFrame:
    """Documents as files' contents, some led by a byte that no UTF-8 text has or by a NUL,
    some too large, read in one of the modes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lead = F.when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 4 == 2, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    contents = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("relative"), F.concat(lead, F.encode("text", "UTF-8")).alias("content"), F.lit(None).cast("string").alias("error"))
    return judge(contents, mode, READ_LIMIT).select("path", "text", "status", "reason")


def clean_documents(spark, sf_dir) -> DataFrame:
    """Documents without a finding of any detector, as they are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan.mask(docs, "text", build_registry()).filter("findings_count = 0").select("doc_id")


_DETECTORS = {
    "email": ("EMAIL", 0), "phone": ("PHONE", 0), "ipv4": ("IP", 0), "ipv6": ("IP", 1), "credit_card": ("CREDIT_CARD", 0), "ssn": ("SSN", 0), "path": ("PATH", 0),
    "aws_key": ("AWS_KEY", 0), "bearer_token": ("BEARER_TOKEN", 0), "jwt": ("JWT", 0), "private_key": ("PRIVATE_KEY", 0), "api_key": ("API_KEY", 0), "database_url": ("DATABASE_URL", 0), "password": ("PASSWORD", 0),
    "webhook_secret": ("WEBHOOK_SECRET", 0), "slack_token": ("SLACK_TOKEN", 0), "github_token": ("GITHUB_TOKEN", 0), "stripe_key": ("STRIPE_KEY", 0), "generic_secret": ("GENERIC_SECRET", 0),
}

QUERIES: dict = {f"detect_{k}": partial(detect, name=n, place=i) for k, (n, i) in _DETECTORS.items()}
QUERIES |= {
    "detect_path_urls": partial(detect_in_pages, name="PATH", text="url"),
    "detect_all_merged": detect_merged,
    "detect_pii_merged": partial(detect_merged, allow=PII_NAMES),
    "allow_list": partial(detect_merged, allow=("EMAIL", "IP", "no such name")),
    "deny_list": partial(detect_merged, allow=PII_NAMES, deny=("PHONE", "SSN")),
    **{k: partial(custom_pattern, name=k.upper(), pattern=p) for k, (p, *_) in PATTERNS.items()},
    "mask_text": mask_text,
    "mask_text_custom_replacement": partial(mask_text, replacement="<é$1\\>"),
    "findings_by_type": findings_by_type,
    "findings_by_type_pii": partial(findings_by_type, allow=PII_NAMES),
    "mask_text_pii": partial(mask_text, allow=PII_NAMES),
    "scan_summary": scan_summary,
    "report_json": report_json,
    "is_binary": binary_check,
    "clean_documents": clean_documents,
    "read_strict": partial(read_contents, mode="skip"),
    "read_failing_on_binary": partial(read_contents, mode="fail"),
    "read_best_effort": partial(read_contents, mode="best-effort"),
}

_DOCS = planted_sql()


def _custom_sql(name: str, window: int, regex: str, first: str) -> str:
    """Findings of a pattern none of whose matches overlap: places where a window matches and that begin a run."""
    cands = oracle.candidates(_DOCS, "doc_id", "text", regex.replace("'", "''"), window, regex, first, conf="1")
    return f"WITH r AS ({cands}) " + oracle._findings(_DOCS, "doc_id", "text", name, "custom")


ORACLE_SQL: dict[str, str] = {f"detect_{k}": oracle.detector_sql(k, _DOCS, "doc_id", "text") for k in _DETECTORS}
ORACLE_SQL |= {k: _custom_sql(k.upper(), w, regex, first) for k, (_, regex, w, first) in PATTERNS.items()}
ORACLE_SQL |= {
    "detect_path_urls": oracle.detector_sql("path", "pages", "page_id", "url"),
    "detect_pii_merged": oracle.merged_sql(source=_DOCS),
    "allow_list": oracle.merged_sql(("email", "ipv4", "ipv6"), _DOCS),
    "deny_list": oracle.merged_sql(("email", "ipv4", "ipv6", "credit_card"), _DOCS),
    "mask_text": oracle.mask_sql(names=oracle.ALL, source=_DOCS),
    "mask_text_pii": oracle.mask_sql(source=_DOCS),
    "mask_text_custom_replacement": oracle.mask_sql("<é$1\\>", oracle.ALL, _DOCS),
    "detect_all_merged": oracle.merged_sql(oracle.ALL, _DOCS),
    "findings_by_type": oracle.by_type_sql(oracle.ALL, _DOCS),
    "findings_by_type_pii": oracle.by_type_sql(source=_DOCS),
    "scan_summary": oracle.merged_ctes(oracle.ALL, _DOCS) + " SELECT (SELECT count(*) FROM documents) AS files_processed, CAST(0 AS BIGINT) AS files_skipped, CAST(0 AS BIGINT) AS files_errored, (SELECT count(*) FROM f) AS total_findings",
    "report_json": oracle.json_sql(oracle.ALL, _DOCS),
    "is_binary": "SELECT doc_id, octet_length(encode(text)) - octet_length(encode(regexp_replace(text, '[\\x01-\\x06\\x0e-\\x1a\\x1c-\\x1f]', '', 'g'))) > 0.3 * greatest(least(strlen(text), 8192), 1) AS plain, doc_id % 3 = 0 AND strlen(text) < 8192 AS with_nul FROM documents",
    "read_strict": oracle.reading_sql(READ_LIMIT, "skipped"),
    "read_failing_on_binary": oracle.reading_sql(READ_LIMIT, "error"),
    "read_best_effort": oracle.reading_sql(READ_LIMIT, None),
    "clean_documents": oracle.merged_ctes(oracle.ALL) + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT k FROM f)",
}
