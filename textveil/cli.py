"""Command line: ``python -m textveil.cli [OPTIONS]``, run by spark-submit or alone.

Exit codes: 0 success, 1 operational error, 2 usage error, 3 findings with --fail-on-find.
"""

from __future__ import annotations

import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .config import BINARY_MODES, ScanConfig
from .errors import FINDINGS, OK, ConfigError, DetectionError, ScanError, UsageError
from .operators import scan
from .operators.registry import Registry, build_registry
from .sources import files, sinks

VERSION = "0.1.0"
# Names, choices and defaults of the options.
FLAGS = {"--in-place": ("in_place", True), "--recursive": ("recursive", True), "--report-json": ("report_json", True), "--dry-run": ("dry_run", True), "--fail-on-find": ("fail_on_find", True), "--summary": ("summary", True), "--include-hidden": ("include_hidden", True), "--no-follow-symlinks": ("follow_symlinks", False), "--follow-symlinks": ("follow_symlinks", True)}
VALUES = {"--text": "text", "--input": "input", "--output": "output", "--config": "config", "--replacement": "replacement"}
CHOICES = {"--format": ("format", ("text", "json")), "--binary": ("binary", BINARY_MODES)}
NUMBERS = {"--max-file-size": "max_file_size", "--threads": "threads"}
REPEATED = {"--allow-pattern": "allow", "--deny-pattern": "deny"}
HELP = "Options: " + " ".join([*VALUES, *FLAGS, *CHOICES, *NUMBERS, *REPEATED, "--pattern", "--help", "--version"])


class Done(Exception):
    """Help or version was asked for."""


def parse_args(argv: list[str]) -> ScanConfig:
    """Settings from arguments; the last value wins, patterns and lists add up, and a value may
    look like a flag. Options that came up are noted so a file doesn't change them."""
    out, explicit, i = ScanConfig(), set(), 0

    def value(flag: str) -> str:
        nonlocal i
        i += 1
        if i >= len(argv):
            raise UsageError(f"{flag} needs a value")
        return argv[i]

    while i < len(argv):
        a = argv[i]
        if a in ("--help", "-h"):
            raise Done(HELP)
        if a in ("--version", "-V"):
            raise Done(f"textveil {VERSION}")
        if a in FLAGS:
            name, on = FLAGS[a]
            out = replace(out, **{name: on})
            explicit.add(name)
        elif a in VALUES:
            out = replace(out, **{VALUES[a]: value(a)})
        elif a in CHOICES:
            name, allowed = CHOICES[a]
            v = value(a)
            if v not in allowed:
                raise UsageError(f"{a} must be one of {', '.join(allowed)}, not {v}")
            out = replace(out, **{name: v})
            explicit.add(name)
        elif a in NUMBERS:
            v = value(a)
            if not (v.isascii() and v.removeprefix("+").isdigit()):
                raise UsageError(f"{a} needs a number, not {v}")
            out = replace(out, **{NUMBERS[a]: int(v)})
            explicit.add(NUMBERS[a])
        elif a in REPEATED:
            name = REPEATED[a]
            out = replace(out, **{name: (*getattr(out, name), value(a))})
        elif a == "--pattern":
            name, equals, pattern = value(a).partition("=")
            if not (name and equals and pattern):
                raise UsageError("--pattern needs NAME=PATTERN")
            out = replace(out, patterns=(*out.patterns, (name, pattern)))
        else:
            raise UsageError(f"unknown option {a}")
        i += 1
    return replace(out, explicit=frozenset(explicit))


def load(argv: list[str]) -> ScanConfig:
    config = parse_args(argv)
    if config.config is not None:
        try:
            with open(config.config, encoding="utf-8") as f:
                config = config.with_file(f.read())
        except (OSError, UnicodeDecodeError) as e:
            raise ConfigError(f"cannot read {config.config}: {e}") from e
    return config


def registry_of(config: ScanConfig) -> Registry:
    return build_registry(config.allow, config.deny, config.patterns, assignment_span=config.assignment_span, ipv6=config.ipv6)


def _gate(config: ScanConfig, found: bool) -> int:
    return FINDINGS if config.fail_on_find and found else OK


def _report(config: ScanConfig, res: DataFrame, to=None, order_cols: tuple[str, ...] = ("path",)) -> dict:
    summary = report.counts(res, order_cols)
    if to is not None:
        for part in report.json_report(res, summary, order_cols):
            to(part)
    return summary


def scan_one(spark: SparkSession, config: ScanConfig, path: str, text: str, file: bool) -> int:
    """One text: a literal, standard input or a single file."""
    res = scan.results(spark.createDataFrame([(path, text)], "path string, text string"), "path", "text", registry_of(config), config.replacement).cache()
    try:
        masked = res.first().masked
        if config.dry_run:
            masked = text
        parts: list[str] = []
        summary = _report(config, res, parts.append)
        if config.format == "json":
            sinks.atomic_write(config.output, "".join(parts)) if config.output else sys.stdout.write("".join(parts))
        else:
            target = path if file and config.in_place else config.output
            if target:
                if not config.dry_run:
                    sinks.atomic_write(target, masked)
            elif not (file and config.dry_run):
                sys.stdout.write(masked)
            if config.report_json:
                sys.stderr.write("".join(parts))
        if config.summary or config.dry_run:
            sys.stderr.write(report.text_summary(summary))
        return _gate(config, summary["total_findings"] > 0)
    finally:
        res.unpersist()


def scan_file(spark: SparkSession, config: ScanConfig, path: str) -> int:
    """A single file; a binary one is passed over with success unless the mode is fail."""
    try:
        text = files.read_file(path, config.max_file_size, config.binary == "best-effort")
    except DetectionError:
        if config.binary != "skip":
            raise
        if config.summary or config.dry_run:
            sys.stderr.write(report.text_summary({"files_processed": 0, "files_skipped": 1, "files_errored": 0, "total_findings": 0, "findings_by_type": {}}))
        return OK
    return scan_one(spark, config, path, text, True)


def is_uri(path: str) -> bool:
    return "://" in path


def scan_directory(spark: SparkSession, config: ScanConfig, root: str) -> int:
    """A tree of files: listed on the driver, read, scanned and written by the executors.

    Paths are relative for processed files and absolute for the others, in the order of the
    absolute ones. Nothing is kept but the masked texts and findings, scanned once for the
    sink and the reports. Below a URI, masked texts go to a table at the output.
    """
    if not (config.output or config.in_place or config.dry_run or config.summary or config.report_json):
        raise UsageError("a directory needs --output, --in-place, --dry-run, --summary or --report-json")
    remote = is_uri(root)
    if remote and config.in_place:
        raise UsageError("files below a URI can't be changed in place")
    if remote:
        docs = files.read_uri(spark, root, config.binary, config.max_file_size)
    else:
        listed = files.list_files(spark, root, include_hidden=config.include_hidden, follow_symlinks=config.follow_symlinks, max_file_size=config.max_file_size)
        docs = files.read_documents(listed, config.binary, config.max_file_size)
    res = scan.results(docs, "path", "text", registry_of(config), config.replacement).drop("text").persist()
    try:
        if not config.dry_run and (config.output or config.in_place):
            sinks.write_table(res, config.output) if remote else sinks.write_files(res, config.output)
        shown = res.withColumn("at", F.split("path", "/")).withColumn("path", F.when(F.col("status") == scan.PROCESSED, F.col("relative")).otherwise(F.col("path")))
        to = sys.stdout.write if config.format == "json" else sys.stderr.write if config.report_json else None
        summary = _report(config, shown, to, ("at",))
        if config.summary or config.dry_run:
            sys.stderr.write(report.text_summary(summary))
        elif not config.report_json:
            sys.stderr.write(f"Processed {summary['files_processed']} files, {summary['total_findings']} findings, {summary['files_skipped']} skipped\n")
        return _gate(config, summary["total_findings"] > 0)
    finally:
        res.unpersist()


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        config = load(argv)
        session = lambda: spark or SparkSession.builder.appName("textveil").getOrCreate()
        if config.text is not None:
            return scan_one(session(), config, "<stdin/text>", config.text, False)
        if config.input is not None and is_uri(config.input):
            return scan_directory(session(), config, config.input)
        if config.input is not None:
            path = files.existing(config.input)
            return scan_directory(session(), config, path) if os.path.isdir(path) else scan_file(session(), config, path)
        if files.stdin_is_piped():
            return scan_one(session(), config, "<stdin/text>", files.read_stdin(), False)
        raise UsageError("no input: give --text, --input or piped input")
    except Done as d:
        sys.stderr.write(f"{d}\n")
        return OK
    except ScanError as e:
        sys.stderr.write(f"{e}\n")
        return e.exit_code


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
