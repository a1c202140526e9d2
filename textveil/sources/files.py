"""Listing and reading text files.

The walk runs on the driver over names only; contents are read by the executors.
"""

from __future__ import annotations

import os
import stat
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_DEPTH, MAX_FILE_SIZE
from ..errors import DetectionError, IoError, TraversalError, UsageError
from ..functions.binary import is_binary

ENTRY = "path string, relative string, size long, eligible boolean, reason string"


@dataclass(frozen=True)
class Entry:
    path: str
    relative: str | None
    size: int | None
    eligible: bool
    reason: str | None = None


def collect_files(root: str, include_hidden: bool = False, follow_symlinks: bool = False, max_file_size: int = MAX_FILE_SIZE, max_depth: int = MAX_DEPTH) -> list[Entry]:
    """All entries below a directory, eligible or skipped with a reason, sorted by path.

    Tests come in a fixed order: hidden, symlink, directory or file, size. The reasons are
    fixed values. Sockets,
    pipes and devices give no entry; what can't be listed raises.
    """
    try:
        top = os.path.realpath(root, strict=True)
    except OSError as e:
        raise TraversalError(f"{root}: {e}") from e
    out: list[Entry] = []

    def skip(path: str, reason: str) -> None:
        out.append(Entry(path, None, None, False, reason))

    todo = [(top, 0)]
    while todo:
        folder, depth = todo.pop()
        if depth > max_depth:
            skip(folder, f"Max depth {max_depth} exceeded")
            continue
        try:
            entries = list(os.scandir(folder))
        except OSError as e:
            raise TraversalError(f"{folder}: {e}") from e
        for x in entries:
            if x.name.startswith(".") and not include_hidden:
                skip(x.path, "Hidden file/directory")
                continue
            if x.is_symlink():
                if not follow_symlinks:
                    skip(x.path, "Symlink (not following)")
                    continue
                try:
                    target = os.path.realpath(x.path, strict=True)
                except OSError as e:
                    skip(x.path, f"Cannot resolve symlink: {e}")
                    continue
                if os.path.commonpath([top, target]) != top:
                    skip(x.path, "Symlink target outside root (path traversal protection)")
                    continue
            try:
                s = os.stat(x.path)
            except OSError as e:
                skip(x.path, f"Cannot stat: {e}")
                continue
            if stat.S_ISDIR(s.st_mode):
                todo.append((x.path, depth + 1))
            elif stat.S_ISREG(s.st_mode):
                if s.st_size > max_file_size:
                    skip(x.path, f"Exceeds max file size ({s.st_size} bytes)")
                else:
                    out.append(Entry(x.path, os.path.relpath(x.path, top), s.st_size, True))
    return sorted(out, key=lambda e: os.fsencode(e.path).split(b"/"))


def list_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """The entries of ``collect_files`` as rows; the walk holds names only."""
    return spark.createDataFrame([(e.path, e.relative, e.size, e.eligible, e.reason) for e in collect_files(root, **options)], ENTRY)


def read_documents(entries: DataFrame, mode: str = "skip", max_size: int = MAX_FILE_SIZE, partition_bytes: int = 64 << 20) -> DataFrame:
    """(path, relative, text, status, reason) of listed files.

    Strict reading tests size, then binary content, then UTF-8. In ``best-effort`` mode
    only the size is tested and invalid bytes become U+FFFD. A file that can't be read
    is an error row, never a failed task. Eligible files are dealt out so that a
    partition holds about ``partition_bytes``.
    """
    spark = entries.sparkSession
    total = entries.agg(F.sum("size"), F.count_if("eligible")).first()
    parts = max(1, min(total[1] or 1, -(-(total[0] or 0) // partition_bytes), 100_000), min(total[1] or 1, spark.sparkContext.defaultParallelism))

    def load(batches):
        for b in batches:
            for path, relative in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                content, error = None, None
                try:
                    with open(path, "rb") as f:
                        content = f.read(max_size + 1)
                except OSError as e:
                    error = f"I/O error: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([relative], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "relative", "content", "error"])

    files = entries.filter("eligible").select("path", "relative").repartition(parts).mapInArrow(load, "path string, relative string, content binary, error string")
    judged = judge(files, mode, max_size)
    skipped = entries.filter("not eligible").select("path", "relative", F.lit(None).cast("string").alias("text"), F.lit("skipped").alias("status"), "reason")
    return judged.unionByName(skipped)


def read_uri(spark: SparkSession, uri: str, mode: str = "skip", max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """(path, relative, text, status, reason) of the files below a location that only Spark's
    readers reach, such as an object store.

    Executors list and read. Files over the size are skipped with a reason before their
    contents are read. Names with a leading dot or underscore, which Spark's readers don't
    list, have no row. Links are what the file system makes of them; object stores have none.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(uri)
    top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    name = F.when(F.startswith(F.col("path"), F.lit(f"{top}/")), F.substr("path", F.lit(len(top) + 2))).otherwise(F.element_at(F.split("path", "/"), -1))
    small = found.filter(F.col("length") <= max_size)
    judged = judge(small.select("path", name.alias("relative"), "content", F.lit(None).cast("string").alias("error")), mode, max_size)
    reason = F.concat(F.lit("Exceeds max file size ("), F.col("length").cast("string"), F.lit(" bytes)"))
    large = found.filter(F.col("length") > max_size).select("path", F.lit(None).cast("string").alias("relative"), F.lit(None).cast("string").alias("text"), F.lit("skipped").alias("status"), reason.alias("reason"))
    return judged.unionByName(large)


def judge(files: DataFrame, mode: str = "skip", max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Text, status and reason from (path, relative, content, error)."""
    content = F.col("content")
    too_large = F.length(content) > max_size
    binary, valid = is_binary(content), F.is_valid_utf8(content.cast("string"))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(too_large, F.lit(f"I/O error: file exceeds maximum size ({max_size} bytes)"))
    if mode != "best-effort":
        why = why.when(binary, F.lit("Binary file")).when(~valid, F.lit("I/O error: invalid UTF-8"))
    rows = files.withColumn("reason", why)
    skips = (F.col("reason") == "Binary file") & F.lit(mode == "skip")
    status = F.when(F.col("reason").isNull(), "processed").when(skips, "skipped").otherwise("error")
    text = F.when(F.col("reason").isNull(), F.make_valid_utf8(content.cast("string")))
    return rows.withColumn("status", status).select("path", "relative", text.alias("text"), "status", "reason")


def read_file(path: str, max_size: int = MAX_FILE_SIZE, best_effort: bool = False) -> str:
    """One file on the driver: size, then binary content, then UTF-8."""
    try:
        size = os.stat(path).st_size
        if size > max_size:
            raise IoError(f"{path}: file exceeds maximum size ({size} > {max_size} bytes)")
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        raise IoError(f"{path}: {e}") from e
    if best_effort:
        return content.decode("utf-8", "replace")
    if binary_bytes(content):
        raise DetectionError(f"{path}: binary file detected")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise IoError(f"{path}: invalid UTF-8: {e}") from e


def binary_bytes(content: bytes) -> bool:
    s = content[:8192]
    control = sum(c < 0x07 or 0x0E <= c <= 0x1F and c != 0x1B for c in s)
    return 0 in s or control / max(1, len(s)) > 0.3


def stdin_is_piped() -> bool:
    try:
        return not stat.S_ISCHR(os.fstat(sys.stdin.fileno()).st_mode)
    except (OSError, ValueError):
        return False


def read_stdin() -> str:
    try:
        return sys.stdin.buffer.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise IoError(f"stdin: {e}") from e


def literal(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("<stdin/text>", text)], "path string, text string")


def existing(path: str) -> str:
    if not os.path.exists(path):
        raise UsageError(f"input path does not exist: {path}")
    return path
