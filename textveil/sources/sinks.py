"""Writing masked texts: atomic files, trees of files and tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AtomicWriteError


def atomic_write(path: str, content: str) -> None:
    """Write beside the target and rename: readers see the old file or the new one.

    The temporary file is private until it takes over the target's mode; it goes if
    anything fails.
    """
    folder = os.path.dirname(path) or "."
    # Fixed value: the name of the temporary file.
    tmp = os.path.join(folder, f".redact_tmp_{os.getpid()}_{os.path.basename(path)}")
    try:
        os.makedirs(folder, exist_ok=True)
        fd = os.open(tmp, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(content.encode("utf-8", "surrogatepass"))
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(tmp, os.stat(path).st_mode & 0o7777)
        os.replace(tmp, path)
    except OSError as e:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise AtomicWriteError(f"{path}: {e}") from e


def write_files(res: DataFrame, output: str | None = None) -> int:
    """Write ``masked`` of processed rows below ``output`` under their relative path, or in
    place without one. Executors write; a failed write fails the job. Returns the files written."""

    def write(batches):
        for b in batches:
            for path, relative, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                atomic_write(os.path.join(output, relative) if output else path, text)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    rows = res.filter("status = 'processed'").select("path", "relative", "masked").mapInArrow(write, "n long")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_table(res: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(path, masked) of processed rows as Parquet at any location that Spark writes to; what
    is there is never written over."""
    res.filter("status = 'processed'").select("path", "masked").write.mode(mode).parquet(path)
