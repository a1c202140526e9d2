"""Reports for people and programs: the JSON document and the text summary."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import scan


#: The report writes these two control characters by their numbers.
_BY_NUMBER = {"\\b": "\\u0008", "\\f": "\\u000c"}


def _json(value, **options) -> str:
    out = json.dumps(value, ensure_ascii=False, **options)
    return re.sub(r"\\\\|\\[bf]", lambda m: _BY_NUMBER.get(m[0], m[0]), out)


def counts(res: DataFrame, order_cols: tuple[str, ...] = ("path",)) -> dict:
    """The summary row and the counts per detector; both are aggregates of fixed size."""
    top = scan.summary(res).first().asDict()
    found = res.select(*order_cols, F.posexplode("findings").alias("pos", "f")).select(*order_cols, "pos", F.col("f.detector").alias("detector"))
    by = scan.findings_by_type(found, [*order_cols, "pos"]).orderBy("position").collect()
    return top | {"findings_by_type": {r.detector: r.n for r in by}}


def json_report(res: DataFrame, summary: dict, order_cols: tuple[str, ...] = ("path",)) -> Iterator[str]:
    """The report in pieces, in the order of ``order_cols``; results come from the cluster one
    partition at a time."""
    head = _json({"summary": summary}, indent=2)
    yield head[: head.rindex("}")].rstrip() + ',\n  "files": ['
    n = 0
    for r in res.orderBy(*order_cols).select("path", "status", "reason", "findings_count", "findings").toLocalIterator():
        row = {"path": r.path, "status": r.status} | ({"reason": r.reason} if r.reason is not None else {}) | {"findings_count": r.findings_count, "findings": [f.asDict() for f in r.findings]}
        body = _json(row, indent=2).replace("\n", "\n    ")
        yield ("," if n else "") + "\n    " + body
        n += 1
    yield ("\n  " if n else "") + "]\n}\n"


def text_summary(summary: dict) -> str:
    # The lines of the summary.
    lines = ["", "--- Redaction Summary ---", f"Files processed: {summary['files_processed']}", f"Files skipped:   {summary['files_skipped']}", f"Files errored:   {summary['files_errored']}", f"Total findings:  {summary['total_findings']}"]
    if summary["findings_by_type"]:
        lines += ["Findings by type:", *(f"  {k}: {n}" for k, n in summary["findings_by_type"].items())]
    return "\n".join([*lines, "-" * 25, ""])
