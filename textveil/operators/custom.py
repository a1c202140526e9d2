"""User patterns in a small dialect that never backtracks, compiled to a Java regex on the driver.

Literals are bytes; ``.`` is any byte but a line feed; ``\\d \\D \\w \\W \\s \\S`` are ASCII
classes; ``[...]`` and ``[^...]`` hold bytes and ranges without escapes; ``+ * ?`` are
greedy and give nothing back; ``^`` and ``$`` mean nothing; ``| ( ) { }`` are literals. A
match is tried at every character boundary and must end on one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import MEDIUM, candidates, in_windows, span

REPEAT = 4096  # most repetitions of + and *
# Bytes of the classes.
CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": " \\t\\n\\f\\r"}
ANY = "[\\x00-\\xFF]"


def _byte(c: int) -> str:
    return f"\\x{c:02X}"


def _set(body: bytes, negated: bool) -> str:
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == ord("-"):
            if body[i] <= body[i + 2]:  # a reversed range holds nothing
                parts.append(f"{_byte(body[i])}-{_byte(body[i + 2])}")
            i += 3
        else:
            parts.append(_byte(body[i]))
            i += 1
    if not parts:
        return ANY if negated else "(?!)"
    return f"[{'^' * negated}{''.join(parts)}]"


def to_java_regex(pattern: str) -> tuple[str, int] | None:
    """(regex, most bytes that a match takes), or None if a class isn't closed or nothing is left."""
    p, out, i, reach = pattern.encode(), [], 0, 0
    while i < len(p):
        c = p[i : i + 1].decode("latin-1")
        if c in "^$":
            i += 1
            continue
        if c == ".":
            atom, i = "[^\\n]", i + 1
        elif c == "\\" and i + 1 < len(p):
            e = chr(p[i + 1])
            kind = CLASSES.get(e.lower()) if e.isascii() else None
            atom = f"[{'^' * e.isupper()}{kind}]" if kind else _byte(p[i + 1])
            i += 2
        elif c == "[":
            negated = p[i + 1 : i + 2] == b"^"
            begin = i + 1 + negated
            end = p.find(b"]", begin)
            if end < 0:
                return None
            atom, i = _set(p[begin:end], negated), end + 1
        else:
            atom, i = _byte(p[i]), i + 1
        reach += 1
        if i < len(p) and p[i : i + 1] in b"+*?":
            reach += REPEAT - 1 if p[i] != ord("?") else 0
            atom += {"+": f"{{1,{REPEAT}}}+", "*": f"{{0,{REPEAT}}}+", "?": "?+"}[chr(p[i])]
            i += 1
        out.append(atom)
    return ("".join(out), reach) if out else None


def custom(pattern: str):
    """A column builder for the pattern, or None if it doesn't compile."""
    compiled = to_java_regex(pattern)
    if compiled is None:
        return None
    regex, reach = compiled
    boundary = "(?![\\x80-\\xBF])"

    def find(v: Column) -> Column:
        some = F.filter(candidates(v, boundary, f"{regex}{boundary}"), lambda c: F.length(c["text"]) > 0)
        return F.transform(some, lambda c: span(c["start"], c["start"] + F.length(c["text"]), MEDIUM))

    # the byte after a match is looked at too
    return lambda b: in_windows(b, reach + 1, find)
