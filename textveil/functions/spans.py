"""Columns that find, order, merge and replace spans of a byte view.

A span list is ``array<struct<start int, end int, conf tinyint>>``; a merged list adds
``det``, the detector's place in the registry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH = 0, 1, 2
CONFIDENCE = ("low", "medium", "high")
SPANS = "array<struct<start:int,end:int,conf:tinyint>>"
PIECE = 16_384  # starts of a window at least
MERGED = "array<struct<start:int,end:int,det:int,conf:tinyint>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers(text: Column) -> Column:
    """The numbers of a text of comma-led numbers."""
    none = F.array().cast("array<int>")
    return bound(text, lambda t: F.when(F.length(t) == 0, none).otherwise(F.split(F.substring(t, F.lit(2), F.length(t)), ",").cast("array<int>")))


def _unpacked(text: Column, fields: dict[str, str]) -> Column:
    """Structs of as many numbers of a text each as there are fields, in order."""
    width = len(fields)
    none = F.array().cast(f"array<struct<{','.join(f'{k}:{v}' for k, v in fields.items())}>>")

    def structs(n):
        at = F.sequence(F.lit(0), F.size(n) - 1, F.lit(width))
        rows = F.transform(at, lambda i: F.struct(*[F.get(n, i + k).cast(kind).alias(name) for k, (name, kind) in enumerate(fields.items())]))
        return F.when(F.size(n) == 0, none).otherwise(rows)

    return bound(_numbers(text), structs)


def folded(items: Column, zero: dict[str, int], step, emit, last=None) -> Column:
    """A fold over an array that gives, as one text of comma-led numbers, what comes out on the way.

    The state is a few integers: ``step(state, item)`` gives the new ones by name,
    ``emit(state, item)`` what comes out at an item, ``last(state)`` what comes out at the end.
    A fold copies its state at each step, so the text that gathers is kept short: the items
    are cut into as many blocks as each holds items, a first fold finds the state before
    each block, and each block then has a text of its own. With k items this takes k steps
    of at most sqrt(k) numbers, twice.
    """
    names = list(zero)
    state_of = lambda cols: F.struct(*[cols[n].cast("int").alias(n) for n in names])
    moved = lambda state, x: state_of(step(state, x))
    begin = F.struct(state_of({n: F.lit(v) for n, v in zero.items()}).alias("state"), F.lit("").alias("out"))

    def note(acc, block):
        before = F.concat(acc["out"], *[x for n in names for x in (F.lit(","), acc["state"][n].cast("string"))])
        return F.struct(F.aggregate(block, acc["state"], moved).alias("state"), before.alias("out"))

    def within(block, state):
        first = F.struct(state_of({n: state[n] for n in names}).alias("state"), F.lit("").alias("out"))
        return F.aggregate(block, first, lambda acc, x: F.struct(moved(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out")), lambda acc: acc["out"])

    def both(blocks):
        def gathered(noted):
            parts = F.array_join(F.zip_with(blocks, _unpacked(noted["out"], {n: "int" for n in names}), within), "")
            return F.concat(parts, last(noted["state"])) if last else parts

        return bound(F.aggregate(blocks, begin, note), gathered)

    def blocked(a):
        cut = lambda n: F.transform(F.sequence(F.lit(0), F.size(a) - 1, n), lambda at: F.slice(a, at + 1, n))
        return F.when(F.size(a) == 0, F.lit("")).otherwise(bound(bound(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(a))).cast("int")), cut), both))

    return bound(items, blocked)


def running_sums(numbers: Column, begin: int = 0) -> Column:
    """For each number the sum of all up to it."""
    total = lambda acc, x: acc["n"] + x
    return _numbers(folded(numbers, {"n": begin}, lambda acc, x: {"n": total(acc, x)}, lambda acc, x: F.concat(F.lit(","), total(acc, x).cast("string"))))


def _located(b: Column, regex: str, group: int) -> Column:
    """(start, text) of each match; ``group`` 0 for matches that consume, 1 for a captured look-ahead.

    Pieces between matches give the starts as a running sum. A zero-width match at the
    very start has no piece before it.
    """

    def starts(found, pieces):
        if group:
            pieces = F.when(F.size(pieces) == F.size(found) + 1, pieces).otherwise(F.concat(F.array(F.lit("")), pieces))
        gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), (F.lit(0) if group else F.length(m)).alias("size")))
        start = lambda acc, x: acc["at"] + x["gap"]
        return _numbers(folded(gaps, {"at": 0}, lambda acc, x: {"at": start(acc, x) + x["size"]}, lambda acc, x: F.concat(F.lit(","), start(acc, x).cast("string"))))

    def located(found):
        at = bound(F.split(b, regex, -1), lambda pieces: starts(found, pieces))
        return F.zip_with(at, found, lambda start, m: F.struct(start.alias("start"), m.alias("text")))

    return bound(F.regexp_extract_all(b, F.lit(regex), F.lit(group)), located)


def matches(b: Column, regex: str) -> Column:
    """(start, text) of the matches of a regex, left to right without overlap."""
    return _located(b, regex, 0)


def candidates(b: Column, start: str, body: str) -> Column:
    """(start, text) at every place where ``start`` (zero-width) holds; text is what ``body`` takes there."""
    return _located(b, f"{start}(?=({body}))", 1)


def span(start: Column, end: Column, conf) -> Column:
    conf = F.lit(conf) if isinstance(conf, int) else conf
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), conf.cast("tinyint").alias("conf"))


def in_windows(b: Column, reach: int, find) -> Column:
    """``find(b)`` for spans that begin anywhere and take at most ``reach`` bytes, one window at a
    time. What is captured at each start of a window is dropped before the next one, so a
    long run of starts never holds more than a window's captures. One byte before a window
    is there to be looked at."""
    size = max(PIECE, reach)

    def window(raw, at):
        left = F.least(at, F.lit(1))
        spans = find(F.decode(F.substring(raw, at + 1 - left, left + size + reach), "ISO-8859-1"))
        mine = F.filter(spans, lambda s: (s["start"] >= left) & (s["start"] < left + size))
        return F.transform(mine, lambda s: span(s["start"] + at - left, s["end"] + at - left, s["conf"]))

    cut = bound(F.encode(b, "ISO-8859-1"), lambda raw: F.flatten(F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1, F.lit(size)), lambda at: window(raw, at))))
    return F.when(F.octet_length(b) <= size, find(b)).otherwise(cut)


def greedy(spans: Column) -> Column:
    """Leftmost spans that don't overlap an earlier one kept; ``spans`` is sorted by start."""
    fields = ("start", "end", "conf")

    def step(acc, s):
        return {"end": F.when(s["start"] >= acc["end"], s["end"]).otherwise(acc["end"])}

    def emit(acc, s):
        return F.when(s["start"] >= acc["end"], F.concat(*[x for f in fields for x in (F.lit(","), s[f].cast("string"))])).otherwise(F.lit(""))

    return _unpacked(folded(spans, {"end": 0}, step, emit), {"start": "int", "end": "int", "conf": "tinyint"})


def merge(sorted_spans: Column) -> Column:
    """One pass over spans sorted by (start, -end, order): overlapping ones become their union.

    The label goes over to a span of higher confidence, or of equal confidence and
    greater length than the union so far. Touching spans stay apart.
    """
    fields = ("start", "end", "det", "conf")

    def flush(acc):
        return F.when(acc["end"] < 0, F.lit("")).otherwise(F.concat(*[x for f in fields for x in (F.lit(","), acc[f].cast("string"))]))

    def step(acc, f):
        end = -f["neg_end"]
        wins = (f["conf"] > acc["conf"]) | ((f["conf"] == acc["conf"]) & (end - f["start"] > acc["end"] - acc["start"]))
        meets = f["start"] < acc["end"]
        taken = ~meets | wins
        return {
            "start": F.when(meets, acc["start"]).otherwise(f["start"]),
            "end": F.when(meets, F.greatest(acc["end"], end)).otherwise(end),
            "det": F.when(taken, f["det"]).otherwise(acc["det"]),
            "conf": F.when(taken, f["conf"].cast("int")).otherwise(acc["conf"]),
        }

    emit = lambda acc, f: F.when(f["start"] < acc["end"], F.lit("")).otherwise(flush(acc))
    merged = folded(sorted_spans, {"start": 0, "end": -1, "det": 0, "conf": -1}, step, emit, flush)
    return _unpacked(merged, {"start": "int", "end": "int", "det": "int", "conf": "tinyint"})


def replaced(text: Column, merged: Column, marker) -> Column:
    """The text with each span replaced; ``marker`` maps a span to its replacement. Bytes are
    cut out, not characters: a cut of characters walks from the text's beginning."""

    def build(raw, m):
        def piece(f, i):
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
            return F.concat(F.substring(raw, before + 1, f["start"] - before).cast("string"), marker(f))

        at = F.element_at(m, -1)["end"]
        tail = F.substring(raw, at + 1, F.octet_length(raw) - at).cast("string")
        return F.decode(F.concat(F.array_join(F.transform(m, piece), ""), tail).cast("binary"), "UTF-8")

    whole = lambda m: F.when(F.size(m) == 0, text).otherwise(bound(F.encode(text, "UTF-8"), lambda raw: build(raw, m)))
    return bound(merged, whole)


def described(text: Column, merged: Column) -> Column:
    """The merged spans of a text with ``sample`` and ``line`` in their structs."""

    def build(raw, m):
        def breaks(f, i):
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["start"])
            gap = F.substring(raw, before + 1, f["start"] - before).cast("string")
            return F.octet_length(gap) - F.octet_length(F.replace(gap, F.lit("\n"), F.lit("")))

        def row(f, line):
            size = f["end"] - f["start"]
            # 16 bytes hold the four characters that a sample shows at most
            shown = F.decode(F.substring(raw, f["start"] + 1, F.least(size, F.lit(16))), "ISO-8859-1")
            return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["det"].alias("det"), f["conf"].alias("conf"), masked_sample(from_view_head(shown), size).alias("sample"), line.alias("line"))

        return F.zip_with(m, running_sums(F.transform(m, breaks), 1), row)

    # bound, or the text would be encoded anew for each span
    return bound(F.encode(text, "UTF-8"), lambda raw: bound(merged, lambda m: build(raw, m)))


def from_view_head(head: Column) -> Column:
    """The characters of the first bytes of a text, given in the byte view; one cut short at the end goes."""
    whole = F.regexp_replace(head, "[\\xC0-\\xFF][\\x80-\\xBF]{0,2}$", "")
    short = F.when(F.length(head) < 13, head).otherwise(whole)
    return F.encode(short, "ISO-8859-1").cast("string")


def masked_sample(matched_text: Column, byte_length: Column) -> Column:
    """Stars for up to 4 bytes, else the first characters (a quarter of the bytes, 4 at most) and ***."""
    shown = F.least(F.lit(4), F.floor(byte_length / 4).cast("int"))
    return F.when(byte_length <= 4, F.repeat(F.lit("*"), byte_length)).otherwise(F.concat(F.left(matched_text, shown), F.lit("***")))
