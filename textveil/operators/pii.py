"""Detectors of personal data, as columns over a byte view.

Each finds candidates by a start condition, bounds them by a window, checks them and
keeps the leftmost that don't overlap. Character classes are spelled out: Java's
shorthands take other sets of characters than ASCII rules need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import HIGH, MEDIUM, bound, candidates, greedy, in_windows, matches, no_spans, span

ALNUM = "0-9A-Za-z"
NOT_AFTER_WORD = f"(?<![{ALNUM}])"
# Windows in bytes that candidates are bounded by.
PHONE_WINDOW, CARD_WINDOW, IPV6_WINDOW, PATH_WINDOW = 30, 25, 45, 4096
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9])"


def gated(gate: Column, found: Column) -> Column:
    """Nothing is scanned unless a cheap test passes."""
    return F.when(gate, found).otherwise(no_spans())


def any_of(b: Column, *texts: str) -> Column:
    """Whether one of some fixed texts stands in the view: a byte search, far cheaper than a regex."""
    out = F.contains(b, F.lit(texts[0]))
    for t in texts[1:]:
        out = out | F.contains(b, F.lit(t))
    return out


def _end(c: Column) -> Column:
    return c["start"] + F.length(c["text"])


def _trimmed(found: Column, trailing: str) -> Column:
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.regexp_replace(c["text"], f"{trailing}$", "").alias("text")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def email(b: Column) -> Column:
    """Every @ with a local part before it and a dotted domain after it; findings may overlap."""
    found = candidates(b, "(?<![A-Za-z0-9.+_-])", "[A-Za-z0-9.+_-]++@[A-Za-z0-9.-]++")
    found = _trimmed(found, "[.-]++")
    ok = F.filter(found, lambda c: c["text"].rlike(r"@[^@]*\.[^.@]{2,}+$") & F.length(c["text"]).between(5, 320))
    return gated(F.contains(b, F.lit("@")), F.transform(ok, lambda c: span(c["start"], _end(c), HIGH)))


def phone(b: Column) -> Column:
    """7 to 15 digits with separators; dotted numbers that look like an IP address are left."""
    found = _trimmed(candidates(b, NOT_AFTER_WORD, rf"[+(0-9][0-9 .()-]{{0,{PHONE_WINDOW - 1}}}+"), "[^0-9]++")
    ok = F.filter(found, lambda c: F.length(_digits(c["text"])).between(7, 15) & (F.length(c["text"]) >= 7) & ~c["text"].rlike(r"^[0-9+]*+\.[0-9+]*+\.[0-9.+]*+$"))
    spans = F.transform(ok, lambda c: span(c["start"], _end(c), F.when(F.length(_digits(c["text"])) >= 10, HIGH).otherwise(MEDIUM)))
    return gated(b.rlike(r"[0-9][0-9 .()-]{5,}+"), greedy(spans))


def ipv4(b: Column) -> Column:
    found = matches(b, rf"{NOT_AFTER_WORD}{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?![{ALNUM}])")
    return gated(b.rlike(r"[0-9]\.[0-9]{1,3}\."), F.transform(found, lambda c: span(c["start"], _end(c), HIGH)))


def ipv6(b: Column, strict: bool = False) -> Column:
    """Groups of 1 to 4 hex digits parted by single colons, after an optional leading ``::``.

    An inner ``::`` ends the scan. With ``strict`` (an extension) full addresses with one
    ``::`` anywhere are found whole, and nothing else.
    """
    h = "[0-9A-Fa-f]{1,4}+"
    if strict:
        side = f"(?:{h}(?::(?!:){h})*+)?+"
        found = matches(b, rf"(?<![{ALNUM}:])(?:{h}(?::{h}){{7}}|{side}::{side})(?![{ALNUM}:])")
        ok = F.filter(found, lambda c: F.length(c["text"]) >= 3)
        return gated(F.contains(b, F.lit(":")), F.transform(ok, lambda c: span(c["start"], _end(c), MEDIUM)))
    found = candidates(b, NOT_AFTER_WORD, f"(?:::)?+{h}(?::(?!:){h}){{0,8}}+")
    found = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.regexp_replace(F.left(c["text"], F.lit(IPV6_WINDOW)), ":++$", "").alias("text")))
    ok = F.filter(found, lambda c: (F.startswith(c["text"], F.lit("::")) | c["text"].rlike("^[^:]++:[^:]++:")) & (F.length(c["text"]) >= 6))
    return gated(b.rlike("[0-9A-Fa-f:]:[0-9A-Fa-f]"), greedy(F.transform(ok, lambda c: span(c["start"], _end(c), MEDIUM))))


def credit_card(b: Column) -> Column:
    """13 to 19 digits with blanks or dashes that pass the Luhn check, no letter or digit after them."""
    found = _trimmed(candidates(b, NOT_AFTER_WORD, f"[0-9][0-9 -]{{0,{CARD_WINDOW - 1}}}+"), "[^0-9]++")

    def checked(raw):
        free = lambda c: ~F.substring(raw, _end(c) + 1, F.lit(1)).cast("string").rlike(f"[{ALNUM}]")
        ok = F.filter(found, lambda c: F.length(_digits(c["text"])).between(13, 19) & F.call_function("luhn_check", _digits(c["text"])) & free(c))
        return F.transform(ok, lambda c: span(c["start"], _end(c), HIGH))

    return gated(b.rlike("[0-9](?:[ -]*+[0-9]){12}"), greedy(bound(F.encode(b, "ISO-8859-1"), checked)))


def ssn(b: Column) -> Column:
    found = matches(b, f"{NOT_AFTER_WORD}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?![0-9])")
    return gated(b.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.transform(found, lambda c: span(c["start"], _end(c), HIGH)))


def path(b: Column) -> Column:
    """Absolute, relative, home and drive paths of 4 bytes and two separators at least."""
    lead = "(?<![^ \\t\\n\\f\\r=\"'])"
    start = rf"(?:(?<![{ALNUM}:])(?=/)|{lead}(?=\.\.?/|~/)|{NOT_AFTER_WORD}(?=[A-Za-z]:\\))"
    slashes = lambda c: F.length(F.regexp_replace(c["text"], r"[^/\\]++", ""))

    def find(v):
        found = _trimmed(candidates(v, start, rf"[A-Za-z0-9/\\._~:-]{{1,{PATH_WINDOW}}}+"), r"[/\\.]++")
        ok = F.filter(found, lambda c: (F.length(c["text"]) >= 4) & (slashes(c) >= 2))
        return F.transform(ok, lambda c: span(c["start"], _end(c), F.when(slashes(c) >= 3, HIGH).otherwise(MEDIUM)))

    return gated(b.rlike(r"[/\\]"), greedy(in_windows(b, PATH_WINDOW, find)))
