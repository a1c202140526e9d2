"""An independent scan of bytes in plain Python, for tests: loops over positions, no Spark.

It shares no regex with the columns it checks.
"""

from __future__ import annotations

DIGITS = frozenset(b"0123456789")
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = DIGITS | LETTERS


def _run(b: bytes, i: int, allowed, limit: int) -> int:
    end = i
    while end < min(len(b), i + limit) and b[end] in allowed:
        end += 1
    return end


def email(b: bytes):
    local, domain = WORD | frozenset(b".+_-"), WORD | frozenset(b".-")
    for i in (i for i, c in enumerate(b) if c == 64):
        s = i
        while s and b[s - 1] in local:
            s -= 1
        e = _run(b, i + 1, domain, len(b))
        while e > i + 1 and b[e - 1] in b".-":
            e -= 1
        d = b[i + 1 : e]
        if s < i and b"." in d and len(d) - d.rindex(b".") - 1 >= 2 and 5 <= e - s <= 320:
            yield s, e, 2


def _greedy(b: bytes, starts, found):
    i = 0
    while i < len(b):
        if starts(b, i) and (hit := found(b, i)):
            yield hit
            i = hit[1]
        else:
            i += 1


def _fresh(b: bytes, i: int) -> bool:
    return i == 0 or b[i - 1] not in WORD


def phone(b: bytes):
    def found(b, i):
        e = i + 1 + (_run(b, i + 1, DIGITS | frozenset(b" .()-"), 29) - i - 1)
        n = sum(c in DIGITS for c in b[i:e])
        while e > i and b[e - 1] not in DIGITS:
            e -= 1
        m = b[i:e]
        dotted = m.count(b".") >= 2 and not m.strip(b"0123456789.+") and all(c in b"0123456789.+" for c in m)
        return (i, e, 2 if n >= 10 else 1) if 7 <= n <= 15 and e - i >= 7 and not dotted else None

    return _greedy(b, lambda b, i: b[i] in DIGITS | frozenset(b"+(") and _fresh(b, i), found)


def card(b: bytes):
    def found(b, i):
        e = _run(b, i, DIGITS | frozenset(b" -"), 25)
        while b[e - 1] not in DIGITS:
            e -= 1
        d = [c - 48 for c in b[i:e] if c in DIGITS]
        total = sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(reversed(d)))
        return (i, e, 2) if 13 <= len(d) <= 19 and (e == len(b) or b[e] not in WORD) and total % 10 == 0 else None

    return _greedy(b, lambda b, i: b[i] in DIGITS and _fresh(b, i), found)


def path(b: bytes):
    body, lead = WORD | frozenset(b"/\\._~:-"), frozenset(b" \t\n\f\r=\"'")

    def starts(b, i):
        opened = i == 0 or b[i - 1] in lead
        if b[i] == 47:
            return _fresh(b, i) and not (i and b[i - 1] == 58)
        if b[i] in b".~":
            return opened and (b[i + 1 : i + 2] == b"/" or b[i : i + 3] == b"../")
        return b[i] in LETTERS and b[i + 1 : i + 3] == b":\\" and _fresh(b, i)

    def found(b, i):
        e = _run(b, i, body, 4096)
        while e > i and b[e - 1] in b"/\\.":
            e -= 1
        n = sum(c in b"/\\" for c in b[i:e])
        return (i, e, 2 if n >= 3 else 1) if e - i >= 4 and n >= 2 else None

    return _greedy(b, starts, found)


def merged(spans):
    """Union of overlapping (start, end, conf, det) with the label rule, by a plain loop."""
    out: list[list] = []
    for s, e, c, d in sorted(spans, key=lambda x: (x[0], -x[1], x[3])):
        if out and s < out[-1][1]:
            last = out[-1]
            if c > last[2] or (c == last[2] and e - s > last[1] - last[0]):
                last[2], last[3] = c, d
            last[1] = max(last[1], e)
        else:
            out.append([s, e, c, d])
    return [tuple(x) for x in out]
