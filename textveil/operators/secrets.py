"""Detectors of secrets, as columns over a byte view.

The rules are known from documentation only. What it leaves open is [ASSUMED] here:
the character sets that end values, left boundaries of tokens with a fixed prefix, how
a third dot ends a JWT, that an unclosed key block runs to the end of the text, and
what an assignment's span covers (``assignment_span``: the value, or keyword and value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import HIGH, MEDIUM, greedy, matches, span
from .pii import ALNUM, NOT_AFTER_WORD, any_of, gated

URL_WINDOW, JWT_WINDOW = 2048, 4096
B64URL = "A-Za-z0-9_-"


def _all(found: Column, conf) -> Column:
    return F.transform(found, lambda c: span(c["start"], c["start"] + F.length(c["text"]), conf(c) if callable(conf) else conf))


def _prefixed(b: Column, gate: Column, regex: str, least: int) -> Column:
    return gated(gate, _all(F.filter(matches(b, regex), lambda c: F.length(c["text"]) >= least), HIGH))


def aws_key(b: Column) -> Column:
    return _prefixed(b, any_of(b, "AKIA", "ABIA", "ACCA", "ASIA"), f"{NOT_AFTER_WORD}(?:AKIA|ABIA|ACCA|ASIA)[{ALNUM}]{{16}}(?![{ALNUM}])", 20)


def bearer_token(b: Column) -> Column:
    return _prefixed(b, any_of(F.lower(b), "bearer "), rf"(?i){NOT_AFTER_WORD}bearer [A-Za-z0-9_.-]{{20,{URL_WINDOW}}}+", 27)


def jwt(b: Column) -> Column:
    n = JWT_WINDOW
    found = matches(b, rf"{NOT_AFTER_WORD}eyJ[{B64URL}]{{0,{n}}}+\.[{B64URL}]{{1,{n}}}+\.[{B64URL}]{{1,{n}}}+(?!\.[{B64URL}])")
    return gated(F.contains(b, F.lit("eyJ")), _all(F.filter(found, lambda c: F.length(c["text"]).between(36, n)), HIGH))


def private_key(b: Column) -> Column:
    """Blocks from BEGIN to the END of the same kind, or to the end of the text."""
    kind = "(?:(?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY|PGP PRIVATE KEY BLOCK)"
    found = matches(b, rf"-----BEGIN ({kind})-----(?:[\s\S]*?-----END \1-----|[\s\S]*+)")
    closed = lambda c: F.when(c["text"].rlike(rf"-----END {kind}-----$"), HIGH).otherwise(MEDIUM)
    return gated(F.contains(b, F.lit("-----BEGIN ")), _all(found, closed))


def _assignment(b: Column, keyword: str, hints: tuple[str, ...], assignment_span: str) -> Column:
    """keyword = value or keyword: value, quotes around the value stripped; values of 4 bytes and more."""
    head = rf"(?i)(?:{keyword})[ \t]*+[=:][ \t]*+[\"']?+"
    value = r"[^ \t\n\r\f\"',;]{4,}+"
    found = matches(b, head + value)
    gate = any_of(F.lower(b), *hints)
    if assignment_span == "pair":
        return gated(gate, _all(found, MEDIUM))

    def of_value(c):
        size = F.length(c["text"]) - F.length(F.regexp_substr(c["text"], F.lit(f"^{head}")))
        end = c["start"] + F.length(c["text"])
        return span(end - size, end, MEDIUM)

    return gated(gate, F.transform(found, of_value))


def api_key(b: Column, assignment_span: str = "value") -> Column:
    return _assignment(b, "api_key|apikey|api-key|access_key|secret_key", ("key",), assignment_span)


def database_url(b: Column) -> Column:
    schemes = r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)"
    found = F.filter(matches(b, rf"{NOT_AFTER_WORD}{schemes}://[^ \t\n\r\f\"'<>]{{0,{URL_WINDOW}}}+"), lambda c: F.length(c["text"]) >= 15)
    return gated(F.contains(b, F.lit("://")), _all(found, lambda c: F.when(F.contains(c["text"], F.lit("@")), HIGH).otherwise(MEDIUM)))


def password(b: Column, assignment_span: str = "value") -> Column:
    return _assignment(b, "password|passwd|pass", ("pass",), assignment_span)


def webhook_secret(b: Column) -> Column:
    return _prefixed(b, any_of(b, "whsec_", "whsk_"), f"{NOT_AFTER_WORD}wh(?:sec|sk)_[{B64URL}]++", 20)


def slack_token(b: Column) -> Column:
    return _prefixed(b, any_of(b, "xox"), f"{NOT_AFTER_WORD}xox[bpsaor]-[A-Za-z0-9-]++", 15)


def github_token(b: Column) -> Column:
    return _prefixed(b, any_of(b, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), f"{NOT_AFTER_WORD}(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]++", 15)


def stripe_key(b: Column) -> Column:
    return _prefixed(b, any_of(b, "k_live_", "k_test_"), f"{NOT_AFTER_WORD}[spr]k_(?:live|test)_[A-Za-z0-9_]++", 15)


def generic_secret(b: Column, assignment_span: str = "value") -> Column:
    return greedy(_assignment(b, rf"(?<![{ALNUM}])(?:secret|token|credential|auth_key)(?![{ALNUM}])", ("secret", "token", "credential", "auth_key"), assignment_span))
