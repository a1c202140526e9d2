"""The ordered list of detectors and what it finds in a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache, partial

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import MERGED, merge
from . import pii, secrets
from .custom import custom


@dataclass(frozen=True)
class Detector:
    """``build`` maps a byte view to ``array<struct<start, end, conf>>``."""

    name: str
    category: str
    build: Callable[[Column], Column]


@lru_cache(maxsize=8)
def builtins(assignment_span: str = "value", ipv6: str = "code") -> tuple[Detector, ...]:
    """The built-in detectors in their fixed order; both IP detectors share a name."""
    pair = {"assignment_span": assignment_span}
    s = [("AWS_KEY", secrets.aws_key), ("BEARER_TOKEN", secrets.bearer_token), ("JWT", secrets.jwt), ("PRIVATE_KEY", secrets.private_key), ("API_KEY", partial(secrets.api_key, **pair)), ("DATABASE_URL", secrets.database_url), ("PASSWORD", partial(secrets.password, **pair)), ("WEBHOOK_SECRET", secrets.webhook_secret), ("SLACK_TOKEN", secrets.slack_token), ("GITHUB_TOKEN", secrets.github_token), ("STRIPE_KEY", secrets.stripe_key), ("GENERIC_SECRET", partial(secrets.generic_secret, **pair))]
    p = [("EMAIL", pii.email), ("PHONE", pii.phone), ("IP", pii.ipv4), ("IP", partial(pii.ipv6, strict=ipv6 == "strict")), ("CREDIT_CARD", pii.credit_card), ("SSN", pii.ssn), ("PATH", pii.path)]
    return (*(Detector(n, "secret", f) for n, f in s), *(Detector(n, "pii", f) for n, f in p))


def _placed(place: int):
    """Spans with what sorts them: start, the longer first, then place in the registry and scan order."""

    def sortable(s, k):
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.lit(place).alias("det"), k.alias("ord"), s["conf"].alias("conf"))

    return sortable


#: Columns built so far. A detector's takes hundreds of calls to the JVM, and many queries use the same ones.
_BUILT: dict[tuple, Column] = {}


def _found(detector: Detector, place: int, b: Column) -> Column:
    key = (id(SparkContext._active_spark_context), detector, place, str(b))
    if key not in _BUILT:
        if len(_BUILT) >= 256:
            _BUILT.clear()
        _BUILT[key] = F.transform(detector.build(b), _placed(place))
    return _BUILT[key]


@dataclass
class Registry:
    detectors: list[Detector] = field(default_factory=list)

    def register(self, name: str, category: str, build: Callable[[Column], Column]) -> None:
        self.detectors.append(Detector(name, category, build))

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.detectors]

    def detect_all(self, b: Column) -> Column:
        """Merged findings of all detectors in a byte view; null for a null text."""
        found = [_found(d, i, b) for i, d in enumerate(self.detectors)]
        none = F.array().cast(MERGED)
        merged = merge(F.sort_array(F.concat(*found))) if found else none
        return F.when(b.isNull(), F.lit(None).cast(MERGED)).otherwise(merged)

    def name_of(self, det: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.names]), det) if self.detectors else F.lit("")

    def category_of(self, det: Column) -> Column:
        return F.get(F.array(*[F.lit(d.category) for d in self.detectors]), det) if self.detectors else F.lit("")


def build_registry(allow: Iterable[str] = (), deny: Iterable[str] = (), patterns: Iterable[tuple[str, str]] = (), **options) -> Registry:
    """Built-ins named in ``allow`` (all if it is empty) and not in ``deny``, then every custom
    pattern that compiles, whatever the lists say. Names are compared exactly."""
    allow, deny = set(allow), set(deny)
    out = Registry([d for d in builtins(**options) if (not allow or d.name in allow) and d.name not in deny])
    for name, pattern in patterns:
        if (build := custom(pattern)) is not None:
            out.register(name, "custom", build)
    return out
