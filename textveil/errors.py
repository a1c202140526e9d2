"""Errors with the exit code each stands for."""

from __future__ import annotations

OK, OPERATIONAL, USAGE, FINDINGS = 0, 1, 2, 3


class ScanError(Exception):
    kind, exit_code = "Error", OPERATIONAL

    def __str__(self) -> str:
        return f"{self.kind}: {super().__str__()}"


class IoError(ScanError):
    kind = "I/O error"


class UsageError(ScanError):
    kind, exit_code = "Usage error", USAGE


class ConfigError(ScanError):
    kind = "Config error"


class TraversalError(ScanError):
    kind = "Traversal error"


class DetectionError(ScanError):
    kind = "Detection error"


class AtomicWriteError(ScanError):
    kind = "Atomic write error"
