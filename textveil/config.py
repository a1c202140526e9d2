"""Scan settings: defaults, the TOML subset, and how the two meet command-line options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .errors import ConfigError

MAX_FILE_SIZE = 26_214_400
MAX_DEPTH = 256
BINARY_MODES = ("skip", "fail", "best-effort")


@dataclass(frozen=True)
class ScanConfig:
    """``explicit`` names the options given on the command line, which a file can't change."""

    text: str | None = None
    input: str | None = None
    output: str | None = None
    in_place: bool = False
    recursive: bool = True  # inert: directories are always walked down
    report_json: bool = False
    config: str | None = None
    patterns: tuple[tuple[str, str], ...] = ()
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    dry_run: bool = False
    fail_on_find: bool = False
    summary: bool = False
    format: str = "text"
    replacement: str | None = None
    binary: str = "skip"
    max_file_size: int = MAX_FILE_SIZE
    include_hidden: bool = False
    follow_symlinks: bool = False
    threads: int | None = None  # inert: Spark's partitions set the parallelism
    assignment_span: str = "value"  # [ASSUMED] see operators/secrets.py
    ipv6: str = "code"  # "strict" is an extension
    explicit: frozenset[str] = field(default=frozenset())

    def with_file(self, text: str) -> ScanConfig:
        """Settings of a TOML subset under those of the command line; patterns and lists add up."""
        have, new = parse_toml_subset(text), {}
        if self.replacement is None and "replacement" in have:
            new["replacement"] = have["replacement"]
        size = have.get("max_file_size", "")
        if "max_file_size" not in self.explicit and size.isascii() and size.removeprefix("+").isdigit():
            new["max_file_size"] = int(size)
        for key in ("include_hidden", "follow_symlinks"):
            if key not in self.explicit and have.get(key) in ("true", "false"):
                new[key] = have[key] == "true"
        if "binary" not in self.explicit and "binary" in have:
            new["binary"] = have["binary"] if have["binary"] in BINARY_MODES else "skip"
        new["patterns"] = self.patterns + tuple((k.removeprefix("pattern."), v) for k, v in have.items() if k.startswith("pattern."))
        for name in ("allow", "deny"):
            more = [x.strip() for x in have.get(f"{name}_patterns", "").split(",") if x.strip()]
            new[name] = tuple(dict.fromkeys([*getattr(self, name), *more]))
        return replace(self, **new)


#: The white space that lines, keys and values are stripped of.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def parse_toml_subset(text: str) -> dict[str, str]:
    """Keys and values, a key in a section as ``section.key``.

    Only line feeds part lines. Blank lines and lines beginning with # are left; one layer of matching quotes goes;
    nothing is unescaped and there are no comments after values.
    """
    out: dict[str, str] = {}
    section = ""
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip(BLANKS)
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip(BLANKS)
        elif "=" in line:
            key, value = (x.strip(BLANKS) for x in line.split("=", 1))
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[f"{section}.{key}" if section else key] = value
        else:
            raise ConfigError(f"line {n}: expected key = value")
    return out
