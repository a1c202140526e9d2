"""Whether bytes are text: a NUL, or too many control bytes among the first ones, say no."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE = 8192
SHARE = 0.3


def is_binary(content: Column) -> Column:
    """Over a binary column: any NUL in the sample, or a share of control bytes above ``SHARE``.

    Control bytes are those under 0x07 and 0x0E to 0x1F but for ESC.
    """
    s = F.left(F.decode(content, "ISO-8859-1"), F.lit(SAMPLE))
    control = F.length(F.regexp_replace(s, "[^\\x00-\\x06\\x0E-\\x1A\\x1C-\\x1F]++", ""))
    return F.contains(s, F.lit("\0")) | (control / F.greatest(F.length(s), F.lit(1)) > SHARE)
