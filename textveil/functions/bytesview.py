"""The byte view of a text: one character for each UTF-8 byte.

All offsets are UTF-8 byte offsets while Spark's string functions count characters, so
scanning runs on ``decode(encode(text, 'UTF-8'), 'ISO-8859-1')``. The view has an exact
inverse, and bytes from 0x80 on are never ASCII letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes_view(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
