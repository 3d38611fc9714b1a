"""Text timestamps as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC, or ISO 8601 with ``Z`` or an offset; null where it is neither.

    The zone is written into the text, so the session's time zone has no say.
    """
    text = F.trim(text)
    zoned = text.rlike(r":\d\d(\.\d+)?\s*(Z|[+-]\d\d(:?\d\d)?)$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
