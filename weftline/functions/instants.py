"""Instants written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?))?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?$"


def parse_instant(text: Column) -> Column:
    """ISO 8601 with or without offset (none means UTC) or milliseconds since 1970 as digits.

    Null, empty and unreadable text gives null, also dates that do not exist. The session's time zone
    plays no part. Digits beyond microseconds are cut off.
    """
    s = F.trim(text)
    clock = F.regexp_replace(F.regexp_extract(s, _ISO, 2), ",", ".")
    offset = F.upper(F.regexp_extract(s, _ISO, 3))
    offset = F.when(offset == "", F.lit("Z")).otherwise(F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    offset = F.when(F.length(offset) == 3, F.concat(offset, F.lit(":00"))).otherwise(offset)
    iso = F.concat(
        F.regexp_extract(s, _ISO, 1),
        F.lit("T"),
        F.when(clock == "", F.lit("00:00:00")).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock),
        offset,
    )
    return F.when(s.rlike(r"^\d{1,15}$"), F.timestamp_millis(F.when(s.rlike(r"^\d{1,15}$"), s).try_cast("bigint"))).when(
        s.rlike(_ISO), iso.try_cast("timestamp")
    )
