"""Date column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
MAIL_FORMAT = "d MMM yyyy HH:mm:ss Z"


def parse_published_at(text: Column) -> Column:
    """ISO-8601 or mail-style (RFC 2822) text to an instant; null for anything else.

    Times without an offset are UTC, so the session zone must be UTC.
    """
    value = F.trim(text)
    iso = F.when(value.rlike(ISO_DATE), F.try_to_timestamp(value))
    mail = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(iso, F.try_to_timestamp(mail, F.lit(MAIL_FORMAT)))
