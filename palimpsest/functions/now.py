"""The time of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sysdate() -> Column:
    """The time at which a query begins, without a zone (in UTC), one value for all its rows."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
