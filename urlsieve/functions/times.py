"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(col: str, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column.

    TIMESTAMP_NTZ: a plain wall-clock difference (no session-zone cast, so no
    shift and no daylight-saving jump); TIMESTAMP: ``unix_micros``."""
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return F.timestamp_diff("MICROSECOND", epoch, F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))
