"""Event time from wall-clock times.

Watermarks need an instant, records carry wall-clock times without a zone. Both directions
go through UTC explicitly, so day and week windows follow the wall clock whatever the time
zone of the session is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.durations import DAY_SECONDS, whole_div


def event_time(wall_clock: Column) -> Column:
    return F.make_timestamp(
        F.year(wall_clock),
        F.month(wall_clock),
        F.dayofmonth(wall_clock),
        F.hour(wall_clock),
        F.minute(wall_clock),
        F.extract(F.lit("second"), wall_clock),
        F.lit("UTC"),
    )


def wall_date(instant: Column) -> Column:
    """Date of an instant produced by ``event_time``."""
    return F.date_from_unix_date(whole_div(F.unix_seconds(instant), DAY_SECONDS).cast("int"))
