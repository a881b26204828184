"""Beginnings and endings matched in one stateful pass, each record with a plan of its own.

Keys are dealt to buckets, and a bucket holds the open beginnings and waiting endings of all its keys
as one state. So Python is called, and the state is read and written, once for a bucket in a micro-batch
and not once for a key, and numpy matches the bucket's rows together. A beginning whose planned seconds
pass without an end is closed where the plan ends; an ending whose beginning can no longer come is handed
out at its own time. Each bucket times out where the next of its rows is due. So pairs and both rests
come out of one stream, with one state, each as soon as the watermark allows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.durations import elapsed_instants

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

_OUT = "guid string, user_id long, begin_us long, end_us long, kind int, done boolean"
_STATE = "guid array<string>, us array<long>, due_us array<long>, user_id array<long>, kind array<int>"
_COLUMNS, _NAMES = ([column.split()[0] for column in columns.split(", ")] for columns in (_OUT, _STATE))
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENDING, _BEGINNING, _NOBODYS = range(3)  # kinds of rows; the last is a beginning without a user
_NANOS = "1677-09-22", "2262-04-11"  # days that pandas can tell the time of


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB. It lies beside the executors and is saved
    in the checkpoint, so it is not bounded by their memory."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _mates(key: np.ndarray, us: np.ndarray, due: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row that is a beginning the number of its ending, else -1. Of one key, beginnings are
    served in the order of their times, each by the first ending within its plan that is left."""
    import numpy as np

    count = int(key.max()) + 1
    mate = np.full(len(key), -1)
    first, last = np.flatnonzero(begins), np.flatnonzero(~begins)
    of_begins, of_ends = (np.bincount(key[rows], minlength=count) for rows in (first, last))
    begin, end = np.empty(count, "int64"), np.empty(count, "int64")
    begin[key[first]], end[key[last]] = first, last
    single = (of_begins == 1) & (of_ends == 1)
    begin, end = begin[single], end[single]
    fits = (us[begin] <= us[end]) & (us[end] <= due[begin])
    mate[begin[fits]] = end[fits]

    several = (of_begins > 0) & (of_ends > 0) & ~single
    if several.any():
        first, last = first[several[key[first]]], last[several[key[last]]]
        first = first[np.lexsort((due[first], us[first], key[first]))]
        last = last[np.lexsort((us[last], key[last]))]
        ends = list(zip(key[last].tolist(), us[last].tolist(), strict=True))
        at = 0
        starts = zip(*(values[first].tolist() for values in (key, us, due)), strict=True)
        for row, (k, time, until) in zip(first, starts, strict=True):
            while at < len(ends) and ends[at] < (k, time):
                at += 1
            if at < len(ends) and ends[at] <= (k, until):
                mate[row] = last[at]
                at += 1
    return mate


def _match(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one bucket, with those that it holds from before. A row that finds no mate is kept
    until it is due: a beginning where its plan ends, an ending at its own time."""
    import numpy as np
    import pandas as pd

    types = (object, "int64", "int64", "int64", "int64")
    kept = state.get if state.exists else [[]] * len(types)
    before = len(kept[0])
    parts = [[np.array(values, kind) for values, kind in zip(kept, types, strict=True)]]
    if not state.hasTimedOut:
        parts += [[f[name].to_numpy(kind) for name, kind in zip(_NAMES, types, strict=True)] for f in frames]
    guid, us, due, user, kind = (np.concatenate(columns) for columns in zip(*parts, strict=True))
    begins = kind != _ENDING

    mate = _mates(pd.factorize(guid)[0], us, due, begins)
    paired = mate >= 0
    left = ~paired
    left[mate[paired]] = False
    due_ms = -(-due // 1000)
    over = left & (due_ms <= state.getCurrentWatermarkMs())
    left &= ~over

    found = np.flatnonzero(paired | over)
    if len(found):
        end = np.where(paired, us[mate], due)
        columns = (guid, user, us, end, kind, paired)
        yield pd.DataFrame({name: c[found] for name, c in zip(_COLUMNS, columns, strict=True)})
    if not left.any():
        if before:
            state.remove()
        return
    if left[before:].any() or not left[:before].all():
        state.update(tuple(c[left].tolist() for c in (guid, us, due, user, kind)))
    # a time-out comes when the watermark is behind its time, so one earlier is when the row is due
    state.setTimeoutTimestamp(max(int(due_ms[left].min()) - 1, 1))


def matched_records(
    begins: DataFrame,
    ends: DataFrame,
    planned: Column | None = None,
    delay: str = "1 hour",
    buckets: int = 4_096,
) -> DataFrame:
    """``guid, user_id, begin_time, end_time, elapsed_s, state`` from beginnings (guid, user_id,
    begin_time) and endings (guid, end_time).

    ``planned`` is the seconds that a beginning plans for, a day unless given or where it is null.
    A record is ``finished`` when an end comes within its plan (of several the first), ``expired``
    when none did, and then ends with the plan. An end that finds no beginning, also one after
    the plan, comes out as ``no beginning`` to be merged by key (``operators.ingest.add_endings``).
    To be started inside ``timer_state``. Null keys match nothing and are left out.

    ``buckets`` stays as it is while a checkpoint lives. A micro-batch reads and writes what is open
    in the buckets of its keys, so a stream with very many open records wants more of them. For the
    watermark alone, times that 64 bits of nanoseconds do not reach count as the nearest they do.
    """
    seconds = F.lit(86_400) if planned is None else F.coalesce(planned, F.lit(86_400))
    first = begins.select(
        "guid",
        F.col("begin_time").alias("time"),
        F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"),
        (seconds.cast("long") * 1_000_000).alias("planned_us"),
        F.when(F.col("user_id").isNull(), _NOBODYS).otherwise(_BEGINNING).alias("kind"),
    )
    second = ends.select(
        "guid",
        F.col("end_time").alias("time"),
        F.lit(0).cast("long").alias("user_id"),
        F.lit(0).cast("long").alias("planned_us"),
        F.lit(_ENDING).alias("kind"),
    )
    earliest, latest = (F.lit(day).cast("timestamp") for day in _NANOS)
    known = F.col("time").isNotNull()
    at = F.when(known, F.least(F.greatest("time", earliest), latest)).alias("at")
    sides = [side.select("*", at).withWatermark("at", delay) for side in (first, second)]
    guid = F.col("guid").cast("string")
    us = F.unix_micros("time")
    rows = (
        sides[0]
        .unionByName(sides[1])
        .filter(F.col("guid").isNotNull() & known)
        .select(
            F.pmod(F.xxhash64(guid), F.lit(buckets)).cast("int").alias("bucket"),
            "at",
            guid.alias("guid"),
            us.alias("us"),
            (us + F.col("planned_us")).alias("due_us"),
            "user_id",
            "kind",
        )
    )
    found = rows.groupBy("bucket").applyInPandasWithState(_match, _OUT, _STATE, "Append", "EventTimeTimeout")
    begun, nobodys = F.col("kind") != _ENDING, F.col("kind") == _NOBODYS
    begin, end = F.timestamp_micros("begin_us"), F.timestamp_micros("end_us")
    return found.select(
        "guid",
        F.when(begun & ~nobodys, F.col("user_id")).alias("user_id"),
        F.when(begun, begin).alias("begin_time"),
        end.alias("end_time"),
        F.when(begun, elapsed_instants(begin, end)).alias("elapsed_s"),
        F.when(~begun, "no beginning").when(F.col("done"), "finished").otherwise("expired").alias("state"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
