"""Latest-wins requests and stamp-validated caches, as batch windows and as keyed streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_requests(requests: DataFrame) -> DataFrame:
    """requests (project, ts, seq) with status 'ok', or 'skipped' for one that is older than an earlier arrival of its project."""
    seen = F.max("ts").over(Window.partitionBy("project").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("status", F.when(F.col("ts") < seen, "skipped").otherwise("ok"))


def stamp_misses(reads: DataFrame) -> DataFrame:
    """reads (key, seq, stamp) with miss: whether a cache that is valid for its last stamp only must compute."""
    last = F.lag("stamp").over(Window.partitionBy("key").orderBy("seq"))
    return reads.withColumn("miss", ~F.col("stamp").eqNullSafe(last) | F.row_number().over(Window.partitionBy("key").orderBy("seq")).eqNullSafe(1))


STATUS = "project long, ts timestamp, seq long, status string"


def latest_requests_stream(requests: DataFrame) -> DataFrame:
    """The rule of latest_requests on a stream: the newest time of each project is state; a batch is taken in the order of seq."""

    def step(key: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(lots)).sort_values("seq", kind="stable")
        status = []
        for ts in rows["ts"]:
            status.append("skipped" if newest is not None and ts < newest else "ok")
            newest = ts if newest is None else max(newest, ts)
        state.update((newest.to_pydatetime(),))
        yield rows.assign(status=status)[["project", "ts", "seq", "status"]]

    return requests.select("project", "ts", "seq").groupBy("project").applyInPandasWithState(step, STATUS, "newest timestamp", "append", GroupStateTimeout.NoTimeout)


def stamp_misses_stream(reads: DataFrame) -> DataFrame:
    """The rule of stamp_misses on a stream."""

    def step(key: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        first = not state.exists
        rows = pd.concat(list(lots)).sort_values("seq", kind="stable")
        miss = []
        for stamp in rows["stamp"]:
            miss.append(first or stamp != last)
            first, last = False, stamp
        state.update((last,))
        yield rows.assign(miss=miss)[["key", "seq", "stamp", "miss"]]

    return reads.select("key", "seq", "stamp").groupBy("key").applyInPandasWithState(step, "key long, seq long, stamp string, miss boolean", "stamp string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window, with a watermark for late ones; the same plan in batch and stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
