"""Structured Streaming: pages seen once, and per-origin politeness as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls


def seen_once(pages: DataFrame) -> DataFrame:
    """The first page of each canonical url over the life of the stream; the state is the keys."""
    return pages.withColumn("canonical", urls.canonicalize(F.col("url"))).where("canonical is not null").dropDuplicates(["canonical"])


def polite_starts(requests: DataFrame, delay_ms: int) -> DataFrame:
    """``origin, url, start_ms``: requests ``origin, url, arrived_ms`` in the order of arrival, an origin's starts at least ``delay_ms`` apart. State is one number an origin."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["arrived_ms", "url"])
        starts = []
        for arrived in rows["arrived_ms"]:
            free = int(arrived) if free is None else max(free, int(arrived))
            starts.append(free)
            free += delay_ms
        state.update((free,))
        yield pd.DataFrame({"origin": key[0], "url": rows["url"].to_numpy(), "start_ms": starts})

    return requests.groupBy("origin").applyInPandasWithState(run, "origin string, url string, start_ms long", "free long", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, length: str, late: str) -> DataFrame:
    """Events by type in tumbling windows, closed once the watermark has passed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
