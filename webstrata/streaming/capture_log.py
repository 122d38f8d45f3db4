"""Capture logs as streams: windowed counts with watermarks, changed versions only, idempotent store writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webstrata.operators.store import append_captures


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts; rows later than the watermark are left out by Spark when it runs as a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need an instant
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), key, "n"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n"
    )


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def changed_only(captures: DataFrame) -> DataFrame:
    """Captures (url, etag, commit_seq) whose etag differs from the URL's last one; state is one string a URL."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in parts:
            rows = []
            for row in pdf.sort_values("commit_seq").itertuples(index=False):
                if row.etag != last:
                    rows.append((row.url, row.etag, row.commit_seq))
                    last = row.etag
            yield pd.DataFrame(rows, columns=["url", "etag", "commit_seq"])
        state.update((last,))

    return captures.groupBy("url").applyInPandasWithState(
        step, "url string, etag string, commit_seq long", "etag string", "append", GroupStateTimeout.NoTimeout
    )


def write_store(stream: DataFrame, path: str, checkpoint: str):
    """Exactly once: a batch that runs again overwrites its own folder."""
    return stream.writeStream.foreachBatch(lambda df, batch: append_captures(df, path, batch)).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
