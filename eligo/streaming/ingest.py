"""Incremental ingestion of landed payload files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eligo.plans import ingest
from eligo.sources.fetches import content_hash


def first_sightings(fetches: DataFrame, time: str = "fetched_at", delay: str = "24 hours") -> DataFrame:
    """Payloads not seen before: the first of each (url, hash) within the delay.

    State holds one small row per pair and is dropped once the watermark has
    passed. It is spread by the pair, so one url's refetches with new content
    do not meet in one task; refetches of the same content are what is dropped.
    """
    hashed = fetches.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def newest_fetches(fetches: DataFrame, time: str = "fetched_at", delay: str = "24 hours", forget_days: int = 90,
                   key: str = "url") -> DataFrame:
    """Of a stream of fetches with a ``time``, those that bring something new: per url (or other ``key``) and micro-batch the newest fetch, if
    it is newer than all before and its content is another than that of the newest before.

    Repeats and late arrivals are dropped, across batches too. State is one small row per url and goes when the watermark
    is ``forget_days`` past the url's last fetch. A url's fetches of one batch pass through a task one by one; one row is held.
    """
    hashed = fetches.withWatermark(time, delay).withColumn("content_hash", content_hash(F.col("content")))
    names = hashed.columns

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get if state.exists else (None, None)
        best, row = seen, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = getattr(r, time), r.content_hash
                if found[0] is not None and found[1] is not None and (best[0] is None or found > (pd.Timestamp(best[0]), best[1])):
                    best, row = found, r
        if row is not None:
            state.update((best[0].to_pydatetime(), best[1]))
        if best[0] is not None:
            until = pd.Timestamp(best[0]).timestamp() + forget_days * 86_400
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        if row is not None:
            if best[1] != seen[1]:
                yield pd.DataFrame([row], columns=names)

    return hashed.groupBy(key).applyInPandasWithState(
        newest, hashed.schema, "at timestamp, hash string", "append", GroupStateTimeout.EventTimeTimeout)


def refresh(fetches: DataFrame, store: ingest.Store, checkpoint: str, time: str | None = None, **options) -> StreamingQuery:
    """Ingests what has landed since the last refresh, then stops.

    If ``time`` names the column with the time of a fetch, repeats and fetches older than what their url has brought
    before are left out (see :func:`newest_fetches`).

    Run it on a timer for a periodic refresh, or at once for a triggered one.
    Each micro-batch adds a generation to whatever the store holds by then, its
    own or others', marked with the stream's checkpoint and the batch's number.
    A batch that comes again finds its mark and does nothing more; if it died
    before the mark, what it left is not read and is written anew.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        name = f"{checkpoint}#{batch_id}"
        if name not in store.writers().values():
            ingest.run(batch, store, writer=name, **options)

    if time is not None:
        fetches = newest_fetches(fetches, time).drop(time, "content_hash")
    return (
        fetches.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
