"""The first page of each address as a stream, with state by key that time bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType

FIRST = "site_id string, url string, page_seq long, text_hash string, copies long"
_STATE = StructType().add("page_seq", LongType()).add("text_hash", StringType()).add("copies", LongType())


class FirstPages(StatefulProcessor):
    """Of each (site_id, url) the page with the least page_seq (of equal ones the least hash), and how many there were."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, copies = None, 0
        if self.first.exists():
            seq, text_hash, copies = self.first.get()
            best = (seq, text_hash)
        until = max(self.handle.listTimers(), default=0)
        for part in rows:
            copies += len(part)
            until = max(until, int(part["landed_at"].max().timestamp() * 1000) + self.keep_ms)
            best = min([*([best] if best else []), *zip(part["page_seq"].tolist(), part["text_hash"].fillna("").tolist(), strict=True)])
        self.first.update((int(best[0]), best[1], int(copies)))
        # an address is forgotten some time after the last page that it had
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        yield pd.DataFrame({"site_id": [key[0]], "url": [key[1]], "page_seq": [int(best[0])], "text_hash": [best[1]], "copies": [int(copies)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_pages(pages: DataFrame, late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """Updates of ``FIRST`` for a stream of ``pages`` (site_id, url, page_seq, text_hash, landed_at).

    A row is the state of its address after a batch and replaces the one before. In whatever batches and order pages arrive, the last row of each address is
    what ``shapes.keep_first`` gives for all of them, as long as an address is met again within ``keep_ms`` of event time; after that it is forgotten, so
    state is bounded by the addresses of that time.
    """
    keyed = pages.withWatermark("landed_at", late).groupBy("site_id", "url")
    return keyed.transformWithStateInPandas(FirstPages(keep_ms), outputStructType=FIRST, outputMode="Update", timeMode="EventTime")


def follow_first_pages(pages: DataFrame, out: str, checkpoint: str, late: str = "1 hour", keep_ms: int = 86_400_000) -> StreamingQuery:
    """Appends the updates of each batch to ``out``, in a folder named by the batch, which is overwritten when the batch is retried.

    State by key is kept in RocksDB, so it need not fit in memory.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return first_pages(pages, late, keep_ms).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
