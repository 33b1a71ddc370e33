"""A stateful operator that keeps the first rows of each window of a stream, however the stream is cut into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups by key that share a window, so that no task sees all of its rows.
BUCKETS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstRows(StatefulProcessor):
    """Of the rows of a (window, bucket), the `most` first by (ts, key): a list state holds them until the watermark passes the
    window's end, when they go on and the state goes away."""

    def __init__(self, most: int, schema, key: str):
        self.most, self.schema, self.key = most, schema, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.rows.get()], columns=self.schema.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, new = self._held(), False
        for pdf in rows:
            parts = [x for x in (held, pdf[self.schema.names]) if len(x)]
            held = pd.concat(parts).sort_values(["ts", self.key], kind="stable").iloc[: self.most] if parts else held
            new = True
        if new:
            self.rows.put([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.tolist() if hasattr(x, "tolist") else x for x in r) for r in held.itertuples(index=False)])
            end = int(key[1])
            if end not in list(self.handle.listTimers()):
                self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.rows.clear()
        yield held

    def close(self) -> None:
        pass


def first_of_windows(stream: DataFrame, most: int, key: str = "call_id", late: str = "10 minutes", window: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The `most` first rows by (ts, key) of each window and bucket of keys, when the window is over. All buckets of a window
    come in one batch, in which first_overall makes one choice of them."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    placed = stream.withWatermark("ts", late).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_end", F.unix_millis(F.window("ts", window)["end"]))
    return placed.groupBy("_bucket", "_end").transformWithStateInPandas(FirstRows(most, stream.schema, key), stream.schema, "Append", "EventTime")


def first_overall(batch: DataFrame, most: int, key: str = "call_id", window: str = "1 hour") -> DataFrame:
    """The `most` first rows of each window, of the rows of its buckets."""
    by = Window.partitionBy(F.window("ts", window)["start"]).orderBy("ts", key)
    return batch.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= most).drop("_rn")
