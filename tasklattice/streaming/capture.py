"""Capture of an arriving feed of messages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import capture
from ..schema import TASK_SCHEMA
from .state import use_disk_state

FIRST, REPEATED, LATE = "first", "repeated", "late"
TOO_LATE = "came later than the watermark"


class Arrivals(StatefulProcessor):
    """Tells a message's first arrival from repeated and late ones.

    The value kept per key is the time until which a repeat is known as one; a
    timer removes it when the watermark has passed that time.
    """

    def __init__(self, names: list[str], micros: str, keep_ms: int):
        self.row, self.micros, self.keep_ms = Row(*names, "arrival"), micros, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.seen.exists()
        first = None
        for row in rows:
            at = row[self.micros]
            if at is None or at < watermark * 1000:
                yield self.row(*row, LATE)
            elif known:
                yield self.row(*row, REPEATED)
            elif first is None or at < first[self.micros]:
                # The earliest of a batch is the first.
                if first is not None:
                    yield self.row(*first, REPEATED)
                first = row
            else:
                yield self.row(*row, REPEATED)
        if first is not None:
            until = first[self.micros] // 1000 + self.keep_ms
            self.seen.update((until,))
            self.handle.registerTimer(until)
            yield self.row(*first, FIRST)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def arrivals(messages: DataFrame, key: str, event_time: str, redelivery: str = "1 hour") -> DataFrame:
    """The feed with a column ``arrival``: first, repeated, or late.

    Late is a message from before the watermark, which runs ``redelivery`` behind the
    newest message of the earlier batches, and one without a time; its key may be
    forgotten already. Repeated is one whose key has come within ``redelivery``. No row
    vanishes. Rows of one key in a batch are one task's work, one at a time.
    """
    use_disk_state(messages.sparkSession)
    micros = "_micros"
    while micros in messages.columns:
        micros += "_"
    kept = messages.withWatermark(event_time, redelivery).withColumn(micros, F.unix_micros(F.col(event_time).cast("timestamp")))
    # The watermark is tied to the event time's own column; the operator would drop late rows that still had it.
    names = messages.columns
    plain = kept.select(*(F.unix_micros(F.col(n).cast("timestamp")).alias(n) if n == event_time else F.col(n) for n in names), micros)
    schema = T.StructType([*plain.schema.fields, T.StructField("arrival", T.StringType())])
    keep_ms = _milliseconds(messages.sparkSession, redelivery)
    told = plain.groupBy(key).transformWithState(Arrivals(plain.columns, micros, keep_ms), schema, "Append", "EventTime")
    kind = messages.schema[event_time].dataType
    return told.withColumn(event_time, F.timestamp_micros(event_time).cast(kind)).drop(micros)


def _milliseconds(spark: SparkSession, span: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {span})").first()[0]


def capture_stream(
    messages: DataFrame,
    path: str,
    nonce: str,
    at=None,
    raw: str = "text",
    event_time: str | None = None,
    redelivery: str = "1 hour",
    author: str | None = None,
) -> DataStreamWriter:
    """Write a feed (raw text, kind, ...) as tasks, with the bad rows beside them.

    With ``event_time`` the tasks carry that time; a message delivered again within
    ``redelivery`` is dropped, one from before the watermark goes to the quarantine
    (see ``arrivals``). Otherwise all carry ``at``. Each batch writes its own folder
    and overwrites it when it is run again, so a restart neither loses nor doubles rows.
    """
    if (event_time is None) == (at is None):
        raise ValueError("give either event_time or at")
    if event_time:
        messages = arrivals(messages, nonce, event_time, redelivery).where(F.col("arrival") != REPEATED)
    created = F.col(event_time) if event_time else at
    late = F.when(F.col("arrival") == LATE, TOO_LATE) if event_time else None

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = capture(batch, created, nonce, raw, author, refused=late)
        judged.withColumn("accepted", F.col("error").isNull()).write.mode("overwrite").partitionBy(
            "accepted"
        ).parquet(f"{path}/captured/batch={batch_id}")

    return messages.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)


def captured_rows(spark: SparkSession, path: str, accepted: bool) -> DataFrame:
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/captured")
    return rows.where(F.col("accepted").cast("string") == str(accepted).lower())


def captured_tasks(spark: SparkSession, path: str) -> DataFrame:
    return captured_rows(spark, path, True).select(*TASK_SCHEMA.names)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    return captured_rows(spark, path, False).drop("accepted", "batch")
