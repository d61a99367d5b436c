"""Streams: scoring row by row, and metrics by window. An extension beyond batch.

Scoring is the same projection as in batch, so a stream needs no state for it.
Metrics are sums by event-time window; the watermark says how late rows may be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import POINTWISE
from ..operators.scoring import predict


def score_stream(stream: DataFrame, model, features: list[str], **options) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return predict(stream, model, features, **options)


def windowed_metric(stream: DataFrame, metric: str, label: str, pred: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, n_rows, value) of a pointwise metric."""
    at = stream.withWatermark(time, late).groupBy(F.window(time, window))
    return at.agg(F.count(F.lit(1)).alias("n_rows"), POINTWISE[metric](label, pred).alias("value"))


def score_with_reload(stream: DataFrame, load, features: list[str], sink, checkpoint: str):
    """Score micro-batches with the model that ``load()`` returns at each; ``sink(df, batch_id)`` takes the result."""

    def each(batch: DataFrame, number: int) -> None:
        sink(predict(batch, load(), features), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
