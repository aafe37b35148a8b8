"""The last record of each key as a stream: a state a key, which later and late files change only where they hold a greater place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def _last(frame: pd.DataFrame, by: list[str], order: list[str]) -> pd.DataFrame:
    """The row of each key with the greatest place; rows without a whole place are left out."""
    return frame.dropna(subset=order).sort_values(order, kind="stable").drop_duplicates(by, keep="last")


def latest_stream(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A stream of rows (the columns of records) in update mode: whenever a key gets a record of a greater place, that record.

    order: the columns that make a record's place; of equal places the first seen stays, so a repeated file changes nothing. Records arrive in any order, a late one is
    kept from replacing a later. Each task first keeps the last record of each key of its own rows, so a frequent key sends a row a task. Null keys are one key.
    What state holds is a row a key, without an end: manifests grow by papers.
    """
    names = records.columns
    rest = [c for c in names if c != key]

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _last(frame, [key], order)

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(rest, state.get, strict=True)) if state.exists else None
        best = None
        for frame in frames:
            for row in _last(frame, [key], order).to_dict("records"):
                if best is None or tuple(row[c] for c in order) > tuple(best[c] for c in order):
                    best = row
        if best is not None and (held is None or tuple(best[c] for c in order) > tuple(pd.Timestamp(held[c]) if isinstance(best[c], pd.Timestamp) else held[c] for c in order)):
            state.update(tuple(best[c].to_pydatetime() if isinstance(best[c], pd.Timestamp) else best[c] for c in rest))
            yield pd.DataFrame([best], columns=names)

    kept = StructType([records.schema[c] for c in rest])
    first = records.mapInPandas(within, records.schema)
    return first.groupBy(F.col(key)).applyInPandasWithState(update, records.schema, kept, "update", GroupStateTimeout.NoTimeout)


def keep_latest(records: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> None:
    """Runs the stream over what is there, and writes what changed: Parquet below path, a folder a batch. A batch that is run again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    latest_stream(records, key, order).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(changes: DataFrame, key: str) -> DataFrame:
    """The records as they stand, from what keep_latest() wrote: of each key that of the last batch."""
    rows = F.struct(*[F.col(c) for c in changes.columns if c != "batch"])
    return changes.groupBy(key).agg(F.max_by(rows, "batch").alias("_r")).select("_r.*")
