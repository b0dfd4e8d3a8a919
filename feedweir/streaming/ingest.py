"""Feeds as streams: a folder of files as imports, and rows as keyed state."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedweir.control.jobs import Imports

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, landing: str, imports: Imports, checkpoint: str, user_id: str = "stream", files_per_trigger: int = 20, available_now: bool = True):
    """A streaming query over <landing>/<merchant>/<file>.csv: each new file is submitted and run.

    Only the names travel through Spark; contents are read where they lie. A batch that runs again after a crash submits
    the same bytes, which are the same imports.
    """

    def batch(frame: DataFrame, batch_id: int) -> None:
        for row in frame.orderBy("modificationTime", "path").collect():  # files_per_trigger at most
            path = row["path"].removeprefix("file:")
            with open(path, "rb") as source:
                imports.submit(os.path.basename(os.path.dirname(path)), user_id, os.path.basename(path), source)
        while imports.process_next():
            pass

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    query = files.load(landing).select("path", "modificationTime", "length").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def fresh_rows(rows: DataFrame, keys: list[str], columns: str, newest: str = "updated_at", order: str = "row_number") -> DataFrame:
    """Of a stream of rows those that are strictly newer than all before of their key, in state that holds one
    instant a key. Late rows lose, however late; there is no watermark. `columns` is the DDL of the rows."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        for frame in frames:
            taken = []
            for i, at in frame.sort_values(order)[newest].items():
                if best is None or at > best:
                    best = at
                    taken.append(i)
            yield frame.loc[taken]
        if best is not None:
            state.update((int(best.value // 1000),))

    return rows.groupBy(*keys).applyInPandasWithState(step, columns, "best long", "append", GroupStateTimeout.NoTimeout)


def first_contents(submissions: DataFrame, keys: list[str], columns: str, order: str) -> DataFrame:
    """Of a stream of submissions the first of each key (merchant and content hash)."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(frames))
        if not state.exists:
            state.update((1,))
            yield every.sort_values(order).head(1)

    return submissions.groupBy(*keys).applyInPandasWithState(step, columns, "seen long", "append", GroupStateTimeout.NoTimeout)
