"""Counter deltas over a stream: a keyed state holds the last value of each series.

A row's delta is known when the series' next row arrives, so the state keeps one row per series and nothing else, however
long the stream runs. Each trigger's closed rows are written below the number of its batch; a repeated batch replaces its own
rows, so a restart adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetscope.operators.counters import SERIES_KEYS

#: Why a row has no delta: it waited longer than a series may pause, or it came after a later row of its series.
CLOSED, LATE = "closed", "late"

Write = Callable[[DataFrame, int], None]


def _number(kind: T.DataType) -> Callable[[str], int | float | Decimal]:
    """How a value is read from its text. Batches carry texts, as pandas makes doubles of whole numbers beside a NULL."""
    return Decimal if isinstance(kind, T.DecimalType) else float if isinstance(kind, T.FractionalType) else int


def _chain(order: str, value: str, columns: Sequence[str], kind: T.DataType, pause_ms: int | None):
    delta, number = f"{value}_delta", _number(kind)

    def frame(rows: list[list]) -> pd.DataFrame:
        """Whole numbers stay whole beside a NULL."""
        whole = (value, delta) if number is int else ()
        return pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64") if c in whole else pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, last = state.get
            state.remove()
            yield frame([[*key, at, last, None, CLOSED]])
            return
        found = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = [(at, None if text is None else number(text)) for at, text in zip(found[order].tolist(), found[value].tolist())]
        waits, done = state.get if state.exists else None, []
        for at, now in rows:
            if waits is not None and at <= waits[0]:
                done.append([*key, at, now, None, LATE])
                continue
            if waits is not None:
                done.append([*key, *waits, None if now is None or waits[1] is None else now - waits[1], None])
            waits = (at, now)
        if waits is not None:
            state.update(waits)
            if pause_ms is not None:
                state.setTimeoutDuration(pause_ms)
        yield frame(done)

    return run


def delta_stream(rows: DataFrame, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id", value: str = "wait_time",
                 pause_ms: int | None = None) -> DataFrame:
    """Rows of a stream with ``<value>_delta`` (next minus current), each as soon as its next row is there.

    ``note`` is NULL for them. A row that is not after its series' last one is returned without a delta and the note ``late``: the rows around it are
    gone. With ``pause_ms`` a series that gets no row for so long is closed: its last row is returned without a delta and
    the note ``closed``, and its state goes; a later row begins anew. ``order`` is a whole number; ``value`` any number.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    delta = f"{value}_delta"
    out = T.StructType([*(T.StructField(c, kinds[c]) for c in (*series, order, value)), T.StructField(delta, kinds[value]), T.StructField("note", T.StringType())])
    kept = T.StructType([T.StructField("at", kinds[order]), T.StructField("last", kinds[value])])
    timeout = GroupStateTimeout.NoTimeout if pause_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    texts = rows.select(*series, order, F.col(value).cast("string").alias(value))
    return texts.groupBy(*series).applyInPandasWithState(_chain(order, value, out.names, kinds[value], pause_ms), out, kept, "append", timeout)


def batch_writer(out: str) -> Write:
    """Writes each batch below its number; a batch that is repeated replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")


def run_deltas(stream: DataFrame, write: Write, state_folder: str, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id",
               value: str = "wait_time") -> None:
    """Chain what the source holds now and stop. After a failure, the next run continues from ``state_folder`` and repeats the batch that was cut off.
    Series are not closed by the clock here: a run that waits for a pause would not end."""
    run = (
        delta_stream(stream, series, order, value).writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", state_folder).trigger(availableNow=True).start()
    )
    run.awaitTermination()


def closed_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.parquet(out).drop("batch")


def waiting_rows(spark: SparkSession, state_folder: str, order: str = "snap_id", value: str = "wait_time") -> DataFrame:
    """The last row of each series, read from the state of the last finished batch."""
    state = spark.read.format("statestore").load(state_folder)
    return state.select("key.*", F.col("value.groupState.at").alias(order), F.col("value.groupState.last").alias(value))
