"""Change detection and windowed scores over event streams.

The batch operators work on finite traces; these keep the same semantics over unbounded ones. Events of a key must
arrive in order of their step within a micro-batch's reach; later ones for an earlier step are dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_values(events: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """key, step, value of each event whose value (as text) differs from the key's last one; the first counts.

    State per key: the last step and its value. Works on streams and, in one batch, on tables.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_step, last = state.get if state.exists else (None, None)
        first = last_step is None
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")
        out = []
        for s, v in zip(rows["step"].tolist(), rows["value"].tolist(), strict=True):
            if last_step is not None and s <= last_step:
                continue
            if first or v != last or v == "nan":
                out.append((keys[0], s, v))
            first, last_step, last = False, s, v
        if last_step is not None:
            state.update((int(last_step), last))
        yield pd.DataFrame(out, columns=["key", "step", "value"]).astype({"step": "int64"})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, step long, value string", "step long, value string", "append", GroupStateTimeout.NoTimeout)


def windowed_status(events: DataFrame, at: str, status: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by status in tumbling windows of event time; events later than late are dropped."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")


def resume_stream(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet exactly once, to be read by the batch operators."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
