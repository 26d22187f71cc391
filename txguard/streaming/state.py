"""Per-user bounded history as keyed streaming state (applyInPandasWithState).

State per userId: the newest HISTORY_CAP {amount, lat, lon}, newest first.  The
rows of a user in a micro-batch are put in (time, id) order over all Arrow
batches before anything is computed, so a user with more rows than one Arrow
batch gets the history the replay gives.  The state function returns only what
needs the history - previous location, median, rolling statistics - computed
for all rows at once; everything else is the replay's own row-local columns.

The history outlives a checkpoint: ``export_history`` reads it from the state
store of one, and a stream on another starts from the exported rows, which enter
as *seeds*, rows with the three lists and no message.  A seed gives a user
without history theirs, before any message of the same micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.schemas import HISTORY_CAP

STATE_SCHEMA = T.StructType([
    T.StructField("amounts", T.ArrayType(T.DoubleType())),
    T.StructField("lats", T.ArrayType(T.DoubleType())),
    T.StructField("lons", T.ArrayType(T.DoubleType())),
])
#: An exported history: one row per user.
HISTORY_SCHEMA = T.StructType([T.StructField("userId", T.StringType()), *STATE_SCHEMA.fields])

INPUT_NUMBERS = ["amount", "lat", "lon", "distance_from_home", "repeat_retailer", "used_chip", "used_pin_number",
                 "online_order"]
#: Where a message was read, and when (milliseconds); carried through for dead letters and durations.
POSITION = [T.StructField("partition", T.IntegerType()), T.StructField("offset", T.StringType()),
            T.StructField("read_ms", T.LongType())]
ROLLING = (10, 50)
CHUNK = 10_000      # rows whose windows are laid out at once


def output_schema() -> T.StructType:
    """Input columns plus the history columns of the online replay."""
    fields = [T.StructField(c, T.StringType()) for c in ("_id", "userId")]
    fields += [T.StructField(c, T.DoubleType()) for c in INPUT_NUMBERS]
    fields += [T.StructField("timestamp", T.TimestampType()), *POSITION]
    fields += [T.StructField(c, T.DoubleType()) for c in ("_prev_lat", "_prev_lon")]
    fields += [T.StructField("_has_prev", T.BooleanType()), T.StructField("median_purchase_price", T.DoubleType())]
    fields += [T.StructField(f"rolling_ratio_{k}_{n}", T.DoubleType()) for n in ROLLING for k in ("mean", "std")]
    return T.StructType(fields)


def history_columns(new: np.ndarray, before: np.ndarray, history: int) -> dict[str, np.ndarray]:
    """Statistics of each new amount with the ones before it; ``before`` is oldest first."""
    width = max(history + 1, *ROLLING)
    line = np.concatenate([np.full(width - 1, np.nan), before, new])
    windows = np.lib.stride_tricks.sliding_window_view(line, width)[len(before):]
    out = {"median_purchase_price": np.nanmedian(windows[:, -(history + 1):], axis=1)}
    for n in ROLLING:
        last = windows[:, -n:]
        known = np.sum(~np.isnan(last), axis=1)
        out[f"rolling_ratio_mean_{n}"] = np.nanmean(last, axis=1)
        spread = np.nansum((last - out[f"rolling_ratio_mean_{n}"][:, None]) ** 2, axis=1)
        out[f"rolling_ratio_std_{n}"] = np.sqrt(spread / np.maximum(known - 1, 1))
    return out


def make_state_fn(history: int = HISTORY_CAP):
    cols = [f.name for f in output_schema().fields]
    names = [f.name for f in STATE_SCHEMA.fields]

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [p for p in pdfs if not p.empty]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        past = state.get if state.exists else None
        if names[0] in pdf:
            seeds = pdf[pdf[names[0]].notna()]
            pdf = pdf[pdf[names[0]].isna()]
            if past is None and len(seeds):
                past = tuple(seeds.iloc[0][n][:history] for n in names)
                state.update(tuple([float(v) for v in x] for x in past))
            if pdf.empty:
                return
        old = [np.array(list(x)[::-1], dtype="float64") for x in past] if past is not None else [np.empty(0)] * 3
        pdf = pdf.sort_values(["timestamp", "_id"], kind="mergesort", ignore_index=True)
        line = [np.concatenate([o, pdf[c].to_numpy("float64")]) for o, c in zip(old, ("amount", "lat", "lon"))]
        seen = len(old[0])
        has_prev = np.arange(len(pdf)) + seen > 0
        for lo in range(0, len(pdf), CHUNK):
            part = pdf.iloc[lo:lo + CHUNK].copy()
            a, b = seen + lo, seen + lo + len(part)
            for name, values in history_columns(line[0][a:b], line[0][max(0, a - max(history, 49)):a], history).items():
                part[name] = values
            part["_has_prev"] = has_prev[lo:lo + len(part)]
            for name, values in (("_prev_lat", line[1]), ("_prev_lon", line[2])):
                part[name] = np.concatenate([[np.nan], values])[a:b]
            yield part.reindex(columns=cols)
        state.update(tuple(x[::-1][:history].tolist() for x in line))

    return fn


def export_history(spark: SparkSession, checkpoint: str, path: str, batch_id: int | None = None) -> DataFrame:
    """Write the history of every user, as the scoring stream's checkpoint holds it, to ``path`` and read it back.

    ``checkpoint`` is the folder given to ``start_scoring``; ``batch_id`` takes
    the history after that micro-batch, else the newest one.
    """
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(f"{checkpoint.rstrip('/')}/scoring")
    held = F.col("value.groupState")
    user = F.col("key").getField(state.schema["key"].dataType.names[0])
    rows = state.select(user.alias("userId"), *[held[f.name].alias(f.name) for f in STATE_SCHEMA.fields])
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)
