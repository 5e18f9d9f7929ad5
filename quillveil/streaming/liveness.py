"""Liveness by heartbeats, and redaction of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillveil.functions.detectors import detected_spans, detector
from quillveil.operators.apply import redact_row

SILENCE = 30
FIRST_BEAT = 60
_STATE = "beats bigint, last_ms bigint, closing boolean"
_OUT = "key bigint, reason string, beats bigint, last_ms bigint"


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", silence: int = SILENCE) -> DataFrame:
    """Sessions of each key, cut where no event came for longer than `silence` seconds: what the watchdog would have seen."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap > silence * 1_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session_no").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))


def watch(beats: DataFrame, silence: int = SILENCE, first_beat: int = FIRST_BEAT) -> DataFrame:
    """Streaming watchdog over (key, kind, ts); kind is open, beat or close.

    A key fires once: when it closes, after `silence` seconds without a beat
    once there was one, or after `first_beat` seconds if there was none.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beats_, last, closing = state.get if state.exists else (0, 0, False)
        fire = None
        if state.hasTimedOut:
            fire = None if closing else ("silence" if beats_ else "no_beat")
            closing = True
        for pdf in rows:
            pdf = pdf[pdf["ts"].notna()]
            if pdf.empty:
                continue
            beats_ += int((pdf["kind"] == "beat").sum())
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
            if (pdf["kind"] == "close").any() and not closing:
                fire, closing = "close", True
        state.update((beats_, last, closing))
        if not closing:
            state.setTimeoutDuration((silence if beats_ else first_beat) * 1000)
        if fire:
            yield pd.DataFrame({"key": [key[0]], "reason": [fire], "beats": [beats_], "last_ms": [last]})

    return beats.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def redact_stream(rows: DataFrame, keys: list[str], text_col: str = "text", mark: str = "") -> DataFrame:
    """Detect, redact and audit row by row, without state: for streams and for tables alike."""
    found = [detector(k) for k in keys]
    spans = F.concat(*[detected_spans(F.col(text_col), d) for d in found])
    cut = rows.withColumns({"n_hits": F.size(spans), text_col: redact_row(F.col(text_col), spans, mark)})
    left = F.size(F.concat(*[detected_spans(F.col(text_col), d) for d in found]))
    return cut.withColumn("status", F.when(left > 0, "fail").otherwise("pass"))
