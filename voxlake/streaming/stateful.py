"""The same behaviours on streams.

Debouncing is a session window, which closes once the watermark has passed the gap. The others keep a small state for each key; within a trigger, a key's
events are taken in the order of time and event id, all at once. ``ts`` has to be a timestamp, and is watermarked with ``DELAY``. A key's state goes once the watermark is ``expire`` past its
last event; its next event is a first one. Events older than the last one that their key has had are late and dropped: what they would have changed has been told.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How far events may be behind the latest one, and the milliseconds of event time after which a key's state goes.
DELAY = "1 day"
EXPIRE = 30 * 24 * 3600 * 1000


def debounce_stream(events: DataFrame, key: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """The last event of each burst: key, event_id, value, ts. ``ts`` has to be a timestamp; a burst is told after gap and delay have passed."""
    last = F.max_by(F.struct("event_id", "value", ts), F.struct(ts, "event_id")).alias("last")
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(last).select(key, "last.*")


def _keyed(events: DataFrame, key: str, step: Callable, schema: str, state: str, expire: int) -> DataFrame:
    """Run ``step(state tuple or None, rows) -> (state tuple, output frame without the key)`` over each key's new events, in order."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        if now is not None:
            late = (micros < now[0]) | ((micros == now[0]) & (rows["event_id"] <= now[1]))
            rows, micros = rows[~late], micros[~late]
        if not len(rows):
            return
        own, out = step(None if now is None else now[2:], rows)
        held.update((int(micros.iloc[-1]), int(rows["event_id"].iloc[-1]), *own))
        held.setTimeoutTimestamp(int(micros.iloc[-1]) // 1000 + expire)
        out.insert(0, names[0], k[0])
        yield out.set_axis(names, axis=1)

    return events.withWatermark("ts", DELAY).groupBy(key).applyInPandasWithState(run, schema, f"last_ts long, last_id long, {state}", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_stream(events: DataFrame, key: str = "user_id", expire: int = EXPIRE) -> DataFrame:
    """Events whose value differs from that of the event before."""

    def step(state, rows):
        value = rows["value"].astype("float64").reset_index(drop=True)
        before = value.shift()
        same = (value == before) | (value.isna() & before.isna())
        same.iloc[0] = state is not None and (pd.isna(value.iloc[0]) if state[1] else value.iloc[0] == state[0])
        last = value.iloc[-1]
        return (0.0 if pd.isna(last) else float(last), bool(pd.isna(last))), pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "value": value})[~same]

    return _keyed(events, key, step, f"{key} long, event_id long, value double", "value double, empty boolean", expire)


def baseline_stream(events: DataFrame, key: str = "user_id", expire: int = EXPIRE) -> DataFrame:
    """Each event with its key's first value (null, if that is)."""

    def step(state, rows):
        value = rows["value"].astype("float64")
        if state is None:
            state = (0.0, True) if pd.isna(value.iloc[0]) else (float(value.iloc[0]), False)
        return state, pd.DataFrame({"event_id": rows["event_id"], "value": value, "baseline": None if state[1] else state[0]}).astype({"baseline": "float64"})

    return _keyed(events, key, step, f"{key} long, event_id long, value double, baseline double", "baseline double, empty boolean", expire)


def combine_latest_stream(events: DataFrame, kinds: tuple[str, ...], key: str = "user_id", kind: str = "event_type", expire: int = EXPIRE) -> DataFrame:
    """Each event with the latest value of every kind so far (columns latest_0, latest_1, ...); a null value leaves the latest one."""

    def step(state, rows):
        out, now = {"event_id": rows["event_id"].to_numpy()}, []
        for i, k in enumerate(kinds):
            held = float("nan") if state is None or state[2 * i + 1] else state[2 * i]
            seen = rows["value"].astype("float64").where(rows[kind] == k).ffill().fillna(held)
            out[f"latest_{i}"] = seen.to_numpy()
            last = seen.iloc[-1]
            now += [0.0 if pd.isna(last) else float(last), bool(pd.isna(last))]
        return tuple(now), pd.DataFrame(out)

    schema = ", ".join(f"latest_{i} double" for i in range(len(kinds)))
    return _keyed(events, key, step, f"{key} long, event_id long, {schema}", ", ".join(f"latest_{i} double, empty_{i} boolean" for i in range(len(kinds))), expire)


def exclusive_selection_stream(events: DataFrame, key: str = "user_id", view: str = "event_type") -> DataFrame:
    """The view selected last, by key; for output modes update and complete."""
    return events.groupBy(key).agg(F.max_by(view, F.struct("ts", "event_id")).alias("selected"))


def fanout_stream(events: DataFrame, view, views) -> DataFrame:
    from .events import fanout_except_source

    return fanout_except_source(events, view, views)
