"""Event behaviours on streams with timers: a restartable timer, and keyed state that takes late rows in their order.

Every operator keeps a key's rows until the watermark has passed them and then takes them in the order of time and event id, so rows that are late
by less than the watermark's delay change nothing: a stream tells exactly what the batch form of ``events`` tells. One timer a key is
deleted and set anew, to the next moment at which something can happen. State lives in the RocksDB store, survives a restart from
the checkpoint, and goes when the watermark is ``expire`` past the key's last row: a row so long after the last is a first one.

Rows are key, ``event_id`` (long), ``ts`` (timestamp) and what an operator names. The session needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import DEBOUNCE_MS, LINKED_LEVEL, LINKED_WINDOW, VIEWS

#: Milliseconds of event time after which an idle key's state goes.
EXPIRE = 30 * 24 * 3600 * 1000
SLICES = tuple(v for v in VIEWS if v != "VOLUME")
_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(v):
    """None for a missing value, else a Python number or string."""
    return None if v is None or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v


class _InOrder(StatefulProcessor):
    """Takes a key's rows in order once the watermark has passed them.

    A subclass has ``columns`` (name, type) of its rows besides ts and event_id, the ``output`` columns besides the key, and ``step(row)`` and ``due(until)``, which return
    output rows; ``next_due`` is the microsecond at which something happens with no row.
    """

    columns: list[tuple[str, str]] = []

    def __init__(self, key: str, output: list[str], expire: int = EXPIRE):
        self.key, self.output, self.expire = key, output, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["ts long", "event_id long", *(f"{n} {t}" for n, t in self.columns)]))
        self.seen = handle.getValueState("seen", "last long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def forget(self) -> None: ...

    def step(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def due(self, until: int) -> list[tuple]:
        return []

    def next_due(self) -> int | None:
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, first = [n for n, _ in self.columns], None
        for frame in rows:
            if not len(frame):
                continue
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            first = min(int(micros.min()), first) if first is not None else int(micros.min())
            values = [[_plain(v) for v in frame[n]] for n in names]
            self.waiting.appendList([(int(t), int(i), *x) for t, i, *x in zip(micros, frame["event_id"], *values, strict=True)])
        armed = min(self.handle.listTimers(), default=None)
        if first is not None and (armed is None or -(-first // 1000) < armed):
            self._arm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        ripe, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        out = []
        names = ["ts", "event_id", *(n for n, _ in self.columns)]
        last = self.seen.get()[0] if self.seen.exists() else None
        for r in ripe:
            out += self.due(r[0])
            if last is not None and r[0] >= last + self.expire * 1000:
                self.forget()
            last = r[0]
            out += self.step(dict(zip(names, r, strict=True)))
        out += self.due(mark)
        if ripe:
            self.waiting.put(later) if later else self.waiting.clear()
            self.seen.update((last,))
        gone = last + self.expire * 1000 if last is not None else None
        if gone is not None and gone <= mark:
            self.forget()
            self.seen.clear()
            gone = None
        moments = [t for t in (later[0][0] if later else None, self.next_due(), gone) if t is not None]
        self._arm(min(moments, default=None))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.output])

    def _arm(self, micros: int | None) -> None:
        """One timer, at a moment (timers are in whole milliseconds)."""
        want = None if micros is None else -(-micros // 1000)
        have = list(self.handle.listTimers())
        for t in have:
            if t != want:
                self.handle.deleteTimer(t)
        if want is not None and want not in have:
            self.handle.registerTimer(want)

    def close(self) -> None: ...


def _run(rows: DataFrame, key: str, processor: _InOrder, schema: str, delay: str, initial: DataFrame | None = None) -> DataFrame:
    marked = rows.withWatermark("ts", delay).select(key, "event_id", "ts", *(n for n, _ in processor.columns))
    return marked.groupBy(key).transformWithStateInPandas(processor, f"{key} long, {schema}", "Append", "EventTime", initial.groupBy(key) if initial is not None else None)


# --- the window/level controller: restartable timer, value at fire time, gate


def controller(events: DataFrame, key: str, gap_ms: int = DEBOUNCE_MS, interactive: bool = True) -> DataFrame:
    """What the window/level controller tells: key, event_id, ts, told, window, level. The batch form.

    ``kind`` of an event is 'window' or 'level' (its ``value`` is the new one), 'interactive' (a value of 0 closes the gate, any other opens it; at first it is ``interactive``),
    or 'commit'. A change while the gate is open starts the timer anew. ``gap_ms`` after its last start the timer fires, once, gate or no gate, and
    'changed' is told with the values of that moment: changes behind a closed gate show in it. A commit tells 'committed' at once and leaves the timer alone. An event
    at the very moment of firing comes after it. Null values change nothing, and nothing is told before both have a value.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gate = F.coalesce(F.last(F.when(F.col("kind") == "interactive", F.col("value") != 0), ignorenulls=True).over(w), F.lit(interactive))
    starts = F.col("kind").isin("window", "level") & F.col("value").isNotNull() & gate
    e = events.select(key, "event_id", "ts", "kind", "value").withColumn("starts", starts)
    after = F.first(F.when(F.col("starts"), F.col("ts")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    gap = F.make_dt_interval(secs=F.lit(gap_ms / 1000))
    fired = e.withColumn("after", after).where(F.col("starts") & (F.col("after").isNull() | (F.col("after") >= F.col("ts") + gap)))
    fired = fired.select(key, "event_id", (F.col("ts") + gap).alias("ts"), F.lit("fire").alias("kind"), F.lit(None).cast("double").alias("value"))
    both = e.select(*fired.columns).unionByName(fired)
    upto = Window.partitionBy(key).orderBy("ts", F.col("kind") != "fire", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    now = {k: F.last(F.when(F.col("kind") == k, F.col("value").cast("double")), ignorenulls=True).over(upto) for k in ("window", "level")}
    told = F.when(F.col("kind") == "fire", "changed").when(F.col("kind") == "commit", "committed")
    return both.withColumns({"told": told, **now}).where("told IS NOT NULL AND window IS NOT NULL AND level IS NOT NULL").select(key, "event_id", "ts", "told", "window", "level")


class _Controller(_InOrder):
    columns = [("kind", "string"), ("value", "double")]

    def __init__(self, key: str, gap_ms: int, interactive: bool, expire: int):
        super().__init__(key, ["event_id", "ts", "told", "window", "level"], expire)
        self.gap, self.interactive = gap_ms * 1000, interactive

    def open(self, handle):
        self.own = handle.getValueState("own", "gate boolean, window double, level double, at long, by long")

    def forget(self):
        self.own.clear()

    def _now(self) -> list:
        return list(self.own.get()) if self.own.exists() else [self.interactive, None, None, None, None]

    def _told(self, now: list, event_id: int, micros: int, told: str) -> list[tuple]:
        return [(event_id, pd.Timestamp(micros, unit="us"), told, now[1], now[2])] if now[1] is not None and now[2] is not None else []

    def step(self, row):
        now, out = self._now(), []
        if row["kind"] == "commit":
            return self._told(now, row["event_id"], row["ts"], "committed")
        if row["value"] is None:
            return out
        if row["kind"] == "interactive":
            now[0] = row["value"] != 0
        elif row["kind"] in ("window", "level"):
            now[1 if row["kind"] == "window" else 2] = row["value"]
            if now[0]:
                now[3:] = row["ts"] + self.gap, row["event_id"]
        self.own.update(tuple(now))
        return out

    def due(self, until):
        now = self._now()
        if now[3] is None or now[3] > until:
            return []
        out = self._told(now, now[4], now[3], "changed")
        now[3:] = None, None
        self.own.update(tuple(now))
        return out

    def next_due(self):
        return self._now()[3]


def controller_stream(events: DataFrame, key: str, delay: str, gap_ms: int = DEBOUNCE_MS, interactive: bool = True, expire: int = EXPIRE) -> DataFrame:
    """``controller`` on a stream; the timer's moment is told as soon as the watermark has passed it."""
    return _run(events, key, _Controller(key, gap_ms, interactive, expire), "event_id long, ts timestamp, told string, window double, level double", delay)


# --- baseline by view


class _Baselines(_InOrder):
    columns = [("view", "string"), ("value", "double")]

    def open(self, handle):
        self.first = handle.getMapState("first", "view string", "value double")

    def forget(self):
        self.first.clear()

    def step(self, row):
        view = (row["view"] or "",)
        if not self.first.containsKey(view):
            self.first.updateValue(view, (row["value"],))
        return [(row["event_id"], row["view"], row["value"], self.first.getValue(view)[0])]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for view, value in zip(initialState["view"], initialState["baseline"], strict=True):
            self.first.updateValue((_plain(view) or "",), (_plain(value),))


def baselines_stream(events: DataFrame, key: str, delay: str, initial: DataFrame | None = None, expire: int = EXPIRE) -> DataFrame:
    """Each event (view, value) with the first value that its key and view had: event_id, view, value, baseline. Views are entries of one map a key.

    ``initial`` (key, view, baseline) is what earlier rows came to, see ``baselines_after``. Equals ``events.baseline_retained`` by key and view; a null view is its own.
    """
    return _run(events, key, _Baselines(key, ["event_id", "view", "value", "baseline"], expire), "event_id long, view string, value double, baseline double", delay, initial)


def baselines_after(events: DataFrame, key: str) -> DataFrame:
    """What a stream starts from after these events: key, view, baseline."""
    first = F.min_by(F.struct("value"), F.struct("ts", "event_id"))
    return events.groupBy(key, "view").agg(first.alias("first")).select(key, "view", F.col("first.value").cast("double").alias("baseline"))


# --- linked views


class _Linked(_InOrder):
    columns = [("view", "string"), ("kind", "string"), ("window", "double"), ("level", "double")]

    def open(self, handle):
        self.flag = handle.getValueState("flag", "linked boolean")
        self.shown = handle.getMapState("shown", "view string", "window double, level double")

    def forget(self):
        self.flag.clear()
        self.shown.clear()

    def step(self, row):
        linked = self.flag.exists() and self.flag.get()[0]
        if row["kind"] == "link" and not linked:
            for v in SLICES:
                self.shown.updateValue((v,), (LINKED_WINDOW, LINKED_LEVEL))
        elif row["kind"] == "edit" and row["view"] in SLICES:
            for v in SLICES if linked else (row["view"],):
                self.shown.updateValue((v,), (row["window"], row["level"]))
        if row["kind"] in ("link", "unlink"):
            self.flag.update((row["kind"] == "link",))
        return [(row["event_id"], v, *(self.shown.getValue((v,)) if self.shown.containsKey((v,)) else (None, None))) for v in SLICES]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for _, r in initialState.iterrows():
            self.flag.update((bool(r["linked"]),))
            if r["set"]:
                self.shown.updateValue((r["target"],), (_plain(r["window"]), _plain(r["level"])))


def linked_stream(events: DataFrame, key: str, delay: str, initial: DataFrame | None = None, expire: int = EXPIRE) -> DataFrame:
    """``events.linked`` on a stream of view, kind, window, level: key, event_id, target, shown_window, shown_level. A view is an entry of a key's map.

    ``initial`` is what earlier rows came to, see ``linked_after``.
    """
    return _run(events, key, _Linked(key, ["event_id", "target", "shown_window", "shown_level"], expire), "event_id long, target string, shown_window double, shown_level double", delay, initial)


def linked_after(events: DataFrame, key: str) -> DataFrame:
    """What a stream starts from after these events: key, target, linked, set, window, level, a row for each slice view."""
    from .events import linked

    order = F.struct("ts", "event_id")
    last = linked(events, [key], ["ts", "event_id"])
    flag = events.groupBy(key).agg(F.coalesce(F.max_by(F.when(F.col("kind").isin("link", "unlink"), F.col("kind") == "link"), F.when(F.col("kind").isin("link", "unlink"), order)), F.lit(False)).alias("linked"))
    began = ((F.col("kind") == "edit") & ((F.col("view") == F.col("target")))) | (F.col("kind") == "link")
    shown = last.groupBy(key, "target").agg(F.max_by(F.struct("shown_window", "shown_level"), order).alias("s"), F.bool_or(began).alias("set"))
    return shown.join(flag, key).select(key, "target", "linked", "set", F.col("s.shown_window").alias("window"), F.col("s.shown_level").alias("level"))


# --- a range's positions and values


class _Positions(_InOrder):
    columns = [("lo", "int"), ("hi", "int"), ("tracking", "boolean")]

    def __init__(self, key: str, bounds: tuple[int, int], start: tuple[int, int], expire: int):
        super().__init__(key, ["event_id", "position_lo", "position_hi", "value_lo", "value_hi"], expire)
        self.bounds, self.start = bounds, start

    def open(self, handle):
        self.own = handle.getValueState("own", "position_lo int, position_hi int, value_lo int, value_hi int")

    def forget(self):
        self.own.clear()

    def step(self, row):
        was = self.own.get() if self.own.exists() else (*self.start, *self.start)
        a, b = (None if x is None else min(max(x, self.bounds[0]), self.bounds[1]) for x in (row["lo"], row["hi"]))
        ends = [x for x in (a, b) if x is not None] or [None]
        now = (min(ends), max(ends)) if ends != [None] else (None, None)
        moved = now != tuple(was[:2])
        values = now if moved and row["tracking"] else tuple(was[2:])
        self.own.update((*now, *values))
        return [(row["event_id"], *now, *values)] if moved else []

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.own.update(tuple(int(r[c]) for c in ("position_lo", "position_hi", "value_lo", "value_hi")))


def positions_stream(events: DataFrame, key: str, bounds: tuple[int, int], start: tuple[int, int], delay: str, initial: DataFrame | None = None, expire: int = EXPIRE) -> DataFrame:
    """``events.positions`` on a stream of lo, hi (ints) and tracking: key, event_id, position_lo, position_hi, value_lo, value_hi."""
    return _run(events, key, _Positions(key, bounds, start, expire), "event_id long, position_lo int, position_hi int, value_lo int, value_hi int", delay, initial)


def positions_after(events: DataFrame, key: str, bounds: tuple[int, int], start: tuple[int, int]) -> DataFrame:
    """What a stream starts from after these events: the last positions and values of each key that has moved."""
    from .events import positions

    moved = positions(events, [key], ["ts", "event_id"], "lo", "hi", bounds, F.col("tracking"), start)
    names = ["position_lo", "position_hi", "value_lo", "value_hi"]
    return moved.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("ts", "event_id")).alias("s")).select(key, *(F.col(f"s.{n}").cast("int").alias(n) for n in names))


